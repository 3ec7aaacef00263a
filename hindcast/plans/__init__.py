"""Registered queries: each maps the driver's tables to the domain shapes and runs one operator."""

from __future__ import annotations

import importlib

MODULES = (
    "ingest", "history", "silver", "sampling", "profile", "textual", "retrieval",
    "uncertainty", "scoring", "models", "calibration", "cascades", "agreement",
    "gates", "traces", "spend", "annotation", "streams",
)


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"hindcast.plans.{name}")
