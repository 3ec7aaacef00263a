"""Registered queries beside their SQL at the smallest scale."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
KEYS = (
    "latest_per_key", "cutoff_export", "replay_labels", "replay_state", "active_mark", "component_vote", "stratified_sample",
    "hash_folds", "fenced_share", "codeowners", "visible_count", "dense_topk", "multilabel_prf", "reliability_mass",
    "agreement_by_task", "tag_agreement", "trace_digest", "budget_breach", "batching", "stream_label_state",
)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_sql(spark, con, key):
    status, rows, _, _ = compare(spark, con, SF, entry.queries()[key], entry.oracle_sql()[key])
    assert status == "ok" and rows > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 150


def test_label_profile_counts_every_issue(spark, tmp_path):
    """Issues of numbers divisible by 10 count like the rest."""
    rows = [(i, f"text {i}", "en", "web", 6) for i in range(21)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["label"]: r for r in entry.queries()["label_profile"](spark, str(tmp_path)).collect()}
    assert found["status-new"]["n"] == 21 and found["status-new"]["share"] == 1.0
    assert found["topic-0"]["n"] == 5 and found["topic-0"]["examples"] == "text 0 / text 5 / text 10"
