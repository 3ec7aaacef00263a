"""The driver contract in fresh processes: no session yet, and without the training-data folders."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
LOAD = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert set(o) <= set(q); print(len(q), 'pipeline' in q)"


def loaded(folder: Path) -> tuple[int, bool]:
    run = subprocess.run([sys.executable, "-c", LOAD], cwd=folder, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr[-2000:]
    count, pipeline = run.stdout.split()[-2:]
    return int(count), pipeline == "True"


def without(folder: Path, *left_out: str) -> Path:
    skip = {ROOT / name for name in left_out}

    def ignored(at: str, names: list[str]) -> list[str]:
        return [n for n in names if n in (".git", "__pycache__") or Path(at) / n in skip]

    return Path(shutil.copytree(ROOT, folder / "copy", ignore=ignored))


def test_queries_load_without_a_session():
    assert loaded(ROOT)[0] >= 185


def test_the_rest_loads_without_the_training_data_folders(tmp_path):
    count, pipeline = loaded(without(tmp_path, "hindcast/llm", "tests/llm"))
    assert count >= 185 and not pipeline


def test_the_rest_loads_without_the_pipeline_as_well(tmp_path):
    count, pipeline = loaded(without(tmp_path, "hindcast/llm", "tests/llm", "corpus_pipeline.py"))
    assert count >= 185 and not pipeline
