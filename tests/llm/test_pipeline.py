"""The pipeline's stages on a small table, and the queries with SQL."""

from __future__ import annotations

import pytest

import corpus_pipeline
from hindcast.llm.queries import ORACLES, QUERIES
from tests.llm.cases import empty, frame
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_sql(spark, key):
    status, rows, _, _ = compare(spark, connect(SF), SF, QUERIES[key], ORACLES[key])
    assert status == "ok" and rows > 0


def test_stages_keep_the_columns(spark):
    for docs in (frame(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.select(*corpus_pipeline.COLUMNS).schema)
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        result = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert result.count() == docs.count()


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and sum(r.n_tokens for r in rows) == max(r.start + r.n_tokens for r in rows)
