"""The registered queries against their SQL, and the pipeline stage by stage."""

from __future__ import annotations

import pytest

import corpus_pipeline
from aeroseries.llm import oracles, queries
from checks.compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert difference(spark, connect(SF_DIR), name, SF_DIR) is None


def test_all_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.queries()) == list(range(1, 14))


def test_pipeline_stages(spark, tmp_path):
    docs = queries.table(spark, SF_DIR, "documents")
    names, kept = docs.columns, {row.doc_id for row in docs.select("doc_id").collect()}
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF_DIR).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        left = {row.doc_id for row in docs.select("doc_id").collect()}
        assert left <= kept and left
        assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == names
        kept = left
    assert corpus_pipeline.run(spark, SF_DIR).count() == docs.count()
