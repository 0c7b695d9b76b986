"""Registered queries over sf0.001: SQL where it exists, contracts, and the pipeline's stages."""

import corpus_pipeline
from conftest import SF_SMALL
from sitewatt.llm.common import documents, materialize
from sitewatt.llm.queries import ORACLE, QUERIES
from sitewatt.plans.verify import compare, duck_connect


def test_sql_matches(spark):
    duck = duck_connect(SF_SMALL)
    for name, sql in ORACLE.items():
        r = compare(spark, duck, name, QUERIES[name], sql, SF_SMALL)
        assert r["cols"] and r["rows"] and r["values"], r


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark):
    docs = documents(spark, SF_SMALL)
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF_SMALL), "test")
        assert docs.columns == columns and docs.count() <= before, name
        before = docs.count()
    name, stage = corpus_pipeline.STAGES[-1]
    pieces = materialize(stage(spark, docs, SF_SMALL), "test")
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
