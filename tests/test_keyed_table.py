"""Keyed upserts: only touched buckets are rewritten, replays change nothing, failed commits leave the old version."""

import os

import pytest
from pyspark.sql import functions as F

from sitewatt.operators.keyed_table import KeyedTable

SCHEMA = "k long, v string, o int"


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))


def _files(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(f"{path}/data") for f in fs if f.endswith(".parquet")}


def test_merge_rewrites_only_touched_buckets(spark, scratch):
    t = KeyedTable(f"{scratch}/t", ["k"], "o", buckets=16)
    assert t.current(spark) is None
    t.merge(spark.range(200).selectExpr("id as k", "'a' as v", "1 as o"))
    first = _files(t.path)
    assert len(first) == 16
    touched = t.merge(spark.createDataFrame([(3, "b", 2), (500, "new", 1), (7, "late", 0)], SCHEMA))
    assert 1 <= touched <= 2 and len(_files(t.path) - first) == touched  # 7 came late: its bucket stays
    got = dict((k, v) for k, v, _ in _rows(t.current(spark)))
    assert len(got) == 201 and got[3] == "b" and got[500] == "new" and got[7] == "a"


def test_replay_and_ties(spark, scratch):
    t = KeyedTable(f"{scratch}/t", ["k"], "o", buckets=4)
    batch = spark.createDataFrame([(1, "x", 5), (1, "y", 5), (2, None, None), (None, "n", 1)], SCHEMA)
    assert t.merge(batch) > 0
    before = _rows(t.current(spark)), t.versions(spark), _files(t.path)
    assert t.merge(batch) == 0 and t.merge(batch.limit(0)) == 0
    assert (_rows(t.current(spark)), t.versions(spark), _files(t.path)) == before
    assert before[0] == [(None, "n", 1), (1, "y", 5), (2, None, None)]
    t.merge(spark.createDataFrame([(2, "z", 0), (None, "m", 1)], SCHEMA))
    assert _rows(t.current(spark)) == [(None, "m", 1), (1, "y", 5), (2, "z", 0)]


def test_failed_commit_leaves_the_old_version(spark, scratch, monkeypatch):
    t = KeyedTable(f"{scratch}/t", ["k"], buckets=4)
    t.merge(spark.createDataFrame([(1, "a", 0)], SCHEMA))

    def lost(*_):
        raise OSError("driver lost")
    monkeypatch.setattr(t, "_commit", lost)
    with pytest.raises(OSError):
        t.merge(spark.createDataFrame([(1, "b", 0), (2, "c", 0)], SCHEMA))
    monkeypatch.undo()
    assert _rows(t.current(spark)) == [(1, "a", 0)] and t.versions(spark) == [0]
    t.merge(spark.createDataFrame([(1, "b", 0), (2, "c", 0)], SCHEMA))  # the writer comes back
    assert _rows(t.current(spark)) == [(1, "b", 0), (2, "c", 0)]


def test_old_versions_stay_for_readers_and_then_go(spark, scratch):
    t = KeyedTable(f"{scratch}/t", ["k"], buckets=2)
    for i in range(6):
        t.merge(spark.createDataFrame([(1, f"v{i}", 0)], SCHEMA))
    assert t.versions(spark) == [3, 4, 5]
    assert _rows(t.current(spark, 3)) == [(1, "v3", 0)] and len(_files(t.path)) == 3


def test_second_writer_is_refused(spark, scratch):
    t = KeyedTable(f"{scratch}/t", ["k"], buckets=2)
    one = spark.createDataFrame([(1, "a", 0)], SCHEMA)
    t.merge(one)
    with pytest.raises(RuntimeError):
        t._commit(spark, 0, {}, one.schema)


def test_replace(spark, scratch):
    t = KeyedTable(f"{scratch}/t", ["k"], "o", buckets=8)
    t.merge(spark.range(50).selectExpr("id as k", "'a' as v", "1 as o"))
    t.replace(spark.createDataFrame([(5, "only", 1), (5, "newer", 2)], SCHEMA))
    assert _rows(t.current(spark)) == [(5, "newer", 2)]


def test_composite_keys_and_hot_bucket(spark, scratch):
    t = KeyedTable(f"{scratch}/t", ["k", "v"], "o", buckets=1)
    rows = spark.range(3000).select((F.col("id") % 3).alias("k"), F.lit("s").alias("v"), F.col("id").cast("int").alias("o"))
    t.merge(rows)
    assert _rows(t.current(spark)) == [(0, "s", 2997), (1, "s", 2998), (2, "s", 2999)]
