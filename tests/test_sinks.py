"""Keyed ingestion rules: first-wins append, last-wins upsert, guards, DQ."""

from frames import T0, T1, asset_row, frames, tm_row

from sitewatt.operators import quality as DQ
from sitewatt.operators.sinks import (accept_newer, append_first_wins, first_wins, is_empty, upsert,
                                      with_date_partition, write_table)


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_first_wins_within_batch(spark):
    df = spark.createDataFrame([(1, "a", 10), (1, "b", 5), (2, "c", 7)], "k int, v string, o int")
    assert _rows(first_wins(df, ["k"], "o")) == [(1, "b", 5), (2, "c", 7)]


def test_append_first_wins_never_changes_existing(spark):
    target = spark.createDataFrame([(1, "old", 0)], "k int, v string, o int")
    batch = spark.createDataFrame([(1, "new", 1), (2, "x", 2), (2, "y", 1)], "k int, v string, o int")
    new = append_first_wins(target, batch, ["k"], "o")
    assert _rows(new) == [(2, "y", 1)]
    assert _rows(target.unionByName(new)) == [(1, "old", 0), (2, "y", 1)]


def test_upsert_last_wins_and_idempotent(spark):
    target = spark.createDataFrame([(1, "old"), (3, "keep")], "k int, v string")
    batch = spark.createDataFrame([(1, "new", 2), (1, "newer", 3), (2, "add", 1)], "k int, v string, o int")
    once = upsert(target, batch, ["k"], "o")
    assert _rows(once) == [(1, "newer"), (2, "add"), (3, "keep")]
    twice = upsert(once, batch, ["k"], "o")
    assert _rows(twice) == _rows(once)


def test_accept_newer_and_is_empty(spark):
    tm, _ = frames(spark, [tm_row(T0, 1)], [])
    batch, _ = frames(spark, [tm_row(T0, 2), tm_row(T1, 2)], [])
    assert accept_newer(batch, tm).count() == 1
    empty, _ = frames(spark, [], [])
    assert is_empty(empty) and not is_empty(tm)
    assert accept_newer(batch, empty).count() == 2


def test_partitioned_write_roundtrip(spark, scratch):
    tm, _ = frames(spark, [tm_row(T0, 1), tm_row(T1, 2)], [])
    path = write_table(with_date_partition(tm), scratch + "/tm", partition_by=["dt"])
    back = spark.read.parquet(path)
    assert back.count() == 2 and "dt" in back.columns


def test_quality_checks(spark):
    tm, assets = frames(spark, [tm_row(T0, 1), tm_row(T0, 1, cpu="9"), tm_row(T1, 7)], [asset_row(1, "a1")])
    dups = DQ.check_unique(tm, ["ts", "asset_id"]).collect()
    assert [(r["asset_id"], r["copies"]) for r in dups] == [(1, 2)]
    orphans = DQ.check_fk(tm, assets, ["asset_id"]).collect()
    assert [r["asset_id"] for r in orphans] == [7]
    nulls = DQ.check_not_null(tm).collect()[0]
    assert nulls["rows"] == 3 and nulls["cpu_usage_nulls"] == 0
    checks = DQ.check_all({"telemetry_metrics": tm, "assets": assets})
    assert set(checks) == {"unique:telemetry_metrics", "unique:assets", "fk:telemetry_metrics->assets"}


def test_append_first_wins_bounded_by_batch_range(spark):
    tm, _ = frames(spark, [tm_row(T0, 1), tm_row(T1, 1)], [])
    batch, _ = frames(spark, [tm_row(T1, 1, cpu="99"), tm_row(T1, 2), tm_row(T1, 2, cpu="1")], [])
    batch = batch.withColumn("seq", __import__("pyspark.sql.functions", fromlist=["F"]).monotonically_increasing_id())
    new = append_first_wins(tm.withColumn("seq", tm.asset_id * 0), batch, ["ts", "asset_id"], "seq").collect()
    assert [(r["asset_id"], str(r["cpu_usage"])) for r in new] == [(2, "50.00")]
