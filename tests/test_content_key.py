"""A table replaced in a running session changes the registered queries' results."""

import shutil

from conftest import SF_SMALL

from sitewatt.plans.catalog import QUERIES


def test_replaced_table_is_seen(spark, tmp_path):
    for name in ("events", "customer", "nation", "region"):
        shutil.copyfile(f"{SF_SMALL}/{name}.parquet", tmp_path / f"{name}.parquet")
    before = QUERIES["fact_stats"](spark, str(tmp_path)).first()["row_count"]
    kpis = QUERIES["kpi_snapshots"](spark, str(tmp_path)).count()
    fewer = spark.read.parquet(f"{SF_SMALL}/events.parquet").filter("event_id % 4 = 0").toPandas()
    fewer["ts"] = fewer["ts"].astype("datetime64[us]")
    fewer.to_parquet(tmp_path / "events.parquet")
    after = QUERIES["fact_stats"](spark, str(tmp_path)).first()["row_count"]
    assert 0 < after < before
    assert QUERIES["kpi_snapshots"](spark, str(tmp_path)).count() < kpis


def test_grown_dimension_is_not_broadcast_unchecked(spark, scratch):
    """A table replaced under the same file names is counted again: the old "small" answer does not stay."""
    import pandas as pd

    from sitewatt.operators.joins import fits_broadcast
    path = f"{scratch}/dim.parquet"
    pd.DataFrame({"k": range(10), "v": ["x"] * 10}).to_parquet(path)
    assert fits_broadcast(spark.read.parquet(path), 100)
    pd.DataFrame({"k": range(1000), "v": ["x"] * 1000}).to_parquet(path)
    assert not fits_broadcast(spark.read.parquet(path), 100)
    assert not fits_broadcast(spark.range(10).selectExpr("id", "repeat('x', 1000) as v"), 100, 5000)
