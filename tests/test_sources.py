"""Operational table loading (explicit schemas) and KPI snapshot upserts."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from conftest import SF_SMALL

from sitewatt.operators.kpi import kpi_snapshots
from sitewatt.operators.sinks import upsert
from sitewatt.plans.catalog import Ctx
from sitewatt.schemas import ASSETS, ROOMS, TELEMETRY
from sitewatt.sources.tables import load_tables


def test_load_tables_with_declared_schemas(spark, scratch):
    ts = dt.datetime(2024, 1, 1, 0, 0, tzinfo=dt.timezone.utc)
    data = {
        "rooms": spark.createDataFrame([("room-a", "Room A")], ROOMS),
        "assets": spark.createDataFrame([("srv-01", "srv-01", "room-a", "Room A", "rack-01", "Rack 01", "gpu-node",
                                          1, 2, True, D("450.00"))], ASSETS),
        "telemetry_metrics": spark.createDataFrame([(ts, "srv-01", D("50.00"), D("400.00"), D("22.00"), D("30.00"),
                                                     D("0.3400"), D("0.1360"), "normal", "running")], TELEMETRY),
    }
    for name, df in data.items():
        df.write.parquet(f"{scratch}/{name}")
    tables = load_tables(spark, scratch, names=list(data))
    for name, df in tables.items():
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in data[name].schema]
        assert df.count() == 1


def test_kpi_snapshot_upsert_by_ts(spark):
    tm = Ctx(spark, SF_SMALL).tm
    kpi = kpi_snapshots(tm)
    newest = kpi.agg(F.max("ts")).first()[0]
    batch = kpi.where(F.col("ts") == F.lit(newest)).withColumn("pue", F.lit(D("9.999")).cast("decimal(18,3)"))
    merged = upsert(kpi, batch, ["ts"])
    assert merged.count() == kpi.count()
    assert merged.where(F.col("ts") == F.lit(newest)).first()["pue"] == D("9.999")
    assert merged.groupBy("ts").count().where("count > 1").count() == 0
