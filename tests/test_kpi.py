"""KPI pipeline properties: clamp ranges, profile as a table, exact rounding."""

from pyspark.sql import functions as F

from conftest import SF_CHECK, SF_SMALL

from sitewatt.operators import kpi as KPI
from sitewatt.plans.catalog import Ctx
from sitewatt.schemas import KPI_CONFIG

CLAMPS = KPI.KPI_CLAMPS


def test_kpi_clamps(spark):
    k = KPI.kpi_snapshots(Ctx(spark, SF_CHECK).tm)
    row = k.agg(*[F.min(c).alias(f"lo_{c}") for c in CLAMPS], *[F.max(c).alias(f"hi_{c}") for c in CLAMPS]).first()
    for c, (lo, hi) in CLAMPS.items():
        assert float(row[f"lo_{c}"]) >= lo and float(row[f"hi_{c}"]) <= hi, c
    assert k.count() == Ctx(spark, SF_CHECK).tm.select("ts").distinct().count()


def test_profile_table_equals_default(spark):
    tm = Ctx(spark, SF_SMALL).tm
    prof = spark.createDataFrame([tuple(KPI.DEFAULT_PROFILE[f.name] for f in KPI_CONFIG.fields)], KPI_CONFIG)
    a = sorted(tuple(r) for r in KPI.kpi_snapshots(tm).collect())
    b = sorted(tuple(r) for r in KPI.kpi_snapshots(tm, prof).collect())
    assert a == b


def test_it_energy_exact_ties(spark):
    # 2-digit watts / 1000 at 4 digits: 1234.45 W -> 1.23445 kWh -> 1.2345 (exact half up)
    from decimal import Decimal
    df = spark.createDataFrame([(Decimal("1234.45"),)], "it_power_w decimal(28,2)")
    from sitewatt.functions.scalar import dec
    v = df.select(F.round(F.col("it_power_w") * dec("0.001", 4, 3), 4).alias("v")).first()["v"]
    assert v == Decimal("1.2345")


def test_kpi_long_and_export(spark):
    c = Ctx(spark, SF_SMALL)
    latest = KPI.latest_row(KPI.kpi_snapshots(c.tm)) if hasattr(KPI, "latest_row") else None
    from sitewatt.operators.latest import latest_row
    latest = latest_row(KPI.kpi_snapshots(c.tm))
    names = [r["metric_name"] for r in KPI.kpi_long(latest).collect()]
    assert len(names) == 11 and "dc_cef_kgco2_per_kwh" in names
    assert [r["metric_name"] for r in KPI.kpi_long(latest, prefix="site_").collect()][0] == "site_pue"
