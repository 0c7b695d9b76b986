"""Semantics on tiny frames: empty input, boundaries, ties, duplicates, nulls."""

import datetime as dt
from decimal import Decimal as D

from frames import T0, T1, asset_row, frames, tm_row

from sitewatt.operators import alerts as A
from sitewatt.operators import rollups as R
from sitewatt.operators import topk as K
from sitewatt.operators import timeseries as TS
from sitewatt.operators.latest import last_not_null, latest_per_key, latest_row
from sitewatt.operators.filters import scope, time_range
from sitewatt.functions.bands import band
from pyspark.sql import functions as F


def test_empty_facts(spark):
    tm, assets = frames(spark, [], [asset_row(1, "a1")])
    lat = latest_per_key(tm)
    site = R.site_summary(lat).collect()
    assert len(site) == 1 and site[0]["critical_assets"] == 0 and site[0]["current_power_w"] is None
    assert latest_row(tm).count() == 0
    v = R.scoped_stat(lat, assets, "power_w", "sum", 1, as_of="2024-01-30 23:00:00").collect()
    assert v[0]["value"] == 0.0
    assert R.range_avg(tm, "power_w", 1).collect()[0]["value"] is None
    assert A.alert_pressure(A.active_alerts(lat, assets)).collect()[0]["value"] == 0.0


def test_latest_methods_agree(spark):
    rows = [tm_row(T0, 1, cpu="10"), tm_row(T1, 1, cpu="20"), tm_row(T0, 2, cpu="30")]
    tm, _ = frames(spark, rows, [])
    a = sorted((tuple(r) for r in latest_per_key(tm, method="semi").collect()), key=lambda r: r[1])
    b = sorted((tuple(r) for r in latest_per_key(tm, method="max_by").select(*tm.columns).collect()),
               key=lambda r: r[1])
    assert a == b and [r[2] for r in a] == [D("20.00"), D("30.00")]


def test_alert_boundaries(spark):
    rows = [tm_row(T1, 1, cpu="90.00"), tm_row(T1, 2, cpu="89.99"),
            tm_row(T1, 3, outlet="34.00"), tm_row(T1, 4, outlet="36.00"),
            tm_row(T1, 5, power="540.00"), tm_row(T1, 6, power="590.00"), tm_row(T1, 7, power="539.99"),
            tm_row(T1, 8, state="standby")]
    tm, assets = frames(spark, rows, [asset_row(i, f"srv-{i}") for i in range(1, 9)])
    got = {(r["asset_id"], r["rule_name"], r["severity"], r["message"], r["metric_value"], r["threshold"])
           for r in A.active_alerts(latest_per_key(tm), assets).collect()}
    assert got == {
        (1, "CPU saturation", "critical", "srv-1 CPU at 90.0%", 90.0, 90.0),
        (3, "Thermal envelope", "warning", "srv-3 outlet temp at 34.0 C", 34.0, 34.0),
        (4, "Thermal envelope", "critical", "srv-4 outlet temp at 36.0 C", 36.0, 34.0),
        (5, "Power spike", "warning", "srv-5 draw at 540 W", 540.0, 540.0),
        (6, "Power spike", "critical", "srv-6 draw at 590 W", 590.0, 540.0),
        (8, "Operational state", "warning", "srv-8 currently in standby state", 1.0, 0.0),
    }


def test_feed_order_and_ties(spark):
    rows = [tm_row(T1, i, cpu="95", outlet="37") for i in range(1, 6)]
    tm, assets = frames(spark, rows, [asset_row(i, f"srv-{i}") for i in range(1, 6)])
    feed = A.alert_feed(A.active_alerts(latest_per_key(tm), assets), limit=3).collect()
    # alphabetical severity DESC keeps every critical tie; asset id breaks them
    assert [(r["asset_id"], r["rule_name"]) for r in feed] == [(1, "CPU saturation"), (1, "Thermal envelope"),
                                                                (2, "CPU saturation")]
    ranked = A.alert_feed(A.active_alerts(latest_per_key(tm), assets), limit=2, severity_rank=True).collect()
    assert all(r["severity"] == "critical" for r in ranked)


def test_asset_without_telemetry(spark):
    tm, assets = frames(spark, [tm_row(T1, 1)], [asset_row(1, "a1"), asset_row(2, "a2")])
    lat = latest_per_key(tm)
    assert R.assets_in_scope(assets).collect()[0]["value"] == 2.0
    assert R.footprint(lat, assets).collect()[0]["assets"] == 1


def test_telemetry_for_unknown_asset_is_dropped_by_join(spark):
    tm, assets = frames(spark, [tm_row(T1, 1), tm_row(T1, 99, power="999")], [asset_row(1, "a1")])
    v = R.scoped_stat(latest_per_key(tm), assets, "power_w", "sum", 1).collect()[0]["value"]
    assert v == 400.0
    # the site summary has no join and keeps it
    assert R.site_summary(latest_per_key(tm)).collect()[0]["current_power_w"] == 1399.0


def test_scope_filters(spark):
    tm, assets = frames(spark, [tm_row(T1, 1), tm_row(T1, 2, power="100")],
                        [asset_row(1, "a1", room="R1"), asset_row(2, "a2", room="R2", rack="K2")])
    lat = latest_per_key(tm)
    assert R.scoped_stat(lat, assets, "power_w", "sum", 1, room="R2").collect()[0]["value"] == 100.0
    assert R.scoped_stat(lat, assets, "power_w", "sum", 1, room="R1", rack="K2").collect()[0]["value"] == 0.0
    # a server literally named "All" cannot be selected: "All" means no filter
    assert scope(assets, server="All").count() == 2


def test_top_k_ties_deterministic(spark):
    rows = [tm_row(T1, i, outlet="35") for i in range(1, 6)]
    tm, assets = frames(spark, rows, [asset_row(i, f"a{i}") for i in range(1, 6)])
    got = [r["server"] for r in K.hottest_assets(latest_per_key(tm), assets, 2).collect()]
    assert got == ["a1", "a2"]


def test_live_status_order(spark):
    rows = [tm_row(T1, 1, cpu="10", status="warning"), tm_row(T1, 2, cpu="5", status="critical"),
            tm_row(T1, 3, cpu="99", status="normal"), tm_row(T1, 4, cpu="20", status="warning")]
    tm, assets = frames(spark, rows, [asset_row(i, f"a{i}") for i in range(1, 5)])
    got = [r["server"] for r in K.live_status(latest_per_key(tm), assets).collect()]
    assert got == ["a2", "a4", "a1", "a3"]


def test_time_range_inclusive(spark):
    tm, _ = frames(spark, [tm_row(T0, 1), tm_row(T1, 1)], [])
    assert time_range(tm, "2024-01-30 22:00:00", "2024-01-30 23:00:00").count() == 2
    assert time_range(tm, "2024-01-30 22:00:01", None).count() == 1


def test_bucket_sum_and_per_snapshot(spark):
    t = dt.datetime(2024, 1, 1, 0, 1)
    rows = [tm_row(t, 1, power="100"), tm_row(t, 2, power="100"),
            tm_row(t + dt.timedelta(minutes=2), 1, power="300"), tm_row(t + dt.timedelta(minutes=2), 2, power="300")]
    tm, assets = frames(spark, rows, [asset_row(1, "a1"), asset_row(2, "a2")])
    s = TS.bucket_metric(tm, assets, "Power Draw", "power_w", "sum", 1).collect()
    assert [(str(r["time"]), r["value"]) for r in s] == [("2024-01-01 00:00:00", 800.0)]
    p = TS.per_snapshot_bucket(tm, "power_w", 1).collect()
    assert p[0]["value"] == 400.0


def test_bucket_large_dimension_path(spark, monkeypatch):
    """The shuffle path (assets too large to broadcast) gives the same result."""
    from sitewatt.operators import timeseries
    rows = [tm_row(T0, 1, cpu="10"), tm_row(T0, 2, cpu="21"), tm_row(T1, 1, cpu="30")]
    tm, assets = frames(spark, rows, [asset_row(1, "a1"), asset_row(2, "a2")])
    small = sorted(tuple(r) for r in TS.bucket_metric(tm, assets, "c", "cpu_usage", "avg", 2).collect())
    monkeypatch.setattr(timeseries, "fits_broadcast", lambda df, *a, **k: False)
    large = sorted(tuple(r) for r in TS.bucket_metric(tm, assets, "c", "cpu_usage", "avg", 2).collect())
    assert small == large and small[0][2] == 15.5


def test_forecast_fallbacks(spark):
    now = "2024-01-30 23:00:00"
    tm, assets = frames(spark, [], [asset_row(1, "a1")])
    assert TS.forecast(tm, assets, now).collect()[0]["value"] == 0.0
    tm, _ = frames(spark, [tm_row(T1, 1, power="400")], [])
    assert TS.forecast(tm, assets, now).collect()[0]["value"] == 400.0
    tm, _ = frames(spark, [tm_row(T1 - dt.timedelta(minutes=20), 1, power="300"), tm_row(T1, 1, power="400")], [])
    assert TS.forecast(tm, assets, now).collect()[0]["value"] == 500.0


def test_last_not_null(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 7.0), (4, None)], "ts int, v double")
    assert last_not_null(df, "v").collect()[0]["v"] == 7.0


def test_bands(spark):
    df = spark.createDataFrame([(2499.9,), (2500.0,), (3200.0,), (None,)], "v double")
    got = [r["c"] for r in df.select(band("v", "rack_power_w").alias("c")).collect()]
    assert got == ["green", "yellow", "red", "green"]
    df = spark.createDataFrame([(0.3,), (0.4,), (0.6,)], "v double")
    assert [r["c"] for r in df.select(band("v", "ref").alias("c")).collect()] == ["red", "yellow", "green"]


def test_rack_power_sums_to_site_power(spark):
    from conftest import SF_SMALL
    from sitewatt.plans.catalog import QUERIES
    racks = sum(r["value"] for r in QUERIES["rack_power"](spark, SF_SMALL).collect())
    site = QUERIES["site_power"](spark, SF_SMALL).collect()[0]["value"]
    assert abs(racks - site) < 1e-6 * max(1.0, site) + 0.05 * 25


def test_critical_status_implies_critical_alert(spark):
    from conftest import SF_CHECK
    from sitewatt.plans.catalog import Ctx
    c = Ctx(spark, SF_CHECK)
    crit = {r["asset_id"] for r in c.latest.where(F.col("status_level") == "critical").collect()}
    alerted = {r["asset_id"] for r in c.alerts.where(F.col("severity") == "critical").collect()}
    assert crit and crit <= alerted


def test_latest_plans_agree_on_ties_and_null_keys(spark):
    rows = [(1, 1, "x"), (1, 1, "y"), (None, 2, "z"), (None, 1, "w"), (3, None, "n"), (4, 5, None), (4, None, "m")]
    df = spark.createDataFrame(rows, "asset_id long, ts int, v string")
    got = [sorted((tuple(r) for r in latest_per_key(df, method=m).collect()), key=repr) for m in ("max_by", "semi")]
    assert got[0] == got[1] == sorted([(1, 1, "y"), (None, 2, "z"), (3, None, "n"), (4, 5, None)], key=repr)


def test_unknown_model_uses_default_coefficients(spark):
    from decimal import Decimal
    from sitewatt.operators.models import predict_power
    tm, _ = frames(spark, [tm_row(T1, 1, cpu="50", power="400", inlet="22", outlet="30")], [])
    got = {m: predict_power(tm, m).first()["predicted_power_w"] for m in ["No Such Model", "XGBoost", "LSTM"]}
    default = Decimal("400") * Decimal("0.998") + Decimal("50") * Decimal("0.84") + Decimal("8") * Decimal("1.35") \
        + (Decimal("22") - Decimal("1.6")) * Decimal("0.48")
    assert got["No Such Model"] == got["XGBoost"] == default
    assert got["LSTM"] != default


def test_single_asset_single_row(spark):
    tm, assets = frames(spark, [tm_row(T1, 1, cpu="91.25")], [asset_row(1, "only")])
    lat = latest_per_key(tm)
    assert R.rack_rollup(lat, assets).first()["avg_cpu_usage"] == 91.25
    feed = A.alert_feed(A.active_alerts(lat, assets)).collect()
    assert [r["message"] for r in feed] == ["only CPU at 91.3%"]
