"""Property tests: alert rules and status levels against a plain-Python brute
force on random latest states (hypothesis)."""

import datetime as dt
from decimal import Decimal as D

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from frames import asset_row, frames, tm_row

from sitewatt.functions.bands import band_by_metric
from sitewatt.functions.scalar import status_level
from sitewatt.operators.alerts import active_alerts
from sitewatt.operators.latest import latest_per_key

T = dt.datetime(2024, 1, 30, 23, 0)

row = st.tuples(
    st.integers(min_value=0, max_value=10000),     # cpu in hundredths
    st.integers(min_value=2000, max_value=4000),   # outlet in hundredths
    st.integers(min_value=30000, max_value=70000),  # power in hundredths
    st.sampled_from([400, 500, 600]),               # nominal W
    st.sampled_from(["running", "maintenance", "standby"]),
)


def brute_alerts(rows):
    out = set()
    for i, (cpu, outlet, power, nominal, state) in enumerate(rows, start=1):
        cpu, outlet, power = D(cpu) / 100, D(outlet) / 100, D(power) / 100
        if cpu >= 90:
            out.add((i, "CPU saturation", "critical"))
        if outlet >= 34:
            out.add((i, "Thermal envelope", "critical" if outlet >= 36 else "warning"))
        if power >= nominal * D("1.08"):
            out.add((i, "Power spike", "critical" if power >= nominal * D("1.18") else "warning"))
        if state in ("maintenance", "standby"):
            out.add((i, "Operational state", "warning"))
    return out


def brute_status(cpu, outlet, power, nominal, state):
    cpu, outlet, power = D(cpu) / 100, D(outlet) / 100, D(power) / 100
    if cpu >= 90 or outlet >= 36 or power >= nominal * D("1.18"):
        return "critical"
    if cpu >= 75 or outlet >= 34 or power >= nominal * D("1.08") or state != "running":
        return "warning"
    return "normal"


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(row, min_size=1, max_size=12))
def test_alerts_equal_brute_force(spark, rows):
    tms = [tm_row(T, i, cpu=str(D(c) / 100), outlet=str(D(o) / 100), power=str(D(p) / 100), state=s)
           for i, (c, o, p, n, s) in enumerate(rows, start=1)]
    assets = [asset_row(i, f"a{i}", nominal=str(n)) for i, (_, _, _, n, _) in enumerate(rows, start=1)]
    tm, a = frames(spark, tms, assets)
    got = {(r["asset_id"], r["rule_name"], r["severity"]) for r in active_alerts(latest_per_key(tm), a).collect()}
    assert got == brute_alerts(rows)
    j = tm.join(a.select("asset_id", "nominal_power_w"), "asset_id")
    st_got = {r["asset_id"]: r["s"] for r in j.select(
        "asset_id", status_level("cpu_usage", "outlet_temp_c", "power_w", "nominal_power_w",
                                 "operational_state").alias("s")).collect()}
    assert st_got == {i: brute_status(*r) for i, r in enumerate(rows, start=1)}


def test_band_by_metric(spark):
    df = spark.createDataFrame([("pue", 1.4), ("ref", 0.6), ("other", 1.0)], "metric string, value double")
    got = [r["c"] for r in df.select(band_by_metric("metric", "value").alias("c")).collect()]
    assert got == ["yellow", "green", None]
