"""One asset holding a third of all rows: results stay whole and exact."""

import datetime as dt
from decimal import Decimal as D

from frames import asset_row, frames, tm_row

from sitewatt.operators import timeseries as TS
from sitewatt.operators.kpi import kpi_snapshots
from sitewatt.operators.latest import latest_per_key
from sitewatt.operators.quality import check_fk
from sitewatt.operators.sinks import first_wins

BASE = dt.datetime(2024, 1, 1)


def _skewed(spark, n=3000):
    rows = []
    for i in range(n):
        asset = 1 if i % 3 == 0 else 2 + i % 50          # asset 1 holds a third of the rows
        rows.append(tm_row(BASE + dt.timedelta(minutes=i), asset, cpu=str(i % 100), power=str(100 + i % 7)))
    return rows


def test_hot_asset_latest_and_buckets(spark, monkeypatch):
    rows = _skewed(spark)
    tm, assets = frames(spark, rows, [asset_row(i, f"a{i}") for i in range(1, 52)])
    tm = tm.repartition(8)
    latest = {r["asset_id"]: r["ts"] for r in latest_per_key(tm).collect()}
    want = {}
    for r in rows:
        want[r[1]] = max(want.get(r[1], r[0]), r[0])
    assert latest == want
    # per-hour power sums, broadcast path and pre-aggregated shuffle path
    exp = {}
    for r in rows:
        h = r[0].replace(minute=0)
        exp[h] = exp.get(h, D(0)) + r[3]
    got = {r["time"]: r["value"] for r in TS.bucket_metric(tm, assets, "p", "power_w", "sum", 1, width="1 hour").collect()}
    assert got == {k: float(v) for k, v in exp.items()}
    from sitewatt.operators import timeseries
    monkeypatch.setattr(timeseries, "fits_broadcast", lambda df, *a, **k: False)
    got2 = {r["time"]: r["value"] for r in TS.bucket_metric(tm, assets, "p", "power_w", "sum", 1, width="1 hour").collect()}
    assert got2 == got


def test_group_of_copies(spark):
    # a third of all rows are copies of one key; first-wins keeps exactly one of them
    rows = [(1, 1, i) for i in range(1000)] + [(k, 2, k) for k in range(2, 2002)]
    df = spark.createDataFrame(rows, "k long, v long, o long").repartition(8)
    out = first_wins(df, ["k"], "o")
    assert out.count() == 2001
    assert out.where("k = 1").first()["o"] == 0


def test_hot_timestamp_kpi_and_orphans(spark):
    t = BASE
    rows = [tm_row(t, i, power="100") for i in range(1, 2001)] + [tm_row(t + dt.timedelta(hours=1), 1)]
    tm, assets = frames(spark, rows, [asset_row(i, f"a{i}") for i in range(1, 1001)])
    k = {r["ts"]: r["it_power_w"] for r in kpi_snapshots(tm.repartition(8)).collect()}
    assert k[t] == D("200000.00")
    orphans = check_fk(tm.repartition(8), assets, ["asset_id"])
    assert orphans.count() == 1000
