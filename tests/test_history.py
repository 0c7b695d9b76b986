"""As-of joins, range aggregates, backtests, episodes and grouped tops against plain loops; hot keys; plans."""

import datetime as dt
import random

import pytest
from frames import AS, TM, asset_row, frames, tm_row
from pyspark.sql import functions as F

from conftest import SF_SMALL
from sitewatt.operators import rollups as R
from sitewatt.operators import topk as K
from sitewatt.operators.asof import asof_join
from sitewatt.operators.episodes import alert_episodes
from sitewatt.operators.latest import latest_per_key
from sitewatt.operators.moving import forecast_backtest
from sitewatt.operators.ranges import prefix_sums, range_means, range_sums
from sitewatt.plans.catalog import QUERIES, Ctx

DAY0 = dt.datetime(2024, 1, 1)


def plan_of(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def at(minutes):
    return DAY0 + dt.timedelta(minutes=minutes)


@pytest.mark.parametrize("hot", [0.0, 0.9])
def test_asof_join_equals_scan(spark, hot):
    r = random.Random(4)
    key = lambda: 1 if r.random() < hot else r.choice([2, 3, 4, None])
    samples = [(key(), at(r.randrange(0, 6 * 1440)), i) for i in range(300)]
    samples += [(1, None, 999), (2, at(100), 5), (2, at(100), 7)]  # a tie: the largest columns win
    asked = [(i, key(), at(r.randrange(-1440, 9 * 1440))) for i in range(200)] + [(900, 9, at(5)), (901, 1, None), (902, 2, at(100))] * 2
    s = spark.createDataFrame(samples, "k int, ts timestamp_ntz, v int")
    q = spark.createDataFrame(asked, "id int, k int, as_of timestamp_ntz")
    got = sorted(map(tuple, asof_join(q, s, ["k"]).select("id", "ts", "v").collect()), key=str)
    want = []
    for i, k, t in asked:
        known = [(ts, v) for kk, ts, v in samples if kk is not None and kk == k and ts is not None and t is not None and ts <= t]
        want.append((i, *(max(known) if known else (None, None))))
    assert got == sorted(want, key=str)


def test_asof_splits_a_hot_key_and_refuses_clashes(spark):
    s = spark.range(4000).select(F.lit(1).alias("k"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 600).cast("timestamp_ntz").alias("ts"),
                                 F.col("id").alias("v"))
    q = s.select("k", F.col("ts").alias("as_of"), F.col("v").alias("w"))
    out = asof_join(q, s, ["k"])
    assert out.where("v = w").count() == 4000
    assert "k#" in plan_of(out) and plan_of(out).count("_slab") > 2  # grouped by key and slab
    with pytest.raises(ValueError, match="both sides"):
        asof_join(s.withColumn("as_of", F.col("ts")), s, ["k"])


def test_latest_as_of(spark):
    tm, _ = frames(spark, [tm_row(at(1), 1, cpu="1"), tm_row(at(5), 1, cpu="5"), tm_row(at(9), 1, cpu="9"), tm_row(at(9), 2)], [])
    for method in ("max_by", "semi"):
        got = latest_per_key(tm, method=method, as_of=at(6).isoformat(sep=" ")).collect()
        assert [(r["asset_id"], int(r["cpu_usage"])) for r in got] == [(1, 5)]


def test_range_sums_equal_scans(spark):
    r = random.Random(6)
    rows = [(at(r.choice([0, 3, 3 * 1440, r.randrange(0, 5 * 1440)])), r.choice([None, r.randrange(100)]), r.random() * 9) for _ in range(400)]
    facts = spark.createDataFrame(rows + [(None, 5, 1.0)], "ts timestamp_ntz, a int, b double").withColumn("b", F.col("b").cast("decimal(18,2)"))
    prefix = prefix_sums(facts, ["a", "b"])
    ranges = [(at(x), at(y)) for x, y in ((0, 0), (0, 3), (1, 2), (-5, 99999), (99999, 999999), (-90, -50), (4000, 100), (0, 3 * 1440))]
    ranges += [(at(x), at(x + r.randrange(0, 4000))) for x in (r.randrange(-100, 8000) for _ in range(60))]
    q = spark.createDataFrame(ranges + ranges[:3] + [(None, at(1))], "start timestamp_ntz, end timestamp_ntz")
    out = range_sums(prefix, q)
    got = {(x["start"], x["end"]): x for x in out.select("start", "end", "n", "sum_a", "n_a", "sum_b", *range_means(out, {"mean": "a"})).collect()}
    kept = [tuple(x) for x in facts.where("ts is not null").collect()]
    assert set(got) == set(ranges)
    for lo, hi in ranges:
        own = [x for x in kept if lo <= x[0] <= hi]
        a = [x[1] for x in own if x[1] is not None]
        row = got[lo, hi]
        assert (row["n"], row["sum_a"], row["n_a"], row["sum_b"]) == (len(own), sum(a), len(a), sum((x[2] for x in own), 0))
        assert row["mean"] == (sum(a) / len(a) if a else None)
    assert range_sums(prefix_sums(facts.limit(0), ["a"]), q).where("n <> 0").count() == 0


def test_range_query_reads_prefix_not_facts(spark):
    plan = plan_of(QUERIES["range_metrics"](spark, SF_SMALL))
    assert "telemetry_prefix" in plan and "telemetry_metrics" not in plan


@pytest.mark.parametrize("slab", [86_400, 7_200])
def test_backtest_equals_loops(spark, slab):
    r = random.Random(8)
    h = 3600
    rows = sorted({(r.choice("ab"), 300 * r.randrange(0, 900)): (r.randrange(1000), r.randrange(1, 5)) for _ in range(500)}.items())
    df = spark.createDataFrame([(k, DAY0 + dt.timedelta(seconds=s), *v) for (k, s), v in rows], "k string, time timestamp_ntz, total int, n int")
    got = {(x["k"], x["time"]): x for x in forecast_backtest(df, ["k"], h, slab_seconds=slab).collect()}
    assert len(got) == len(rows)
    for (k, s), _ in rows:
        def mean(lo, hi):
            own = [v for (kk, t), v in rows if kk == k and lo <= t < hi]  # noqa: B023
            return sum(v[0] for v in own) / sum(v[1] for v in own) if own else None
        cur, prev, actual = mean(s - h, s), mean(s - 2 * h, s - h), mean(s, s + h)
        want = 0 if cur is None else cur if prev is None else cur + (cur - prev)
        x = got[k, DAY0 + dt.timedelta(seconds=s)]
        assert (x["current_avg"], x["previous_avg"], x["actual"], x["forecast"]) == (cur, prev, actual, want)


ASSETS = [asset_row(i, f"a{i}", nominal="500") for i in (1, 2)]


def episodes_plain(rows, gap):
    out = []
    for asset in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == asset), key=lambda r: r[0])
        opened, last = {}, None
        for x in own:
            fired = {}
            if x[2] >= 90:
                fired["CPU saturation"] = (float(x[2]), True)
            if x[5] >= 34:
                fired["Thermal envelope"] = (float(x[5]), x[5] >= 36)
            if x[9] in ("maintenance", "standby"):
                fired["Operational state"] = (1.0, False)
            late = last is not None and (x[0] - last).total_seconds() > gap
            for rule in [k for k in opened if late or k not in fired]:
                out.append((asset, rule, *opened.pop(rule)))
            for rule, (v, crit) in fired.items():
                s, _, n, peak, c = opened.get(rule, (x[0], x[0], 0, v, False))
                opened[rule] = (s, x[0], n + 1, max(peak, v), c or crit)
            last = x[0]
        out += [(asset, rule, *e) for rule, e in opened.items()]
    return sorted((a, r, s, e, n, p, "critical" if c else "warning") for a, r, s, e, n, p, c in out)


def episode_rows(n=400, hot=0.8, step=3000, seed=3):
    r = random.Random(seed)
    times = sorted(r.sample(range(step), n))
    return [tm_row(at(t), 1 if r.random() < hot else 2, cpu=str(r.choice([95, 95, 99, 10])), outlet=str(r.choice([30, 35, 37])),
                   state=r.choice(["running", "running", "standby"])) for t in times]


@pytest.mark.parametrize("slab,gap", [(86_400, 2 * 86_400), (3600, 1200), (600, 100_000)])
def test_episodes_equal_loops(spark, slab, gap):
    rows = episode_rows()
    tm, assets = frames(spark, rows, ASSETS)
    got = sorted(map(tuple, alert_episodes(tm, assets, gap, slab).collect()))
    assert got == episodes_plain(rows, gap)
    assert alert_episodes(tm.limit(0), assets).count() == 0


def test_rollup_levels_equal_the_three_queries(spark):
    c = Ctx(spark, SF_SMALL)
    allv = R.rollup_all_levels(c.latest, c.assets)
    rows = {lv: allv.where(F.col("level") == lv) for lv in R.LEVELS}
    rack = R.rack_rollup(c.latest, c.assets).withColumnsRenamed({"rack_power_w": "power_w", "rack_carbon_kg": "carbon_kg"})
    room = R.room_rollup(c.latest, c.assets).withColumnsRenamed({"room_power_w": "power_w", "room_carbon_kg": "carbon_kg"})
    site = R.site_summary(c.latest).withColumnsRenamed({"current_power_w": "power_w", "current_carbon_kg": "carbon_kg"})
    for lv, want in (("rack", rack), ("room", room), ("site", site)):
        assert sorted(map(tuple, rows[lv].select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    plan = plan_of(R.rollup_all_levels(spark.createDataFrame([], TM), spark.createDataFrame([], AS)))
    assert plan.split("\n\n")[0].count("Expand") == 1


def test_top_per_group_limits_before_the_exchange(spark):
    rows = [tm_row(at(1), i, power=str(i % 7)) for i in range(300)]
    tm, assets = frames(spark, rows, [asset_row(i, f"a{i}", rack="K1" if i % 3 else "K2") for i in range(300)])
    out = K.top_per_group(tm, assets, "rack_name", "power_w", 4, K.POWER_SPEC)
    got = sorted((r["rack_name"], r["rank"], r["server"]) for r in out.collect())
    want = []
    for rack in ("K1", "K2"):
        own = sorted((i for i in range(300) if ("K1" if i % 3 else "K2") == rack), key=lambda i: (-(i % 7), i))[:4]
        want += [(rack, k + 1, f"a{i}") for k, i in enumerate(own)]
    assert got == want
    tree = plan_of(out).split("\n\n")[0]
    assert tree.count("WindowGroupLimit") >= 2


def test_ranged_trend_prunes_dates(spark):
    plan = plan_of(QUERIES["power_trend_6h"](spark, SF_SMALL))
    assert "PartitionFilters: [isnotnull(dt" in plan and "dt#" in plan.split("PartitionFilters:")[1]
