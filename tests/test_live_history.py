"""Live episodes and chained windows equal their batch forms; one de-duplication state serves all live tables."""

import json
import os
import random

from frames import frames, tm_row
from test_history import ASSETS, at, episode_rows, episodes_plain
from test_streaming import _run, _unique

from conftest import SF_SMALL
from sitewatt.operators.episodes import alert_episodes
from sitewatt.operators.timeseries import bucket_partials
from sitewatt.plans.catalog import Ctx
from sitewatt.streaming import episodes as E
from sitewatt.streaming import live as L


def _files(spark, scratch, batches):
    """One file a batch, oldest first, and a stream that takes a file at a time."""
    path = os.path.join(scratch, "tm")
    for k, rows in enumerate(batches):
        tm, _ = frames(spark, rows, [])
        tm.coalesce(1).write.mode("append").parquet(path)
        for name in os.listdir(path):
            f = os.path.join(path, name)
            if name.endswith(".parquet") and os.path.getmtime(f) > 1e9:
                os.utime(f, (1e8 + k * 10, 1e8 + k * 10))
    return L.stream_telemetry(spark, path, spark.read.parquet(path).schema, max_files_per_trigger=1)


def _plain(df):
    return sorted((a, r, s.replace(tzinfo=None), e.replace(tzinfo=None), n, p, x) for a, r, s, e, n, p, x in map(tuple, df.collect()))


def test_episode_stream_equals_batch(spark, scratch):
    rows = episode_rows(150, 0.6, 1500)
    random.Random(1).shuffle(rows)                                   # out of order inside a batch
    rows.sort(key=lambda x: (x[0] - at(0)).total_seconds() // 30000)
    closing = [tm_row(at(2000), a, cpu="10", outlet="20") for a in (1, 2)]   # clears what is open
    far = [tm_row(at(90_000), 9)]                                        # moves the watermark on
    s = _files(spark, scratch, [rows[:60], rows[60:110], rows[110:] + closing, far])
    tm, assets = frames(spark, rows + closing, ASSETS)
    got = _plain(_run(E.episode_stream(s, assets, "20 hours", 600 * 60), "episodes_t"))
    assert got == _plain(alert_episodes(tm, assets, 600 * 60)) == episodes_plain(rows + closing, 600 * 60)


def test_episode_timer_clears_without_a_sample(spark, scratch):
    s = _files(spark, scratch, [[tm_row(at(0), 1, cpu="95"), tm_row(at(5), 1, cpu="97")], [tm_row(at(500), 2)], [tm_row(at(900), 2)]])
    _, assets = frames(spark, [], ASSETS)
    got = _plain(_run(E.episode_stream(s, assets, "1 minute", 3600), "timer_t"))
    assert got == [(1, "CPU saturation", at(0), at(5), 2, 97.0, "critical")]


def test_take_waits_for_the_watermark():
    held = {"waiting": [[20, [{"rule_name": "r", "value": 1.0, "critical": False}]], [10, [{"rule_name": "r", "value": 3.0, "critical": False}]]],
            "open": {}, "last": None}
    assert E.take(held, 15, 100) == [] and held["last"] == 10 and len(held["waiting"]) == 1
    held = json.loads(json.dumps(held))
    held["waiting"].append([30, []])
    assert E.take(held, 40, 100) == [("r", 10, 20, 2, 3.0, "warning")]


def test_chained_windows_equal_batch(spark, scratch):
    r = random.Random(2)
    rows = [tm_row(at(r.randrange(0, 3 * 1440)), r.choice([1, 1, 1, 2]), power=str(r.randrange(300))) for _ in range(300)]
    rows.sort()
    far = [tm_row(at(9 * 1440), 7)]
    s = _files(spark, scratch, [rows[:100], rows[100:200], rows[200:], far])
    tm, _ = frames(spark, rows, [])
    widths = ("5 minutes", "1 hour", "1 day")
    cols = ["asset_id", "sum_power_w", "n_power_w", "max_power_w", "min_power_w"]
    for k in range(3):
        out = _run(L.rollup_chain(s, widths[:k + 1], "1 minute", measures=["power_w"]), "chain_t")
        got = sorted((x["time"].replace(tzinfo=None), *(x[c] for c in cols)) for x in out.where("asset_id <> 7").collect())
        want = sorted((x["time"], *(x[c] for c in cols)) for x in bucket_partials(tm, widths[k], ["power_w"]).collect())
        assert got == want, widths[k]


def _live(spark, scratch, path, name, out):
    c = Ctx(spark, SF_SMALL)
    s = L.stream_telemetry(spark, path, spark.read.parquet(path).schema)
    return L.start_live_loop(s, c.assets, out, delay="1 hour", trigger={"availableNow": True}, name=name), c


def test_one_deduplication_state_and_exact_replay(spark, scratch):
    c = Ctx(spark, SF_SMALL)
    raw = c.tm.select(*L.RAW_COLUMNS)
    path, out, name = os.path.join(scratch, "raw"), os.path.join(scratch, "live"), _unique("loop")
    raw.unionByName(raw.limit(50)).repartition(3).write.parquet(path)
    got, _ = _live(spark, scratch, path, name, out)
    queries = [k for k, q in got.items() if hasattr(q, "awaitTermination")]
    for k in queries:
        got[k].awaitTermination()
    dedup = [k for k in queries if "dropduplicates" in json.dumps(got[k].lastProgress["stateOperators"], default=str).lower()
             or any("dedup" in o["operatorName"].lower() for o in got[k].lastProgress["stateOperators"])]
    assert dedup == ["ingest"]
    rows = {t: L.read_store(spark, out, t).count() for t in (L.FACTS, L.KPIS, L.ROLLUP, *L.ROLLUP_LEVELS)}
    assert rows[L.FACTS] == raw.count()
    # the run is started again after a crash of one follower: its last epoch is not committed any more
    from sitewatt.session import checkpoint_dir
    for follower in ("kpi", "rollup"):
        commits = os.path.join(checkpoint_dir(spark).removeprefix("file://"), f"{name}_{follower}", "commits")
        last = max(int(f) for f in os.listdir(commits) if f.isdigit())
        os.remove(os.path.join(commits, str(last)))
        if os.path.exists(os.path.join(commits, f".{last}.crc")):
            os.remove(os.path.join(commits, f".{last}.crc"))
    again, _ = _live(spark, scratch, path, name, out)
    for k in queries:
        again[k].awaitTermination()
    assert {t: L.read_store(spark, out, t).count() for t in rows} == rows
    hours = L.read_store(spark, out, "bucket_rollup_1h").select("time", "asset_id", "sum_power_w", "n_power_w")
    batch = bucket_partials(L.read_store(spark, out).drop("dt"), "1 hour").select("time", "asset_id", "sum_power_w", "n_power_w")
    want = {(r[0], r[1]): (r[2], r[3]) for r in batch.collect()}
    mine = {(r[0], r[1]): (r[2], r[3]) for r in hours.collect()}
    assert mine and all(want[k] == v for k, v in mine.items()) and len(mine) >= len(want) - 50


