"""Live alert episodes: raised by a firing sample, cleared by the next one that does not fire
or by a timer (STR-4 as states). Equal to ``operators.episodes.alert_episodes`` below the
watermark, whatever order samples arrive in.

State per asset: the samples the watermark has not passed yet, the open episodes and the
newest sample taken. Samples are taken in the order of their time once the watermark has
passed them; an episode is emitted when it ends. An event-time timer wakes an asset that
sends nothing more: for samples still waiting, and to clear episodes after ``max_gap``.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from sitewatt.operators.episodes import MAX_GAP, fired_rules

EPISODES = "asset_id long, rule_name string, start timestamp, end timestamp, samples long, peak double, severity string"
COLUMNS = ["asset_id", "rule_name", "start", "end", "samples", "peak", "severity"]


def take(held: dict, watermark: int, max_gap: int) -> list[tuple]:
    """Move ``held`` (waiting, open, last; times in microseconds) up to ``watermark``; the episodes that ended."""
    ended = []

    def end(rule):
        start, last, n, peak, critical = held["open"].pop(rule)
        ended.append((rule, start, last, n, peak, "critical" if critical else "warning"))

    held["waiting"].sort(key=lambda x: x[0])
    while held["waiting"] and held["waiting"][0][0] <= watermark:
        ts, fired = held["waiting"].pop(0)
        now = {f["rule_name"]: f for f in fired}
        late = held["last"] is not None and ts - held["last"] > max_gap * 1_000_000
        for rule in [r for r in held["open"] if late or r not in now]:
            end(rule)
        for rule, f in now.items():
            start, _, n, peak, critical = held["open"].get(rule, (ts, ts, 0, f["value"], False))
            held["open"][rule] = (start, ts, n + 1, max(peak, f["value"]), critical or f["critical"])
        held["last"] = ts
    if held["last"] is not None and not held["waiting"] and watermark - held["last"] > max_gap * 1_000_000:
        for rule in list(held["open"]):
            end(rule)
    return ended


def _step(max_gap: int):
    def step(key, frames, state):
        held = json.loads(state.get[0]) if state.exists else {"waiting": [], "open": {}, "last": None}
        if not state.hasTimedOut:
            for rows in frames:
                held["waiting"] += [[t, json.loads(f)] for t, f in zip(rows["us"].tolist(), rows["fired"])]
        watermark = state.getCurrentWatermarkMs()
        ended = take(held, watermark * 1000, max_gap)
        state.update((json.dumps(held),))
        if held["waiting"]:
            state.setTimeoutTimestamp(max(watermark, held["waiting"][0][0] // 1000) + 1)
        elif held["open"]:
            state.setTimeoutTimestamp(max(watermark, held["last"] // 1000 + max_gap * 1000) + 1)
        out = pd.DataFrame([(key[0], *e) for e in ended], columns=COLUMNS)
        yield out.assign(start=pd.to_datetime(out["start"].astype("int64"), unit="us"), end=pd.to_datetime(out["end"].astype("int64"), unit="us"))
    return step


def episode_stream(stream: DataFrame, assets: DataFrame, delay: str = "1 hour", max_gap: int = MAX_GAP) -> DataFrame:
    """Ended episodes in append mode. ``stream`` holds each sample once (see ``dedup_stream``)."""
    rows = fired_rules(stream.where("asset_id is not null and ts is not null").withColumn("ts", F.col("ts").cast("timestamp"))
                       .withWatermark("ts", delay), assets)
    rows = rows.select("asset_id", "ts", F.unix_micros("ts").alias("us"), F.to_json("fired").alias("fired"))
    return rows.groupBy("asset_id").applyInPandasWithState(
        _step(max_gap), EPISODES, "held string", "append", GroupStateTimeout.EventTimeTimeout)
