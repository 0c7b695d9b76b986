"""Time-bucketed trends, multi-metric series, forecast (TS-1..5).

Scoped trends restrict the fact to the scoped assets. When the scoped asset set
is proven small it is broadcast into a semi join, so the fact is never
shuffled and only per-bucket partial aggregates cross the network. Otherwise
the fact is first reduced to ``(bucket, asset)`` partials (map-side combine),
those are joined to the assets by a shuffle join, and the partials combined per
bucket; sums, counts and maxima combine exactly.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewatt.operators.alerts import as_of_column
from sitewatt.operators.filters import ALL, time_range
from sitewatt.operators.joins import checked_broadcast, fits_broadcast
from sitewatt.operators.rollups import scoped_assets


# ---------------------------------------------------------------------------
# Series of the trend panels, (metric label, column, aggregate,
# digits), in panel order.
SERIES = {
    "power_draw": ("Power Draw", "power_w", "sum", 1),
    "average_cpu": ("Average CPU", "cpu_usage", "avg", 1),
    "inlet_temp": ("Inlet Temp", "inlet_temp_c", "avg", 1),
    "outlet_temp": ("Outlet Temp", "outlet_temp_c", "avg", 1),
    "observed_power": ("Observed Power", "power_w", "sum", 1),
    "cpu_percent": ("CPU %", "cpu_usage", "avg", 1),
    "co2_estimate": ("CO2 Estimate", "carbon_kg", "sum", 3),
    "emission_factor": ("Emission Factor", "emission_factor_kg_per_kwh", "avg", 3),
    "pue": ("PUE", "pue", "avg", 3),
    "co2_emissions": ("CO2 Emissions", "total_co2_kg", "avg", 3),
    "ref": ("REF", "ref", "avg", 3),
    "co2_savings": ("CO2 Savings", "co2_savings_kg", "avg", 3),
}
# ---------------------------------------------------------------------------


def series(*names: str) -> list[tuple[str, str, str, int]]:
    """Series specs by name, e.g. ``series("inlet_temp", "outlet_temp")``."""
    return [SERIES[n] for n in names]


def bucket_start(ts, width: str = "5 minutes") -> Column:
    """Epoch-aligned tumbling bucket start (same type as ``ts``)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.window(c, width).start


def _mean(total: Column, count: Column) -> Column:
    """Exact mean, the same digits on every path: ``total`` must have the type of a direct
    sum (a sum of partial sums is wider, and its quotient would keep fewer digits)."""
    return F.try_divide(total, count.cast("decimal(20,0)"))


def _partials(fn: str, col: str, i: int) -> list[Column]:
    c = F.col(col)
    if fn == "sum":
        return [F.sum(c).alias(f"s{i}")]
    if fn == "avg":
        return [F.sum(c).alias(f"s{i}"), F.count(c).alias(f"n{i}")]
    if fn == "max":
        return [F.max(c).alias(f"x{i}")]
    if fn == "min":
        return [F.min(c).alias(f"x{i}")]
    raise ValueError(fn)


def _combine(fn: str, i: int, kind) -> Column:
    """``kind``: type of the partial sums, the one a direct sum has."""
    if fn == "sum":
        return F.sum(f"s{i}")
    if fn == "avg":
        return _mean(F.sum(f"s{i}").cast(kind), F.sum(f"n{i}"))
    if fn == "max":
        return F.max(f"x{i}")
    return F.min(f"x{i}")


def _direct(fn: str, col: str) -> Column:
    c = F.col(col)
    if fn == "avg":
        return _mean(F.sum(c), F.count(c))
    return {"sum": F.sum, "max": F.max, "min": F.min}[fn](c)


def scoped_group_agg(facts: DataFrame, assets: DataFrame | None, group: dict[str, Column],
                     specs: list[tuple[str, str, str]], room: str = ALL, rack: str = ALL,
                     server: str | None = ALL) -> DataFrame:
    """``facts JOIN scoped assets USING (asset_id) GROUP BY group`` computing
    ``specs`` = [(name, column, fn)], without shuffling the raw fact.

    ``assets=None`` skips the join (site-wide panels that never join)."""
    keyed = facts.select(*[e.alias(n) for n, e in group.items()], "asset_id",
                         *sorted({c for _, c, _ in specs}))
    gnames = list(group)
    if assets is None:
        return keyed.groupBy(*gnames).agg(*[_direct(fn, c).alias(n) for n, c, fn in specs])
    ids = scoped_assets(assets, room, rack, server, ("asset_id", "asset_name", "room_name", "rack_name")) \
        .select("asset_id")
    if fits_broadcast(ids):
        kept = keyed.join(F.broadcast(ids), "asset_id", "left_semi")
        return kept.groupBy(*gnames).agg(*[_direct(fn, c).alias(n) for n, c, fn in specs])
    parts = keyed.groupBy(*gnames, "asset_id").agg(
        *[p for i, (_, c, fn) in enumerate(specs) for p in _partials(fn, c, i)])
    kept = parts.join(ids, "asset_id", "left_semi")
    return kept.groupBy(*gnames).agg(*[
        _combine(fn, i, parts.schema[f"s{i}"].dataType if fn == "avg" else None).alias(n) for i, (n, _, fn) in enumerate(specs)])


def bucket_series(tm: DataFrame, assets: DataFrame | None, series: list[tuple[str, str, str, int]],
                  width: str = "5 minutes", start=None, end=None, room: str = ALL, rack: str = ALL,
                  server: str | None = ALL, ts: str = "ts", partition_col: str | None = None) -> DataFrame:
    """Long ``time, metric, value`` series: one aggregate per bucket for all
    ``series`` = [(metric label, column, fn, digits)], then unpivoted (one scan
    instead of one per metric). ``partition_col`` (the date of ``ts``) lets the
    time range skip whole date partitions."""
    df = time_range(tm, start, end, ts, partition_col)
    specs = [(f"v{i}", col, fn) for i, (_, col, fn, _) in enumerate(series)]
    wide = scoped_group_agg(df, assets, {"time": bucket_start(ts, width)}, specs, room, rack, server)
    pairs = [F.struct(F.lit(label).alias("metric"), F.round(F.col(f"v{i}"), d).cast("double").alias("value"))
             for i, (label, _, _, d) in enumerate(series)]
    return wide.select("time", F.inline(F.array(*pairs))).orderBy("time", "metric")


def bucket_metric(tm, assets, label: str, column: str, fn: str, digits: int, **kw) -> DataFrame:
    """One bucketed metric (``time, metric, value``)."""
    return bucket_series(tm, assets, [(label, column, fn, digits)], **kw)


def per_snapshot_bucket(tm: DataFrame, column: str, digits: int, width: str = "5 minutes",
                        start=None, end=None, ts: str = "ts", label: str = "value") -> DataFrame:
    """Physically meaningful power trend: sum per timestamp, then average of the
    snapshot totals per bucket (independent of the sampling rate)."""
    df = time_range(tm, start, end, ts)
    snaps = df.groupBy(ts).agg(F.sum(column).alias("total"))
    mean = _mean(F.sum("total").cast(snaps.schema["total"].dataType), F.count("total"))
    return (snaps.groupBy(bucket_start(ts, width).alias("time"))
            .agg(F.round(mean, digits)
                 .cast("double").alias("value"))
            .select("time", F.lit(label).alias("metric"), "value"))


def to_wide(long_df: DataFrame, metrics: list[str], names: list[str] | None = None,
            time: str = "time") -> DataFrame:
    """``time, metric, value`` -> one column per metric (explicit value list, so
    the pivot needs no extra distinct job)."""
    wide = long_df.groupBy(time).pivot("metric", metrics).agg(F.first("value"))
    if names:
        wide = wide.select(time, *[F.col(f"`{m}`").alias(n) for m, n in zip(metrics, names)])
    return wide


# ---------------------------------------------------------------------------
# Linear power models (power, cpu, outlet-inlet, inlet-1.6
# coefficients); any other model name uses the default row.
MODEL_COEFFICIENTS = {
    "LSTM": ("1.018", "1.85", "2.10", "0.70"),
    "Random Forest": ("1.004", "1.10", "1.60", "0.55"),
    "Extended XGBoost": ("0.995", "0.72", "1.18", "0.42"),
}
DEFAULT_COEFFICIENTS = ("0.998", "0.84", "1.35", "0.48")
INLET_OFFSET = "1.6"
# ---------------------------------------------------------------------------


def predicted_power(model: str) -> Column:
    """Per-row linear model in exact decimal arithmetic; coefficients are chosen
    before planning, so the expression is constant-folded."""
    a, b, c, d = (F.lit(Decimal(x)) for x in MODEL_COEFFICIENTS.get(model, DEFAULT_COEFFICIENTS))
    p, cpu, o, i = F.col("power_w"), F.col("cpu_usage"), F.col("outlet_temp_c"), F.col("inlet_temp_c")
    return p * a + cpu * b + (o - i) * c + (i - F.lit(Decimal(INLET_OFFSET))) * d


def actual_vs_predicted(tm: DataFrame, model: str, width: str = "5 minutes", start=None, end=None,
                        ts: str = "ts", partition_col: str | None = None) -> DataFrame:
    """Site-wide actual and model-predicted power per bucket (no scope, no join)."""
    df = time_range(tm, start, end, ts, partition_col).select(ts, "power_w", predicted_power(model).alias("predicted_w"))
    wide = df.groupBy(bucket_start(ts, width).alias("time")).agg(
        F.sum("power_w").alias("a"), F.sum("predicted_w").alias("p"))
    pairs = [F.struct(F.lit("Actual Power").alias("metric"), F.round("a", 1).cast("double").alias("value")),
             F.struct(F.lit("Predicted Power").alias("metric"), F.round("p", 1).cast("double").alias("value"))]
    return wide.select("time", F.inline(F.array(*pairs))).orderBy("time", "metric")


def forecast(tm: DataFrame, assets: DataFrame | None, as_of=None, horizon: str = "15 minutes",
             room: str = ALL, rack: str = ALL, server: str = ALL, level: str = "asset",
             partition_col: str | None = None) -> DataFrame:
    """Linear extrapolation of two adjacent window means:
    ``cur + (cur - prev)``, falling back to ``cur``, then 0.

    ``cur`` = mean over ``ts >= as_of - horizon``, ``prev`` over
    ``[as_of - 2 horizon, as_of - horizon)``; no upper bound on ``ts``.
    ``level="asset"`` averages per-asset rows (the original panel);
    ``level="site"`` averages per-timestamp site totals instead.
    """
    now = as_of_column(as_of)
    h = F.expr(f"INTERVAL {horizon}")
    t = F.col("ts")
    df = tm.where(t >= now - h - h)
    if partition_col:  # the same bound on the date partition column skips old partitions
        df = df.where(F.col(partition_col) >= F.to_date(now - h - h))
    df = df.select("ts", "asset_id", "power_w")
    cur_w, prev_w = t >= now - h, (t >= now - h - h) & (t < now - h)
    if level == "site":
        df = scoped_group_agg(df, assets, {"ts": t}, [("power_w", "power_w", "sum")], room, rack, server) \
            .withColumn("asset_id", F.lit(None))
        filtered = df
    elif assets is None:
        filtered = df
    else:
        ids = scoped_assets(assets, room, rack, server, ("asset_id", "asset_name", "room_name", "rack_name"))
        ids = ids.select("asset_id")
        filtered = df.join(checked_broadcast(ids), "asset_id", "left_semi")
    p = F.col("power_w")
    agg = filtered.agg(
        F.try_divide(F.sum(F.when(cur_w, p)), F.count(F.when(cur_w, p)).cast("decimal(20,0)")).alias("cur"),
        F.try_divide(F.sum(F.when(prev_w, p)), F.count(F.when(prev_w, p)).cast("decimal(20,0)")).alias("prev"))
    value = F.coalesce(F.col("cur") + (F.col("cur") - F.col("prev")), F.col("cur"), F.lit(0))
    return agg.select(now.alias("time"), F.round(value, 1).cast("double").alias("value"))


# ---------------------------------------------------------------------------
# Bucket rollups: per (bucket, asset) partial aggregates that trend panels can
# combine instead of rescanning raw samples. Sums, counts, maxima and minima
# combine exactly, so every series computed from the rollup equals the one
# computed from the raw facts.
ROLLUP_MEASURES = ["cpu_usage", "power_w", "inlet_temp_c", "outlet_temp_c", "emission_factor_kg_per_kwh",
                   "carbon_kg"]


def bucket_partials(tm: DataFrame, width: str = "5 minutes", measures=None, ts: str = "ts") -> DataFrame:
    """``time, asset_id`` + ``sum_<m>``, ``n_<m>``, ``max_<m>``, ``min_<m>`` per
    measure: one hash aggregate with map-side combine (a hot asset costs one
    buffer row per bucket and task)."""
    measures = measures or ROLLUP_MEASURES
    aggs = []
    for m in measures:
        c = F.col(m)
        aggs += [F.sum(c).alias(f"sum_{m}"), F.count(c).alias(f"n_{m}"), F.max(c).alias(f"max_{m}"),
                 F.min(c).alias(f"min_{m}")]
    # Group by the window itself (not its start) so a streaming append query can
    # close buckets as the watermark passes them.
    names = [f"{p}_{m}" for m in measures for p in ("sum", "n", "max", "min")]
    return (tm.groupBy(F.window(F.col(ts), width).alias("w"), "asset_id").agg(*aggs)
            .select(F.col("w.start").alias("time"), "asset_id", *names))


def _from_partials(fn: str, m: str, kind) -> Column:
    if fn == "sum":
        return F.sum(f"sum_{m}")
    if fn == "avg":
        return _mean(F.sum(f"sum_{m}").cast(kind), F.sum(f"n_{m}"))
    if fn == "max":
        return F.max(f"max_{m}")
    if fn == "min":
        return F.min(f"min_{m}")
    raise ValueError(fn)


def series_from_partials(partials: DataFrame, assets: DataFrame | None, series: list[tuple[str, str, str, int]],
                         start=None, end=None, room: str = ALL, rack: str = ALL,
                         server: str | None = ALL) -> DataFrame:
    """The ``bucket_series`` result computed from a bucket rollup (same width).
    ``start``/``end`` select buckets by their start."""
    df = time_range(partials, start, end, "time")
    if assets is not None:
        ids = scoped_assets(assets, room, rack, server, ("asset_id", "asset_name", "room_name", "rack_name")) \
            .select("asset_id")
        df = df.join(checked_broadcast(ids), "asset_id", "left_semi")
    wide = df.groupBy("time").agg(*[_from_partials(fn, col, df.schema[f"sum_{col}"].dataType).alias(f"v{i}")
                                    for i, (_, col, fn, _) in enumerate(series)])
    pairs = [F.struct(F.lit(label).alias("metric"), F.round(F.col(f"v{i}"), d).cast("double").alias("value"))
             for i, (label, _, _, d) in enumerate(series)]
    return wide.select("time", F.inline(F.array(*pairs))).orderBy("time", "metric")
