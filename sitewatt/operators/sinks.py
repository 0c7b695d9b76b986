"""Keyed ingestion rules and writers (SNK-1..6).

Plain Parquet has no MERGE, so upserts are expressed as anti-join + union and
written to a *new* location; a path that is being read is never overwritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _extreme_per_key(batch: DataFrame, keys: list[str], order, pick) -> DataFrame:
    """One row per key: the row with the smallest (``min_by``) or largest
    (``max_by``) ``order``. Aggregates map-side first, so a hot key sends at most
    one row per input partition through the shuffle."""
    order_col = F.col(order) if isinstance(order, str) else order
    rest = [c for c in batch.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in rest])
    return (batch.groupBy(*keys).agg(pick(packed, order_col).alias("_row"))
            .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
            .select(*batch.columns))


def first_wins(batch: DataFrame, keys: list[str], order) -> DataFrame:
    """De-duplicate a batch: per key keep the row that came first by ``order``."""
    return _extreme_per_key(batch, keys, order, F.min_by)


def last_wins(batch: DataFrame, keys: list[str], order) -> DataFrame:
    """De-duplicate a batch: per key keep the row that came last by ``order``."""
    return _extreme_per_key(batch, keys, order, F.max_by)


def append_first_wins(target: DataFrame, batch: DataFrame, keys: list[str], order,
                      range_key: str | None = "ts", partition_col: str | None = None) -> DataFrame:
    """Rows to append so that an existing key is never changed (``ON CONFLICT DO
    NOTHING``): de-duplicate the batch, then drop keys already in ``target``.

    When ``range_key`` is part of the key, only target rows inside the batch's
    ``[min, max]`` of it can conflict: the bounds are scalar subqueries pushed
    into the target scan (and onto ``partition_col``, its date), so a batch is
    checked against the matching slice of the fact, not all of it.
    Returns only the new rows; append them with ``write.mode("append")``.
    """
    fresh = first_wins(batch, keys, order)
    existing = target
    if range_key and range_key in keys:
        lo = batch.agg(F.min(range_key)).scalar()
        hi = batch.agg(F.max(range_key)).scalar()
        existing = existing.where(F.col(range_key).between(lo, hi))
        if partition_col:
            existing = existing.where(F.col(partition_col).between(F.to_date(lo), F.to_date(hi)))
    return fresh.join(existing.select(*keys), keys, "left_anti")


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], order=None) -> DataFrame:
    """Last-writer-wins keyed upsert (``ON CONFLICT DO UPDATE``): the full new
    table content. Write it to a new path (or a table format with MERGE)."""
    if order is not None:
        batch = last_wins(batch, keys, order)
    batch = batch.select(*target.columns)
    return target.join(batch.select(*keys), keys, "left_anti").unionByName(batch)


def accept_newer(batch: DataFrame, target: DataFrame, ts: str = "ts") -> DataFrame:
    """High-water-mark guard: keep batch rows strictly newer than ``max(target.ts)``
    (all rows when the target is empty). The bound is one scalar subquery."""
    hwm = target.agg(F.max(ts)).scalar()
    return batch.where(hwm.isNull() | (F.col(ts) > hwm))


def is_empty(target: DataFrame) -> bool:
    """Backfill guard: True when the table has no rows (reads at most one row)."""
    return target.isEmpty()


def fact_stats(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Row count and newest timestamp of a fact table (one row)."""
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.max(ts).alias("max_ts"))


def write_table(df: DataFrame, path: str, mode: str = "errorifexists",
                partition_by: list[str] | None = None, fmt: str = "parquet") -> str:
    """Write a result (Parquet by default), optionally partitioned, return the path."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path


def with_date_partition(df: DataFrame, ts: str = "ts", name: str = "dt") -> DataFrame:
    """Add the date column facts are partitioned by (enables partition pruning)."""
    return df.withColumn(name, F.to_date(F.col(ts)))


def export_metrics(kpi_long: DataFrame, digits: int = 4) -> DataFrame:
    """Metric export rows ``ts, metric_name, value``, rounded, ordered by name."""
    return (kpi_long.select("ts", "metric_name", F.round(F.col("metric_value"), digits).cast("double")
                            .alias("metric_value"))
            .orderBy("metric_name"))
