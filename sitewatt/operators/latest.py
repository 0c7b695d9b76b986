"""Latest-row selection (LAT-1..3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewatt.operators.filters import time_range


def latest_per_key(df: DataFrame, keys=("asset_id",), order: str = "ts",
                   method: str = "max_by", partition_col: str | None = None, as_of=None) -> DataFrame:
    """Newest row per key (``DISTINCT ON (key) ... ORDER BY key, ts DESC``), with
    ``as_of`` the newest at or before that instant.

    One contract for both plans: one row per key, a null key is a key, a null
    ``order`` comes before all others, rows that tie on ``order`` are decided by their
    largest column values in the input's column order. The plan is the caller's choice
    and never changes the result.

    ``max_by`` (default): one pass, partial aggregation per map task, so only one row
    per key and input partition crosses the shuffle; safe under hot keys.
    ``semi``: ``max(order)`` per key (hash aggregate over two columns), then a
    left-semi join of the fact on key and order, and the same selection among the few
    rows left; the oldest per-key maximum bounds the second read (a pushed Parquet
    filter, and with ``partition_col``, the date of ``order``, a partition
    filter), so full rows are read only from recent data.
    """
    keys = list(keys)
    if method not in ("max_by", "semi"):
        raise ValueError(f"unknown method {method!r}")
    if as_of is not None:
        df = time_range(df, None, as_of, order, partition_col)
    rows = df
    if method == "semi":
        newest = df.groupBy(*keys).agg(F.max(order).alias("_newest"))
        newest = newest.select("_newest", *[F.col(k).alias(f"_key_{k}") for k in keys])
        # No key's newest row is older than the oldest of them: rows before that
        # bound cannot qualify, and on date-partitioned facts the bound prunes
        # partitions before the semi join.
        bound = newest.agg(F.min("_newest")).scalar()
        rows = df.where((F.col(order) >= bound) | F.col(order).isNull())
        if partition_col:
            rows = rows.where((F.col(partition_col) >= F.to_date(bound)) | F.col(partition_col).isNull())
        on = F.col(order).eqNullSafe(F.col("_newest"))
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
        rows = rows.join(newest, on, "left_semi")
    rest = [c for c in df.columns if c not in (*keys, order)]
    packed = F.struct(F.col(order), *[F.col(c) for c in rest])
    return (rows.groupBy(*keys).agg(F.max(packed).alias("_row"))
            .select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns]))


def latest_row(df: DataFrame, order: str = "ts") -> DataFrame:
    """The single newest row (``ORDER BY ts DESC LIMIT 1``); empty input -> no rows.
    Plans as a per-partition top-1 (``TakeOrderedAndProject``), no full sort."""
    return df.orderBy(F.col(order).desc()).limit(1)


def last_not_null(df: DataFrame, value: str, order: str = "ts") -> DataFrame:
    """Last non-null value of ``value`` by ``order`` (a panel's ``lastNotNull``)."""
    v = F.col(value)
    return df.agg(F.max_by(v, F.when(v.isNotNull(), F.col(order))).alias(value))
