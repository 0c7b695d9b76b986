"""Point-in-time lookups: the newest sample at or before each instant (LAT-1 at any time).

Instants and samples meet as one tagged union, cut into time slabs per key, so a hot
key is many groups instead of one. Inside a slab a running ``last`` answers most
instants; what a slab hands on is one row per key and slab, and a second running
``last`` over those rows (their number is bounded by the calendar) answers
instants that come before the first sample of their slab.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def epoch_second(ts) -> Column:
    """Whole seconds since the epoch of a wall-clock time."""
    t = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), t.cast("timestamp_ntz"))


def slab_of(ts, seconds: int = DAY) -> Column:
    """Number of the time slab (``floor(time / seconds)``)."""
    return F.floor(epoch_second(ts) / F.lit(seconds)).cast("long")


def asof_join(instants: DataFrame, samples: DataFrame, keys, at: str = "as_of", ts: str = "ts",
              slab_seconds: int = DAY, carry: bool = True) -> DataFrame:
    """Every row of ``instants`` with the columns of the newest sample of its keys at or before ``at``.

    Rows of ``instants`` without such a sample, with a null key or a null instant keep nulls.
    Samples that tie on ``ts`` are decided by their largest column values in column order.
    Equal (keys, instant) pairs are looked up once. ``carry=False`` stays inside a slab: for
    samples that are known to open every slab.
    """
    keys = list(keys)
    clash = set(instants.columns) & set(samples.columns) - set(keys)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    rest = [c for c in samples.columns if c not in (*keys, ts)]
    known = lambda df, t: df.where(" and ".join(f"`{c}` is not null" for c in (*keys, t)))
    asked = known(instants, at).select(*keys, F.col(at).alias("_t")).distinct()
    rows = known(samples, ts).select(*keys, F.col(ts).alias("_t"), F.lit(0).alias("_tag"),
                                     F.struct(ts, *rest).alias("_row"))
    tagged = rows.unionByName(asked.withColumns({"_tag": F.lit(1), "_row": F.lit(None).cast(rows.schema["_row"].dataType)}))
    tagged = tagged.withColumn("_slab", slab_of("_t", slab_seconds))
    order = Window.partitionBy(*keys, "_slab").orderBy("_t", "_tag", "_row")
    last = F.last("_row", ignorenulls=True)
    inside = tagged.withColumn("_hit", last.over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = inside.where("_tag = 1").select(*keys, "_slab", "_t", "_hit")
    if carry:
        whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        slabs = (tagged.withColumns({"_end": last.over(whole), "_n": F.row_number().over(order)})
                 .where("_n = 1").select(*keys, "_slab", "_end"))
        earlier = Window.partitionBy(*keys).orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1)
        handed = slabs.select(*keys, "_slab", F.last("_end", ignorenulls=True).over(earlier).alias("_from")).where("_from is not null")
        found = (found.join(handed, [*keys, "_slab"], "left")
                 .withColumn("_hit", F.coalesce("_hit", "_from")))
    found = found.where("_hit is not null").select(*keys, F.col("_t").alias(at), "_hit")
    return (instants.join(found, [*keys, at], "left")
            .select(*instants.columns, *[F.col(f"_hit.{c}").alias(c) for c in (ts, *rest)]))
