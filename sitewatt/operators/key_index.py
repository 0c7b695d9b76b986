"""Which keys a fact table holds, as bitmaps (SNK-1 at scale).

One row per timestamp and block of 32,768 key numbers, with one bit per key present. A
batch is checked against the rows of its own timestamps: first-wins appends never read the
history they protect, and an index row is 4 KB at most whatever the facts' width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewatt.operators.sinks import first_wins


def key_bitmaps(facts: DataFrame, key: str = "asset_id", ts: str = "ts") -> DataFrame:
    """``dt, ts, block, bitmap`` of the (timestamp, key) pairs present. Rows without either are in none."""
    k = F.col(key).cast("long")
    return (facts.where(F.col(ts).isNotNull() & k.isNotNull())
            .groupBy(F.col(ts).alias("ts"), F.bitmap_bucket_number(k).alias("block"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(k)).alias("bitmap"))
            .select(F.to_date("ts").alias("dt"), "ts", "block", "bitmap"))


def merge_bitmaps(*indexes: DataFrame) -> DataFrame:
    """One index of everything the given ones hold."""
    rows = indexes[0]
    for other in indexes[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy("dt", "ts", "block").agg(F.bitmap_or_agg("bitmap").alias("bitmap")).select("dt", "ts", "block", "bitmap")


def _bit(bitmap: str, position: Column) -> Column:
    byte = F.conv(F.hex(F.col(bitmap).substr((position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", byte, (position % 8).cast("int"))


def append_absent(index: DataFrame, batch: DataFrame, order, key: str = "asset_id", ts: str = "ts") -> DataFrame:
    """Rows of ``batch`` to append so that no existing (timestamp, key) changes: of a key that the batch
    repeats the first by ``order``, and only keys the index does not hold. Rows without key or time pass."""
    fresh = first_wins(batch, [ts, key], order)
    k = F.col(key).cast("long")
    lo, hi = batch.agg(F.min(ts)).scalar(), batch.agg(F.max(ts)).scalar()
    held = index.where(F.col("dt").between(F.to_date(lo), F.to_date(hi)) & F.col("ts").between(lo, hi))
    held = held.select(F.col("ts").alias("_ts"), F.col("block").alias("_block"), F.col("bitmap").alias("_bitmap"))
    joined = fresh.join(held, (F.col(ts) == F.col("_ts")) & (F.bitmap_bucket_number(k) == F.col("_block")), "left")
    present = F.coalesce(_bit("_bitmap", F.bitmap_bit_position(k)) == 1, F.lit(False))
    return joined.where(~present).select(*batch.columns)
