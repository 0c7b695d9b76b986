"""Aggregates of any time range from stored prefix sums (FLT-3 with AGG-13..15).

A two-level scan: sums per day give each day its offset; inside a day a running sum
over its timestamps is added. The stored table holds, per timestamp, the sums of all
facts up to it, and one opening row for every day of the calendar. A range is then
two point lookups in it (before its start and at its end), whatever it spans: no query
of ranges reads the facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitewatt.operators.asof import asof_join
from sitewatt.operators.joins import checked_broadcast


def _names(columns) -> list[str]:
    return ["n", *[f"{p}_{c}" for c in columns for p in ("sum", "n")]]


def prefix_sums(facts: DataFrame, columns, ts: str = "ts") -> DataFrame:
    """``dt, ts`` and the running ``n``, ``sum_<c>``, ``n_<c>`` of all facts at or before ``ts``.

    Facts without a timestamp stand in no range. Group sizes are bounded by the calendar:
    a day's window holds its distinct timestamps, the window over days one row per day.
    """
    columns = list(columns)
    names = _names(columns)
    sums = [F.count(F.lit(1)).alias("n")] + [a for c in columns for a in (F.sum(c).alias(f"sum_{c}"), F.count(c).alias(f"n_{c}"))]
    per_ts = (facts.where(F.col(ts).isNotNull()).groupBy(F.col(ts).alias("ts")).agg(*sums)
              .na.fill(0).withColumn("dt", F.to_date("ts")))
    kinds = {n: ("decimal(38,%d)" % t.scale if hasattr(t, "scale") else "long" if n.startswith("n") else t.simpleString())
             for n, t in ((f.name, f.dataType) for f in per_ts.schema if f.name in names)}
    days = per_ts.groupBy("dt").agg(*[F.sum(n).cast(kinds[n]).alias(n) for n in names])
    calendar = days.agg(F.sequence(F.min("dt"), F.max("dt")).alias("all")).select(F.explode("all").alias("dt"))
    before = Window.partitionBy(F.lit(0)).orderBy("dt").rowsBetween(Window.unboundedPreceding, -1)
    opened = (calendar.join(days, "dt", "left").na.fill(0)
              .select("dt", *[F.coalesce(F.sum(n).over(before), F.lit(0)).cast(kinds[n]).alias(n) for n in names]))
    running = Window.partitionBy("dt").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    inside = per_ts.select("dt", "ts", *[F.sum(n).over(running).cast(kinds[n]).alias(n) for n in names])
    offset = checked_broadcast(opened.select("dt", *[F.col(n).alias(f"_{n}") for n in names]))
    rows = inside.join(offset, "dt").select("dt", "ts", *[(F.col(n) + F.col(f"_{n}")).cast(kinds[n]).alias(n) for n in names])
    return opened.select("dt", F.col("dt").cast("timestamp_ntz").alias("ts"), *names).unionByName(
        rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")))


def range_sums(prefix: DataFrame, ranges: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """``start, end`` and the totals of every column of ``prefix`` in ``[start, end]``, one row per distinct range.

    Ranges may lie anywhere; an inverted one is empty, one with a null border is left out.
    """
    names = [c for c in prefix.columns if c not in ("dt", "ts")]
    wanted = ranges.select(F.col(start).cast("timestamp_ntz").alias("start"), F.col(end).cast("timestamp_ntz").alias("end")).distinct()
    wanted = wanted.where("start is not null and end is not null")
    newest = prefix.agg(F.max("ts")).scalar()
    borders = wanted.select("start", "end", F.inline(F.array(
        F.struct(F.lit(-1).alias("sign"), (F.least("start", F.col("end") + F.expr("interval 1 microsecond"))
                                           - F.expr("interval 1 microsecond")).alias("as_of")),
        F.struct(F.lit(1).alias("sign"), F.col("end").alias("as_of")))))
    borders = borders.withColumn("as_of", F.least("as_of", newest)).withColumn("dt", F.to_date("as_of"))
    seen = asof_join(borders, prefix, ["dt"], "as_of", carry=False)
    return seen.groupBy("start", "end").agg(*[
        F.sum(F.col("sign") * F.coalesce(F.col(n), F.lit(0))).cast(prefix.schema[n].dataType).alias(n) for n in names])


def range_means(totals: DataFrame, columns: dict[str, str]) -> list:
    """Mean columns (double) of the totals: ``{output name: column}``; null where a range holds no value."""
    return [F.try_divide(F.col(f"sum_{c}").cast("double"), F.col(f"n_{c}").cast("double")).alias(name) for name, c in columns.items()]
