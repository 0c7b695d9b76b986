"""The forecast of every instant against what came (TS-4 over a whole history).

Moving means are RANGE frames over bucket partials, not over samples. A key's history
is cut into slabs; the buckets within reach of a border are handed to the neighbouring
slab as well, so every frame is complete inside one group and a hot key is many groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitewatt.operators.asof import DAY, epoch_second


def forecast_backtest(buckets: DataFrame, keys, horizon: int, time: str = "time", total: str = "total", count: str = "n",
                      slab_seconds: int = DAY) -> DataFrame:
    """``keys, time, current_avg, previous_avg, forecast, actual, error`` for every bucket start.

    ``current_avg`` is the mean over the ``horizon`` seconds before ``time``, ``previous_avg`` over the
    ``horizon`` before those, ``forecast`` the straight line through both (the current mean where
    there is no previous one, 0 where there is none), ``actual`` the mean over the ``horizon`` from
    ``time`` on. ``buckets`` holds one row per key and bucket with its sum and count.
    """
    keys = list(keys)
    slab_seconds = max(slab_seconds, 2 * horizon)
    t, slab = F.col("_s"), lambda c: F.floor(c / F.lit(slab_seconds)).cast("long")
    rows = buckets.where(F.col(time).isNotNull()).select(*keys, time, epoch_second(time).alias("_s"), total, count)
    reach = rows.select("*", slab(t).alias("_own"), F.explode(F.sequence(slab(t - horizon + 1), slab(t + 2 * horizon))).alias("_slab"))
    order = Window.partitionBy(*keys, "_slab").orderBy("_s")

    def mean(first: int, last: int):
        w = order.rangeBetween(first, last)
        return F.try_divide(F.sum(total).over(w).cast("double"), F.sum(count).over(w).cast("double"))

    means = reach.select(*keys, time, "_own", "_slab", mean(-horizon, -1).alias("current_avg"),
                         mean(-2 * horizon, -horizon - 1).alias("previous_avg"), mean(0, horizon - 1).alias("actual"))
    cur, prev = F.col("current_avg"), F.col("previous_avg")
    return (means.where("_own = _slab")
            .withColumn("forecast", F.coalesce(cur + (cur - prev), cur, F.lit(0.0)))
            .select(*keys, time, "current_avg", "previous_avg", "forecast", "actual", (F.col("actual") - F.col("forecast")).alias("error")))
