"""Alert episodes: from the sample that raises a rule to the one before it clears (STR-4 in batch).

Gaps and islands over each asset's ordered samples: a rule's episode is a maximal run
of firing samples, none further than ``max_gap`` after the one before. The history of an
asset is cut into time slabs; islands are found inside a slab, and only those that touch a
slab's first or last sample (at most two per rule and slab) are chained across slabs, so
an asset with any share of the samples is many groups, and the chaining is bounded by
the calendar. ``streaming.live.episode_stream`` gives the same episodes live.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitewatt.operators.alerts import ASSET_COLUMNS, alert_rules
from sitewatt.operators.asof import DAY, epoch_second, slab_of
from sitewatt.operators.joins import join_dimension

MAX_GAP = 2 * DAY  # seconds without a sample that end an episode


def fired_rules(samples: DataFrame, assets: DataFrame) -> DataFrame:
    """``asset_id, ts`` and ``fired``: rule, value and whether critical, for every sample (also those that break no rule)."""
    j = join_dimension(samples.select("asset_id", "ts", "cpu_usage", "outlet_temp_c", "power_w", "operational_state"),
                       assets.select(*ASSET_COLUMNS), "asset_id")
    fired = F.transform(alert_rules(j), lambda a: F.struct(a["rule_name"].alias("rule_name"), a["metric_value"].alias("value"),
                                                           (a["severity"] == "critical").alias("critical")))
    return j.select("asset_id", "ts", fired.alias("fired"))


def alert_episodes(samples: DataFrame, assets: DataFrame, max_gap: int = MAX_GAP, slab_seconds: int = DAY) -> DataFrame:
    """``asset_id, rule_name, start, end, samples, peak, severity``: every episode of every rule.

    ``start`` and ``end`` are its first and last firing samples; ``peak`` the largest measured
    value; ``severity`` critical where any sample was. Samples without asset or time are in none.
    """
    rows = fired_rules(samples.where("asset_id is not null and ts is not null"), assets).withColumn("slab", slab_of("ts", slab_seconds))
    in_slab = Window.partitionBy("asset_id", "slab").orderBy("ts")
    late = lambda before, now: epoch_second(now) - epoch_second(before) > max_gap
    rows = rows.withColumn("_step", F.when(late(F.lag("ts").over(in_slab), F.col("ts")), 2).otherwise(1))
    whole = in_slab.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"seq": F.sum("_step").over(in_slab.rowsBetween(Window.unboundedPreceding, 0)),
                             "_first": F.first("ts").over(whole), "_last": F.last("ts").over(whole)})
    rows = rows.select("asset_id", "slab", "ts", "seq", "_first", "_last", F.inline("fired"))
    by_rule = Window.partitionBy("asset_id", "slab", "rule_name").orderBy("seq")
    islands = (rows.withColumn("island", F.col("seq") - F.row_number().over(by_rule))
               .groupBy("asset_id", "rule_name", "slab", "island")
               .agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("samples"),
                    F.max("value").alias("peak"), F.max("critical").alias("critical"),
                    F.bool_or(F.col("ts") == F.col("_first")).alias("opens"), F.bool_or(F.col("ts") == F.col("_last")).alias("runs_on")))
    # the slab before, as far as the asset has samples in one, joined on by time
    slabs = (samples.where("asset_id is not null and ts is not null").groupBy("asset_id", slab_of("ts", slab_seconds).alias("slab"))
             .agg(F.min("ts").alias("_from"), F.max("ts").alias("_to")))
    order = Window.partitionBy("asset_id").orderBy("slab")
    slabs = slabs.select("asset_id", "slab", F.when(~late(F.lag("_to").over(order), F.col("_from")), F.lag("slab").over(order)).alias("joined"))
    parts = ["start", "end", "samples", "peak", "critical"]
    inner = islands.where("not opens and not runs_on").select("asset_id", "rule_name", *parts)
    border = islands.where("opens or runs_on").join(slabs, ["asset_id", "slab"], "left")
    chain = Window.partitionBy("asset_id", "rule_name").orderBy("start")
    goes_on = F.col("opens") & F.lag("runs_on").over(chain) & (F.col("joined") == F.lag("slab").over(chain))
    border = border.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    border = border.withColumn("_episode", F.sum("_new").over(chain.rowsBetween(Window.unboundedPreceding, 0)))
    merged = border.groupBy("asset_id", "rule_name", "_episode").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("samples").alias("samples"), F.max("peak").alias("peak"),
        F.max("critical").alias("critical")).drop("_episode")
    out = inner.unionByName(merged)
    return out.select("asset_id", "rule_name", "start", "end", "samples", "peak",
                      F.when(F.col("critical"), "critical").otherwise("warning").alias("severity"))
