"""Aggregations over the latest state and the facts (AGG-1..18).

The latest state is one row per asset, so every rollup here shuffles at most one
row per asset and map partition; the dimension join happens after the fact has
been reduced to that grain. Measures are decimals; sums stay exact and
averages are taken as ``sum / count`` in decimal, so rounding matches exact SQL
numerics. Results are cast to double at the boundary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewatt.operators.alerts import as_of_column
from sitewatt.operators.filters import ALL, scope, time_range
from sitewatt.operators.joins import join_dimension

MEASURES = {"power_w", "cpu_usage", "inlet_temp_c", "outlet_temp_c", "carbon_kg",
            "emission_factor_kg_per_kwh"}


def avg_exact(c) -> Column:
    """Average as exact decimal ``sum / count`` (null on no rows)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.try_divide(F.sum(c), F.count(c).cast("decimal(20,0)"))


def agg_expr(fn: str, c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    if fn == "avg":
        return avg_exact(c)
    return {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}[fn](c)


def rounded(c: Column, digits: int) -> Column:
    return F.round(c, digits).cast("double")


def count_where(cond: Column) -> Column:
    return F.count_if(cond)


def scoped_assets(assets: DataFrame, room: str = ALL, rack: str = ALL, server: str | None = ALL,
                  columns=("asset_id", "asset_name", "room_id", "room_name", "rack_id", "rack_name",
                           "asset_type", "nominal_power_w")) -> DataFrame:
    """The asset dimension restricted to the scope (filter before joining)."""
    return scope(assets.select(*columns), room, rack, server)


def with_assets(facts: DataFrame, assets: DataFrame, room: str = ALL, rack: str = ALL,
                server: str | None = ALL, columns=None) -> DataFrame:
    """Facts (or latest state) joined ``USING (asset_id)`` to the scoped assets."""
    cols = columns or ("asset_id", "asset_name", "room_id", "room_name", "rack_id", "rack_name",
                       "asset_type", "nominal_power_w")
    return join_dimension(facts, scoped_assets(assets, room, rack, server, cols), "asset_id")


def _measures(latest_joined: DataFrame, group: list[str], power_name: str, carbon_name: str,
              outlet: bool = True) -> DataFrame:
    s = F.col("status_level")
    aggs = [F.max("ts").alias("ts"),
            rounded(avg_exact("cpu_usage"), 2).alias("avg_cpu_usage"),
            rounded(F.sum("power_w"), 2).alias(power_name),
            rounded(avg_exact("inlet_temp_c"), 2).alias("avg_inlet_temp_c")]
    if outlet:
        aggs.append(rounded(avg_exact("outlet_temp_c"), 2).alias("avg_outlet_temp_c"))
    aggs += [rounded(F.sum("carbon_kg"), 4).alias(carbon_name),
             count_where(s == "critical").alias("critical_assets"),
             count_where(s == "warning").alias("warning_assets")]
    return latest_joined.groupBy(*group).agg(*aggs) if group else latest_joined.agg(*aggs)


def rack_rollup(latest: DataFrame, assets: DataFrame) -> DataFrame:
    """Per rack (room id/name, rack id/name): newest ts, averages, sums, status counts."""
    j = with_assets(latest, assets)
    return _measures(j, ["room_id", "room_name", "rack_id", "rack_name"], "rack_power_w", "rack_carbon_kg")


def room_rollup(latest: DataFrame, assets: DataFrame) -> DataFrame:
    """Per room, same measures as the rack rollup."""
    j = with_assets(latest, assets)
    return _measures(j, ["room_id", "room_name"], "room_power_w", "room_carbon_kg")


def site_summary(latest: DataFrame) -> DataFrame:
    """Whole site, no join and no outlet average; always exactly one row."""
    return _measures(latest, [], "current_power_w", "current_carbon_kg", outlet=False).select(
        "ts", "current_power_w", "avg_cpu_usage", "avg_inlet_temp_c", "current_carbon_kg",
        "critical_assets", "warning_assets")


LEVELS = ["rack", "room", "site"]


def rollup_all_levels(latest: DataFrame, assets: DataFrame) -> DataFrame:
    """Rack, room and site rollups in one aggregation: ``level`` and the names of the level (null above it),
    then the measures of the separate rollups. One Expand, one exchange of per-task partial rows."""
    j = with_assets(latest, assets)
    rack = ["room_id", "room_name", "rack_id", "rack_name"]
    sets = [[F.col(c) for c in g] for g in (rack, rack[:2], [])]
    s = F.col("status_level")
    out = j.groupingSets(sets, *[F.col(c) for c in rack]).agg(
        F.grouping_id().alias("_gid"), F.max("ts").alias("ts"), F.count(F.lit(1)).alias("assets"),
        rounded(avg_exact("cpu_usage"), 2).alias("avg_cpu_usage"), rounded(F.sum("power_w"), 2).alias("power_w"),
        rounded(avg_exact("inlet_temp_c"), 2).alias("avg_inlet_temp_c"), rounded(avg_exact("outlet_temp_c"), 2).alias("avg_outlet_temp_c"),
        rounded(F.sum("carbon_kg"), 4).alias("carbon_kg"),
        count_where(s == "critical").alias("critical_assets"), count_where(s == "warning").alias("warning_assets"))
    level = F.when(F.col("_gid") == 0, "rack").when(F.col("_gid") == 3, "room").otherwise("site")
    return out.select(level.alias("level"), *[c for c in out.columns if c != "_gid"])


def scoped_stat(latest: DataFrame, assets: DataFrame, column: str, fn: str, digits: int,
                room: str = ALL, rack: str = ALL, server: str = ALL, as_of=None,
                default=0) -> DataFrame:
    """One scoped statistic of the latest state, ``round(coalesce(fn(col), 0), n)``."""
    j = with_assets(latest.select("asset_id", column), assets, room, rack, server,
                    ("asset_id", "asset_name", "room_name", "rack_name"))
    v = agg_expr(fn, column)
    if default is not None:
        v = F.coalesce(v, F.lit(default))
    return j.agg(rounded(v, digits).alias("value")).select(as_of_column(as_of).alias("time"), "value")


def _per_rack(latest: DataFrame, assets: DataFrame, room: str, rack: str, value: Column,
              name: str = "rack_name") -> DataFrame:
    j = with_assets(latest, assets, room, rack, None)
    return j.groupBy("rack_name").agg(value.alias("value")).select(
        F.col("rack_name").alias(name), "value").orderBy(F.col("value").desc_nulls_last(), F.col(name))


def rack_power(latest: DataFrame, assets: DataFrame, room: str = ALL, rack: str = ALL) -> DataFrame:
    """Power per rack name (1 digit), highest first; server selection ignored."""
    return _per_rack(latest, assets, room, rack, rounded(F.sum("power_w"), 1))


def rack_stress(latest: DataFrame, assets: DataFrame, room: str = ALL, rack: str = ALL) -> DataFrame:
    """avg(cpu) + avg(outlet) - 20 per rack name (1 digit), highest first."""
    v = rounded(avg_exact("cpu_usage") + avg_exact("outlet_temp_c") - F.lit(20), 1)
    return _per_rack(latest, assets, room, rack, v, "metric")


def rack_carbon(latest: DataFrame, assets: DataFrame, room: str = ALL, rack: str = ALL) -> DataFrame:
    """Carbon per rack name (3 digits), highest first."""
    return _per_rack(latest, assets, room, rack, rounded(F.sum("carbon_kg"), 3), "metric")


def footprint(latest: DataFrame, assets: DataFrame, room: str = ALL, rack: str = ALL) -> DataFrame:
    """Per (room, rack): assets reporting, power (0 digits), carbon (3), by carbon desc."""
    j = with_assets(latest, assets, room, rack, None)
    return (j.groupBy("room_name", "rack_name")
            .agg(F.count(F.lit(1)).alias("assets"), rounded(F.sum("power_w"), 0).alias("power_w"),
                 rounded(F.sum("carbon_kg"), 3).alias("co2_kg"))
            .orderBy(F.col("co2_kg").desc(), "room_name", "rack_name"))


def assets_in_scope(assets: DataFrame, room: str = ALL, rack: str = ALL, server: str = ALL,
                    as_of=None) -> DataFrame:
    """Inventory count in scope, independent of telemetry."""
    return (scope(assets, room, rack, server).agg(F.count(F.lit(1)).cast("double").alias("value"))
            .select(as_of_column(as_of).alias("time"), "value"))


def high_carbon_count(latest: DataFrame, assets: DataFrame, threshold: float = 0.018,
                      room: str = ALL, rack: str = ALL, server: str = ALL, as_of=None) -> DataFrame:
    """Number of assets whose latest carbon is at least ``threshold``."""
    hot = latest.where(F.col("carbon_kg") >= F.lit(threshold).cast("decimal(18,4)")).select("asset_id")
    j = with_assets(hot, assets, room, rack, server, ("asset_id", "asset_name", "room_name", "rack_name"))
    return j.agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        as_of_column(as_of).alias("time"), "value")


def range_avg(kpi: DataFrame, column: str, digits: int, start=None, end=None, as_of=None,
              partition_col: str | None = None) -> DataFrame:
    """Average of one KPI column over a time range; no rows -> null (no coalesce)."""
    df = time_range(kpi, start, end, partition_col=partition_col)
    return df.agg(rounded(avg_exact(column), digits).alias("value")).select(
        as_of_column(as_of).alias("time"), "value")


# ---------------------------------------------------------------------------
# The averaged KPI columns, their output names and digits.
RANGE_AVGS_WIDE = [
    ("pue", "avg_pue", 3), ("ref", "avg_ref", 3), ("erf", "avg_erf", 3), ("cue", "avg_cue", 3),
    ("co2_savings_kg", "avg_co2_savings", 3), ("ppw", "avg_ppw", 3),
    ("total_facility_power_w", "avg_power", 1), ("total_co2_kg", "avg_carbon", 3),
]
RANGE_AVGS_LONG = [
    ("pue", "Avg PUE", 3), ("ref", "Avg REF", 3), ("erf", "Avg ERF", 3), ("cue", "Avg CUE", 3),
    ("co2_savings_kg", "Avg CO2 savings", 3), ("ppw", "Avg PPW", 3),
]
# ---------------------------------------------------------------------------


def range_avgs_wide(kpi: DataFrame, start=None, end=None, partition_col: str | None = None) -> DataFrame:
    """Eight range averages in one row (one scan)."""
    df = time_range(kpi, start, end, partition_col=partition_col)
    return df.agg(*[rounded(avg_exact(c), d).alias(n) for c, n, d in RANGE_AVGS_WIDE])


def range_avgs_long(kpi: DataFrame, start=None, end=None, partition_col: str | None = None) -> DataFrame:
    """Six range averages as ``metric, value`` rows: one aggregate, then unpivot."""
    df = time_range(kpi, start, end, partition_col=partition_col)
    wide = df.agg(*[rounded(avg_exact(c), d).alias(f"m{i}") for i, (c, _, d) in enumerate(RANGE_AVGS_LONG)])
    pairs = [F.struct(F.lit(n).alias("metric"), F.col(f"m{i}").alias("value"))
             for i, (_, n, _) in enumerate(RANGE_AVGS_LONG)]
    return wide.select(F.inline(F.array(*pairs)))


def min_max_bounds(df: DataFrame, column: str) -> DataFrame:
    """One-row normalisation bounds ``min_<col>, max_<col>``."""
    return df.agg(F.min(column).alias(f"min_{column}"), F.max(column).alias(f"max_{column}"))


def kpi_inputs(tm: DataFrame, ts: str = "ts") -> DataFrame:
    """Per-timestamp inputs of the KPI pipeline: IT power, mean temperatures and
    emission factor, share of non-normal rows, summed CPU. Partial aggregation
    per map task: a timestamp holding any share of the rows costs one buffer
    row per task before the shuffle."""
    n = F.count(F.lit(1))
    return tm.groupBy(ts).agg(
        F.sum("power_w").alias("it_power_w"),
        (F.sum("cpu_usage").cast("double") / n).alias("avg_cpu"),
        (F.sum("inlet_temp_c").cast("double") / n).alias("avg_inlet"),
        (F.sum("outlet_temp_c").cast("double") / n).alias("avg_outlet"),
        (F.sum("emission_factor_kg_per_kwh").cast("double") / n).alias("avg_ef"),
        (F.count_if(F.col("status_level") != "normal") / n).alias("warning_pressure"),
        F.sum("cpu_usage").alias("sum_cpu"),
        n.alias("rows"),
    )
