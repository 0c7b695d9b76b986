"""Top-k tables over the latest state (TOP-1..4).

``orderBy(...).limit(k)`` plans as ``TakeOrderedAndProject``: every task keeps
its own top k and only k rows per task reach the final merge, so no global sort.
Asset id breaks ties so the cut is deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitewatt.operators.filters import ALL
from sitewatt.operators.rollups import with_assets


def _display(spec) -> list:
    out = []
    for name, src, digits in spec:
        c = F.col(src)
        if digits is not None:
            c = F.round(c, digits).cast("double")
        out.append(c.alias(name))
    return out


def top_assets(latest: DataFrame, assets: DataFrame, order_col: str, k: int, spec,
               room: str = ALL, rack: str = ALL, server: str = ALL) -> DataFrame:
    """Top ``k`` assets by the unrounded ``order_col`` descending."""
    j = with_assets(latest, assets, room, rack, server)
    top = j.orderBy(F.col(order_col).desc(), F.col("asset_id")).limit(k)
    return top.select(*_display(spec))


HOTTEST_SPEC = [("server", "asset_name", None), ("room", "room_name", None), ("rack", "rack_name", None),
                ("outlet_c", "outlet_temp_c", 1), ("cpu_percent", "cpu_usage", 1), ("status", "status_level", None)]
POWER_SPEC = [("server", "asset_name", None), ("type", "asset_type", None), ("rack", "rack_name", None),
              ("power_w", "power_w", 0), ("cpu_percent", "cpu_usage", 1), ("outlet_c", "outlet_temp_c", 1),
              ("state", "operational_state", None)]
CARBON_SPEC = [("server", "asset_name", None), ("room", "room_name", None), ("rack", "rack_name", None),
               ("co2_kg", "carbon_kg", 3), ("power_w", "power_w", 0), ("status", "status_level", None)]


def hottest_assets(latest, assets, k: int = 15, **scope_args) -> DataFrame:
    return top_assets(latest, assets, "outlet_temp_c", k, HOTTEST_SPEC, **scope_args)


def top_power_assets(latest, assets, k: int = 20, **scope_args) -> DataFrame:
    return top_assets(latest, assets, "power_w", k, POWER_SPEC, **scope_args)


def top_carbon_assets(latest, assets, k: int = 20, **scope_args) -> DataFrame:
    return top_assets(latest, assets, "carbon_kg", k, CARBON_SPEC, **scope_args)


STATUS_SPEC = [("last_update", "ts", None), ("room", "room_name", None), ("rack", "rack_name", None),
               ("server", "asset_name", None), ("type", "asset_type", None), ("cpu_percent", "cpu_usage", 1),
               ("power_w", "power_w", 0), ("outlet_c", "outlet_temp_c", 1), ("status", "status_level", None),
               ("state", "operational_state", None)]


def live_status(latest: DataFrame, assets: DataFrame, k: int = 25, room: str = ALL, rack: str = ALL,
                server: str = ALL) -> DataFrame:
    """Critical first, then warning, then the rest; within a level CPU descending."""
    j = with_assets(latest, assets, room, rack, server)
    rank = (F.when(F.col("status_level") == "critical", 1)
             .when(F.col("status_level") == "warning", 2).otherwise(3))
    top = j.orderBy(rank, F.col("cpu_usage").desc(), F.col("asset_id")).limit(k)
    return top.select(*_display(STATUS_SPEC))


SALTS = 16  # groups that a large rack's rows are first ranked in


def top_per_group(latest: DataFrame, assets: DataFrame, group: str, order_col: str, k: int, spec, **scope_args) -> DataFrame:
    """The ``k`` largest assets of every rack (or room) by the unrounded ``order_col``, with their ``rank``.

    Ranked twice: within a salt of the group, then among the survivors. Spark puts a group
    limit under each exchange, so a task sends at most ``k`` rows of a group, and a group of
    any size never meets in one task before it is cut to ``SALTS * k`` rows."""
    j = with_assets(latest, assets, **scope_args).withColumn("_salt", F.pmod(F.xxhash64("asset_id"), F.lit(SALTS)))
    order = [F.col(order_col).desc(), F.col("asset_id").asc()]
    some = j.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_salt").orderBy(*order))).where(F.col("_r") <= k)
    top = some.drop("_r").withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)
    return top.select(group, "rank", *[c for c in _display(spec)])
