"""Telemetry enrichment (SCL-12..14): emission factor from the time of day,
carbon at the measured draw, and the status level, added to measured rows.

Status is decided on the unrounded values; emission factor and carbon are then
stored at 4 digits, CPU, power and temperatures at 2, like the writer does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewatt.functions.scalar import carbon_kg, emission_factor, status_level
from sitewatt.operators.joins import join_dimension


def enrich_telemetry(raw: DataFrame, assets: DataFrame, ts: str = "ts") -> DataFrame:
    """``raw`` carries ts, asset_id, cpu_usage, power_w, inlet_temp_c,
    outlet_temp_c, operational_state; assets supply the nominal power."""
    j = join_dimension(raw, assets.select("asset_id", "nominal_power_w"), "asset_id")
    ef = emission_factor(F.col(ts))
    j = j.withColumn("_ef", ef)
    status = status_level("cpu_usage", "outlet_temp_c", "power_w", "nominal_power_w", "operational_state")
    return j.select(
        ts, "asset_id",
        F.round("cpu_usage", 2).cast("decimal(18,2)").alias("cpu_usage"),
        F.round("power_w", 2).cast("decimal(18,2)").alias("power_w"),
        F.round("inlet_temp_c", 2).cast("decimal(18,2)").alias("inlet_temp_c"),
        F.round("outlet_temp_c", 2).cast("decimal(18,2)").alias("outlet_temp_c"),
        F.round("_ef", 4).cast("decimal(18,4)").alias("emission_factor_kg_per_kwh"),
        F.round(carbon_kg(F.col("power_w").cast("double"), F.col("_ef")), 4).cast("decimal(18,4)").alias("carbon_kg"),
        status.alias("status_level"), "operational_state")
