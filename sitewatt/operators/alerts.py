"""Rule-based alerts over the latest state (ALR-1..4, TOP-5..7, AGG-11..12).

The four rules run in one pass: each rule yields a nullable struct, the array of
fired rules is compacted and exploded. One scan of the latest state instead of
one scan and one join per rule; being stateless it also runs on a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewatt.functions.scalar import dec, num_text
from sitewatt.operators.filters import ALL, scope
from sitewatt.operators.joins import join_dimension

# ---------------------------------------------------------------------------
# Rule names, thresholds and message formats.
RULE_CPU = "CPU saturation"
RULE_THERMAL = "Thermal envelope"
RULE_POWER = "Power spike"
RULE_STATE = "Operational state"
CPU_LIMIT = 90
OUTLET_WARNING = 34
OUTLET_CRITICAL = 36
POWER_WARNING_FACTOR = "1.08"
POWER_CRITICAL_FACTOR = "1.18"
ALERT_STATES = ["maintenance", "standby"]
MSG_CPU = "%s CPU at %s%%"
MSG_THERMAL = "%s outlet temp at %s C"
MSG_POWER = "%s draw at %s W"
MSG_STATE = "%s currently in %s state"
# ---------------------------------------------------------------------------

ALERT_COLUMNS = ["ts", "room_id", "room_name", "rack_id", "rack_name", "asset_id", "asset_name",
                 "severity", "rule_name", "message", "metric_value", "threshold"]

ASSET_COLUMNS = ["asset_id", "asset_name", "room_id", "room_name", "rack_id", "rack_name",
                 "nominal_power_w"]


def _fired(cond: Column, severity: Column, rule: str, message: Column, value: Column,
           threshold: Column) -> Column:
    return F.when(cond, F.struct(severity.alias("severity"), F.lit(rule).alias("rule_name"),
                                 message.alias("message"), value.cast("double").alias("metric_value"),
                                 threshold.cast("double").alias("threshold")))


def alert_rules(state: DataFrame) -> Column:
    """Array of fired-rule structs for rows carrying latest metrics + asset columns."""
    cpu, outlet, power = F.col("cpu_usage"), F.col("outlet_temp_c"), F.col("power_w")
    nominal, name, op = F.col("nominal_power_w"), F.col("asset_name"), F.col("operational_state")
    cpu_r, outlet_r, power_r = F.round(cpu, 1), F.round(outlet, 1), F.round(power, 0)
    power_warn = nominal * dec(POWER_WARNING_FACTOR)
    power_crit = nominal * dec(POWER_CRITICAL_FACTOR)
    rules = [
        _fired(cpu >= CPU_LIMIT, F.lit("critical"), RULE_CPU,
               F.format_string(MSG_CPU, name, num_text(cpu_r)), cpu_r, F.lit(CPU_LIMIT)),
        _fired(outlet >= OUTLET_WARNING,
               F.when(outlet >= OUTLET_CRITICAL, "critical").otherwise("warning"), RULE_THERMAL,
               F.format_string(MSG_THERMAL, name, num_text(outlet_r)), outlet_r, F.lit(OUTLET_WARNING)),
        _fired(power >= power_warn,
               F.when(power >= power_crit, "critical").otherwise("warning"), RULE_POWER,
               F.format_string(MSG_POWER, name, num_text(power_r)), power_r, F.round(power_warn, 0)),
        _fired(op.isin(ALERT_STATES), F.lit("warning"), RULE_STATE,
               F.format_string(MSG_STATE, name, op), F.lit(1), F.lit(0)),
    ]
    return F.array_compact(F.array(*rules))


def evaluate_alerts(state: DataFrame) -> DataFrame:
    """Explode fired rules of rows that already carry the asset columns."""
    exploded = state.select(*[c for c in ALERT_COLUMNS[:7]], F.explode(alert_rules(state)).alias("a"))
    return exploded.select(*ALERT_COLUMNS[:7], "a.*")


def active_alerts(latest: DataFrame, assets: DataFrame) -> DataFrame:
    """The active-alert view: latest row per asset joined with its asset, all rules."""
    joined = join_dimension(latest, assets.select(*ASSET_COLUMNS), "asset_id")
    return evaluate_alerts(joined)


def alert_feed(alerts: DataFrame, room: str = ALL, rack: str = ALL, server: str = ALL,
               rules=None, limit: int = 25, columns=None, severity_rank: bool = False) -> DataFrame:
    """Newest alerts first, then severity descending, top ``limit``.

    ``severity DESC`` is alphabetical (warning before critical), as in the
    original feed; ``severity_rank=True`` puts critical first instead. Asset
    and rule break the remaining ties so the cut under LIMIT is deterministic.
    """
    df = scope(alerts, room, rack, server)
    if rules is not None:
        df = df.where(F.col("rule_name").isin(list(rules)))
    sev = (F.when(F.col("severity") == "critical", 2).otherwise(1) if severity_rank
           else F.col("severity"))
    df = df.orderBy(F.col("ts").desc(), sev.desc(), F.col("asset_id").asc(), F.col("rule_name").asc())
    df = df.limit(limit)
    return df.select(*(columns or ALERT_COLUMNS))


def alert_count(alerts: DataFrame, room: str = ALL, rack: str = ALL, server: str = ALL,
                as_of=None) -> DataFrame:
    """Number of active alerts in scope (one row: time, value)."""
    df = scope(alerts, room, rack, server)
    return _single(df.agg(F.count(F.lit(1)).cast("double").alias("value")), as_of)


def alert_pressure(alerts: DataFrame, room: str = ALL, rack: str = ALL, server: str = ALL,
                   as_of=None) -> DataFrame:
    """Critical alerts weigh 2, others 1; no alerts -> 0."""
    df = scope(alerts, room, rack, server)
    w = F.when(F.col("severity") == "critical", 2).otherwise(1)
    return _single(df.agg(F.coalesce(F.sum(w), F.lit(0)).cast("double").alias("value")), as_of)


def as_of_column(as_of=None) -> Column:
    """``NOW()`` replacement: an explicit instant, a Column, or the current time."""
    if as_of is None:
        return F.current_timestamp().cast("timestamp_ntz")
    if isinstance(as_of, Column):
        return as_of
    return F.lit(as_of).cast("timestamp_ntz")


def _single(one_row: DataFrame, as_of) -> DataFrame:
    return one_row.select(as_of_column(as_of).alias("time"), "value")
