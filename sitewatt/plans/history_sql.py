"""DuckDB SQL of the queries over time (``sitewatt.plans.history``)."""

from __future__ import annotations

from sitewatt.plans.oracle import (
    FIXTURE_CTES,
    KPI_CTES,
    MODEL_COEFS,
    ORACLE,
    SCOPE_ROOM,
    _TM_COLS,
    _bucket,
    _coefs_for,
    _filters,
    _rollup,
    register,
    register_kpi,
    xavg,
)

AS_OF = "2024-01-15 12:00:00"
_REPLAYED = "TIMESTAMP '2024-01-01' + to_minutes(18 * date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)))"
_STATE_AS_OF = f"""
state AS (
  SELECT DISTINCT ON (asset_id) * FROM telemetry_metrics WHERE ts <= TIMESTAMP '{AS_OF}' ORDER BY asset_id, ts DESC
)"""


def _with(ctes: str, select_sql: str) -> str:
    return "WITH " + FIXTURE_CTES.strip() + "," + ctes + "\n" + select_sql.strip()


ORACLE["latest_asset_metrics_as_of"] = _with(_STATE_AS_OF, "SELECT * FROM state")
ORACLE["rack_rollup_as_of"] = _with(_STATE_AS_OF, _rollup(
    ["room_id", "room_name", "rack_id", "rack_name"], "rack_power_w", "rack_carbon_kg").replace("latest_asset_metrics l", "state l"))
ORACLE["asset_state_as_of"] = _with(f"""
calls AS (SELECT o_orderkey AS run_id, o_custkey AS asset_id, {_REPLAYED} AS as_of FROM orders)""", """
SELECT c.run_id, c.asset_id, c.as_of, t.ts, CAST(t.cpu_usage AS DOUBLE) AS cpu_usage, CAST(t.power_w AS DOUBLE) AS power_w,
  CAST(t.outlet_temp_c AS DOUBLE) AS outlet_temp_c, t.status_level, t.operational_state
FROM calls c ASOF LEFT JOIN telemetry_metrics t ON c.asset_id = t.asset_id AND c.as_of >= t.ts""")

# ---------------------------------------------------------------------------
# Ranges.
_RANGES = f"""
ranges AS (SELECT DISTINCT {_REPLAYED} AS "start", {_REPLAYED} + INTERVAL 6 HOURS AS "end" FROM orders)"""
ORACLE["range_metrics"] = _with(_RANGES, """
SELECT r."start", r."end", COUNT(t.ts) AS samples, CAST(COALESCE(SUM(power_w), 0) AS DOUBLE) AS power_w,
  CAST(COALESCE(SUM(carbon_kg), 0) AS DOUBLE) AS carbon_kg, CAST(SUM(cpu_usage) AS DOUBLE) / COUNT(cpu_usage) AS avg_cpu_usage,
  CAST(SUM(inlet_temp_c) AS DOUBLE) / COUNT(inlet_temp_c) AS avg_inlet_temp_c,
  CAST(SUM(outlet_temp_c) AS DOUBLE) / COUNT(outlet_temp_c) AS avg_outlet_temp_c
FROM ranges r LEFT JOIN telemetry_metrics t ON t.ts BETWEEN r."start" AND r."end" GROUP BY ALL""")
_KPI_AVG = {"avg_pue": "pue", "avg_ref": "ref", "avg_erf": "erf", "avg_cue": "cue", "avg_co2_savings": "co2_savings_kg",
            "avg_ppw": "ppw", "avg_power": "total_facility_power_w", "avg_carbon": "total_co2_kg"}
ORACLE["range_kpi_averages"] = ("WITH " + FIXTURE_CTES.strip() + ",\n" + KPI_CTES.strip() + "," + _RANGES + """
SELECT r."start", r."end", COUNT(k.ts) AS snapshots, """
    + ", ".join(f"CAST(SUM({c}) AS DOUBLE) / COUNT({c}) AS {n}" for n, c in _KPI_AVG.items()) + """
FROM ranges r LEFT JOIN sustainability_kpi_snapshots k ON k.ts BETWEEN r."start" AND r."end" GROUP BY ALL""")


def _since(hours: int, ts: str = "ts") -> str:
    return f"{ts} >= (SELECT now FROM as_of) - INTERVAL {hours} HOURS AND {ts} <= (SELECT now FROM as_of)"


def _in_range(name, hours, labels, **scope):
    register(name, _bucket(labels, f"{_filters(**scope)} AND {_since(hours)}"))


_avg = lambda c, d: xavg(f"tm.{c}", 4, d)
_in_range("power_trend_6h", 6, [("Power Draw", "ROUND(SUM(tm.power_w), 1)")])
_in_range("power_trend_24h_room_scope", 24, [("Power Draw", "ROUND(SUM(tm.power_w), 1)")], room=SCOPE_ROOM)
_in_range("thermal_envelope_24h", 24, [("Inlet Temp", _avg("inlet_temp_c", 1)), ("Outlet Temp", _avg("outlet_temp_c", 1))])
_in_range("cpu_thermal_drift_6h", 6, [("CPU %", _avg("cpu_usage", 1)), ("Outlet Temp", _avg("outlet_temp_c", 1))])
_in_range("carbon_trend_24h", 24, [("CO2 Estimate", "ROUND(SUM(tm.carbon_kg), 3)")])
ORACLE["actual_vs_predicted_24h"] = ("WITH " + FIXTURE_CTES.strip() + ",\n" + MODEL_COEFS.strip() + "," + _coefs_for("Extended XGBoost") + f""",
scored AS (
  SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS time, power_w,
    power_w * a + cpu_usage * b + (outlet_temp_c - inlet_temp_c) * c + (inlet_temp_c - 1.6) * d AS predicted_w
  FROM telemetry_metrics, coefs WHERE {_since(24)}
)
SELECT time, unnest(['Actual Power', 'Predicted Power']) AS metric,
  unnest([CAST(ROUND(SUM(power_w), 1) AS DOUBLE), CAST(ROUND(SUM(predicted_w), 1) AS DOUBLE)]) AS value
FROM scored GROUP BY time""")
register_kpi("average_metrics_detail_24h", "SELECT " + ", ".join(
    f"{xavg(c, 4, 1 if n == 'avg_power' else 3)} AS {n}" for n, c in _KPI_AVG.items())
    + f" FROM sustainability_kpi_snapshots WHERE {_since(24)}")
register_kpi("avg_facility_power_6h", f"""
SELECT (SELECT now FROM as_of) AS time, {xavg('total_facility_power_w', 4, 1)} AS value
FROM sustainability_kpi_snapshots WHERE {_since(6)}""")


# ---------------------------------------------------------------------------
# Backtests, episodes, levels, tops.
def _backtest(key: str, horizon: int) -> str:
    frame = lambda lo, hi: f"OVER (PARTITION BY {key} ORDER BY s RANGE BETWEEN {lo} AND {hi})"
    mean = lambda lo, hi: f"CAST(SUM(total) {frame(lo, hi)} AS DOUBLE) / SUM(n) {frame(lo, hi)}"
    return _with(f"""
buckets AS (
  SELECT {key}, time_bucket(INTERVAL 5 MINUTE, ts) AS time, SUM(power_w) AS total, COUNT(power_w) AS n,
         CAST(epoch(time_bucket(INTERVAL 5 MINUTE, ts)) AS BIGINT) AS s
  FROM telemetry_metrics JOIN assets USING (asset_id) GROUP BY ALL
),
means AS (
  SELECT {key}, time, {mean(f'{horizon} PRECEDING', '1 PRECEDING')} AS current_avg,
    {mean(f'{2 * horizon} PRECEDING', f'{horizon + 1} PRECEDING')} AS previous_avg,
    {mean('CURRENT ROW', f'{horizon - 1} FOLLOWING')} AS actual
  FROM buckets
),
lines AS (SELECT *, COALESCE(current_avg + (current_avg - previous_avg), current_avg, 0) AS forecast FROM means)""", f"""
SELECT {key}, time, current_avg, previous_avg, forecast, actual, actual - forecast AS error FROM lines""")


ORACLE["forecast_backtest"] = _backtest("rack_name", 6 * 3600)
ORACLE["forecast_backtest_room_1h"] = _backtest("room_name", 3600)
ORACLE["alert_episodes"] = _with("""
judged AS (
  SELECT t.asset_id, t.ts, unnest([
    {'rule': 'CPU saturation', 'fires': t.cpu_usage >= 90, 'critical': TRUE, 'v': CAST(ROUND(t.cpu_usage, 1) AS DOUBLE)},
    {'rule': 'Thermal envelope', 'fires': t.outlet_temp_c >= 34, 'critical': t.outlet_temp_c >= 36,
     'v': CAST(ROUND(t.outlet_temp_c, 1) AS DOUBLE)},
    {'rule': 'Power spike', 'fires': t.power_w >= a.nominal_power_w * 1.08, 'critical': t.power_w >= a.nominal_power_w * 1.18,
     'v': CAST(ROUND(t.power_w, 0) AS DOUBLE)},
    {'rule': 'Operational state', 'fires': t.operational_state IN ('maintenance', 'standby'), 'critical': FALSE, 'v': 1.0}]) AS c
  FROM telemetry_metrics t JOIN assets a USING (asset_id)
),
edges AS (
  SELECT asset_id, c.rule AS rule_name, ts, c.fires AS fires, c.critical AS critical, c.v AS v,
    CASE WHEN lag(c.fires) OVER w AND ts - lag(ts) OVER w <= INTERVAL 2 DAYS THEN 0 ELSE 1 END AS edge
  FROM judged WINDOW w AS (PARTITION BY asset_id, c.rule ORDER BY ts)
),
numbered AS (SELECT *, SUM(edge) OVER (PARTITION BY asset_id, rule_name ORDER BY ts) AS episode FROM edges WHERE fires)""", """
SELECT asset_id, rule_name, MIN(ts) AS "start", MAX(ts) AS "end", COUNT(*) AS samples, MAX(v) AS peak,
  CASE WHEN bool_or(critical) THEN 'critical' ELSE 'warning' END AS severity
FROM numbered GROUP BY asset_id, rule_name, episode""")
register("rollup_all_levels", f"""
SELECT CASE grouping(a.room_id, a.rack_id) WHEN 0 THEN 'rack' WHEN 1 THEN 'room' ELSE 'site' END AS level,
  a.room_id, a.room_name, a.rack_id, a.rack_name, MAX(l.ts) AS ts, COUNT(*) AS assets,
  {xavg('l.cpu_usage', 4, 2)} AS avg_cpu_usage, CAST(ROUND(SUM(l.power_w), 2) AS DOUBLE) AS power_w,
  {xavg('l.inlet_temp_c', 4, 2)} AS avg_inlet_temp_c, {xavg('l.outlet_temp_c', 4, 2)} AS avg_outlet_temp_c,
  CAST(ROUND(SUM(l.carbon_kg), 4) AS DOUBLE) AS carbon_kg,
  COUNT(*) FILTER (WHERE l.status_level = 'critical') AS critical_assets,
  COUNT(*) FILTER (WHERE l.status_level = 'warning') AS warning_assets
FROM latest_asset_metrics l JOIN assets a USING (asset_id)
GROUP BY GROUPING SETS ((a.room_id, a.room_name, a.rack_id, a.rack_name), (a.room_id, a.room_name), ())""")
register("top_power_per_rack", """
SELECT rack_name, ROW_NUMBER() OVER (PARTITION BY rack_name ORDER BY l.power_w DESC, asset_id) AS rank,
  a.asset_name AS server, a.asset_type AS type, a.rack_name AS rack, CAST(ROUND(l.power_w, 0) AS DOUBLE) AS power_w,
  CAST(ROUND(l.cpu_usage, 1) AS DOUBLE) AS cpu_percent, CAST(ROUND(l.outlet_temp_c, 1) AS DOUBLE) AS outlet_c,
  l.operational_state AS state
FROM latest_asset_metrics l JOIN assets a USING (asset_id) QUALIFY rank <= 5""")
register("hottest_per_room", """
SELECT room_name, ROW_NUMBER() OVER (PARTITION BY room_name ORDER BY l.outlet_temp_c DESC, asset_id) AS rank,
  a.asset_name AS server, a.room_name AS room, a.rack_name AS rack, CAST(ROUND(l.outlet_temp_c, 1) AS DOUBLE) AS outlet_c,
  CAST(ROUND(l.cpu_usage, 1) AS DOUBLE) AS cpu_percent, l.status_level AS status
FROM latest_asset_metrics l JOIN assets a USING (asset_id) QUALIFY rank <= 3""")


# ---------------------------------------------------------------------------
# Ingestion.
ORACLE["ingest_quality"] = _with("""
sent AS (SELECT ts, asset_id, COUNT(*) AS copies FROM raw GROUP BY ts, asset_id)""", f"""
SELECT COUNT(*) AS rows, (SELECT COUNT(*) FROM raw) AS samples, {", ".join(f"COUNT(*) - COUNT({c}) AS {c}_nulls" for c in _TM_COLS)},
  (SELECT COUNT(*) FROM raw) - COUNT(*) AS copies, (SELECT COUNT(*) FROM sent WHERE copies > 1) AS repeated_keys,
  COUNT(*) FILTER (WHERE asset_id IS NOT NULL AND asset_id NOT IN (SELECT asset_id FROM assets)) AS orphans,
  COUNT(*) FILTER (WHERE asset_id IN (SELECT asset_id FROM assets) AND {" AND ".join(f"{c} IS NOT NULL" for c in _TM_COLS)}) AS valid_rows
FROM telemetry_metrics""")
ORACLE["new_samples"] = _with("""
sent AS (
  SELECT t.* FROM telemetry_metrics t
  WHERE EXISTS (SELECT 1 FROM events e WHERE e.ts >= TIMESTAMP '2024-01-18' AND e.user_id = t.asset_id AND date_trunc('minute', e.ts) = t.ts)
)""", "SELECT * FROM sent WHERE ts >= TIMESTAMP '2024-01-20'")
ORACLE["inventory_upsert"] = """
SELECT c_custkey AS asset_id, c_name AS asset_name, o_orderdate AS last_run_at, o_orderkey AS last_run, o_totalprice AS last_price
FROM customer LEFT JOIN (
  SELECT DISTINCT ON (o_custkey) * FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC
) ON o_custkey = c_custkey"""
