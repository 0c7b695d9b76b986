"""Threshold bands: value -> colour of the highest step not above it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Step lists (base colour, then (threshold, colour) in ascending
# order). A list that starts at red is "higher is better".
STEP_LISTS = {
    "site_power_w": ("green", [(7000, "yellow"), (9500, "red")]),
    "cpu_percent": ("green", [(70, "yellow"), (85, "red")]),
    "inlet_c": ("green", [(24, "yellow"), (27, "red")]),
    "outlet_c": ("green", [(34, "yellow"), (36, "red")]),
    "active_alerts": ("green", [(1, "yellow"), (5, "red")]),
    "alert_pressure": ("green", [(3, "yellow"), (8, "red")]),
    "current_co2_kg": ("green", [(0.22, "yellow"), (0.35, "red")]),
    "forecast_w": ("green", [(8000, "yellow"), (10000, "red")]),
    "rack_power_w": ("green", [(2500, "yellow"), (3200, "red")]),
    "rack_stress": ("green", [(75, "yellow"), (95, "red")]),
    "rack_carbon_kg": ("green", [(0.10, "yellow"), (0.16, "red")]),
    "emission_factor": ("green", [(0.34, "yellow"), (0.40, "red")]),
    "high_carbon_assets": ("green", [(2, "yellow"), (6, "red")]),
    "pue": ("green", [(1.35, "yellow"), (1.55, "red")]),
    "cef": ("green", [(0.32, "yellow"), (0.40, "red")]),
    "cue": ("green", [(0.42, "yellow"), (0.55, "red")]),
    "ref": ("red", [(0.35, "yellow"), (0.55, "green")]),
    "erf": ("red", [(0.10, "yellow"), (0.20, "green")]),
    "co2_savings_kg": ("red", [(0.30, "yellow"), (0.60, "green")]),
    "ppw": ("red", [(1.60, "yellow"), (2.20, "green")]),
    "advanced_kpi": ("red", [(0.55, "yellow"), (0.72, "green")]),
    "energy_saving_percent": ("red", [(15, "yellow"), (30, "green")]),
    "average_metrics": ("red", [(0.35, "yellow"), (0.65, "green")]),
}
# ---------------------------------------------------------------------------


def band(value, steps) -> Column:
    """Colour for ``value`` given ``(base, [(threshold, colour), ...])`` or a
    ``STEP_LISTS`` key. Null values keep the base colour (as a dashboard does)."""
    if isinstance(steps, str):
        steps = STEP_LISTS[steps]
    base, rest = steps
    v = F.col(value) if isinstance(value, str) else value
    out = F.lit(base)
    for threshold, colour in rest:  # later (higher) steps override earlier ones
        out = F.when(v >= F.lit(threshold), F.lit(colour)).otherwise(out)
    return out


def band_by_metric(metric, value, steps_by_metric: dict | None = None, default: str | None = None) -> Column:
    """Table-driven bands for long ``metric, value`` frames: each metric name
    picks its own step list (a ``STEP_LISTS`` key or an explicit list); unknown
    metrics get ``default``. Built as one CASE expression, so no join is needed."""
    steps_by_metric = steps_by_metric or {k: k for k in STEP_LISTS}
    m = F.col(metric) if isinstance(metric, str) else metric
    out = F.lit(default)
    for name, steps in steps_by_metric.items():
        out = F.when(m == F.lit(name), band(value, steps)).otherwise(out)
    return out
