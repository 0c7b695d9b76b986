"""Dashboard refreshes: every panel of a page as a DataFrame, sharing the work.

A page refresh computes the latest state per asset once (persisted: one row per
asset), the active alerts once, and the KPI snapshots once, then builds each
panel from them. This replaces the original pattern of every panel re-running
its own SQL, and the per-panel views re-deriving the latest state four times
(once per alert rule), every 10 seconds.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewatt.operators import accelerators as ACC
from sitewatt.operators import alerts as A
from sitewatt.operators import kpi as KPI
from sitewatt.operators import models as MOD
from sitewatt.operators import registry as REG
from sitewatt.operators import rollups as R
from sitewatt.operators import timeseries as TS
from sitewatt.operators import topk as K
from sitewatt.operators.filters import ALL
from sitewatt.operators.latest import latest_per_key, latest_row

# ---------------------------------------------------------------------------
# Panel series labels and the rules watched by the carbon page.
CARBON_WATCH_RULES = ["Power spike", "Thermal envelope", "Operational state"]
# ---------------------------------------------------------------------------


class Refresh:
    """Shared inputs of one refresh. Use as a context manager so the persisted
    latest state is released afterwards."""

    def __init__(self, telemetry: DataFrame, assets: DataFrame, as_of=None, kpi: DataFrame | None = None,
                 persist: bool = True, latest: DataFrame | None = None, rollup: DataFrame | None = None):
        """``latest`` may be a latest-state table kept by the streaming job
        (``LatestStateTable.current``); otherwise it is derived here. With a
        5-minute ``rollup`` (``bucket_partials``) the trend panels combine its
        partials instead of scanning raw samples."""
        self.rollup = rollup
        self.tm = telemetry
        self.assets = assets
        self.as_of = as_of
        self.latest = latest if latest is not None else latest_per_key(telemetry)
        if persist:
            self.latest = self.latest.persist(StorageLevel.MEMORY_AND_DISK)
        self._persisted = persist
        self.alerts = A.active_alerts(self.latest, assets)
        self._kpi = kpi

    @property
    def kpi(self) -> DataFrame:
        if self._kpi is None:
            self._kpi = KPI.kpi_snapshots(self.tm)
        return self._kpi

    def trend(self, series, start=None, end=None, room=ALL, rack=ALL, server=ALL) -> DataFrame:
        """A 5-minute trend panel, from the rollup when there is one."""
        if self.rollup is not None:
            return TS.series_from_partials(self.rollup, self.assets, series, start, end, room, rack, server)
        return TS.bucket_series(self.tm, self.assets, series, start=start, end=end, room=room, rack=rack,
                                server=server)

    def close(self):
        if self._persisted:
            self.latest.unpersist()

    def __enter__(self):
        return self

    def __exit__(self, *exc):
        self.close()


def overview(r: Refresh, room=ALL, rack=ALL, server=ALL, start=None, end=None) -> dict[str, DataFrame]:
    s = dict(room=room, rack=rack, server=server)
    lat, a, now = r.latest, r.assets, r.as_of
    trend = dict(start=start, end=end, **s)
    return {
        "site_power_draw": R.scoped_stat(lat, a, "power_w", "sum", 1, as_of=now, **s),
        "average_cpu": R.scoped_stat(lat, a, "cpu_usage", "avg", 1, as_of=now, **s),
        "average_inlet_temp": R.scoped_stat(lat, a, "inlet_temp_c", "avg", 1, as_of=now, **s),
        "active_alerts": A.alert_count(r.alerts, as_of=now, **s),
        "current_co2": R.scoped_stat(lat, a, "carbon_kg", "sum", 3, as_of=now, **s),
        "assets_in_scope": R.assets_in_scope(a, as_of=now, **s),
        "power_trend": r.trend(TS.series("power_draw"), **trend),
        "cpu_utilisation_trend": r.trend(TS.series("average_cpu"), **trend),
        "thermal_envelope": r.trend(TS.series("inlet_temp", "outlet_temp"),
                                    **trend),
        "rack_power_contribution": R.rack_power(lat, a, room, rack),
        "active_alert_feed": A.alert_feed(r.alerts, limit=25, **s),
        "live_asset_status": K.live_status(lat, a, 25, **s),
        "avg_power": R.range_avg(r.kpi, "total_facility_power_w", 1, start, end, as_of=now),
        "avg_carbon": R.range_avg(r.kpi, "total_co2_kg", 3, start, end, as_of=now),
        "avg_ppw": R.range_avg(r.kpi, "ppw", 3, start, end, as_of=now),
    }


def analytics(r: Refresh, room=ALL, rack=ALL, server=ALL, start=None, end=None,
              horizon: str = "15 minutes") -> dict[str, DataFrame]:
    s = dict(room=room, rack=rack, server=server)
    lat, a, now = r.latest, r.assets, r.as_of
    trend = dict(start=start, end=end, **s)
    return {
        "current_draw": R.scoped_stat(lat, a, "power_w", "sum", 1, as_of=now, **s),
        "forecast": TS.forecast(r.tm, a, now, horizon, **s),
        "peak_outlet_temp": R.scoped_stat(lat, a, "outlet_temp_c", "max", 1, as_of=now, **s),
        "alert_pressure": A.alert_pressure(r.alerts, as_of=now, **s),
        "power_and_forecast_context": r.trend(TS.series("observed_power"), **trend),
        "cpu_and_thermal_drift": r.trend(TS.series("cpu_percent", "outlet_temp"),
                                         **trend),
        "rack_stress_score": R.rack_stress(lat, a, room, rack),
        "hottest_servers": K.hottest_assets(lat, a, 15, **s),
        "top_power_servers": K.top_power_assets(lat, a, 20, **s),
        "analytics_alert_feed": A.alert_feed(r.alerts, limit=20, columns=["ts", "asset_name", "severity",
                                                                            "rule_name", "message"], **s),
    }


def carbon(r: Refresh, room=ALL, rack=ALL, server=ALL, start=None, end=None) -> dict[str, DataFrame]:
    s = dict(room=room, rack=rack, server=server)
    lat, a, now = r.latest, r.assets, r.as_of
    trend = dict(start=start, end=end, **s)
    return {
        "current_co2": R.scoped_stat(lat, a, "carbon_kg", "sum", 3, as_of=now, **s),
        "emission_factor": R.scoped_stat(lat, a, "emission_factor_kg_per_kwh", "avg", 3, as_of=now, **s),
        "current_power": R.scoped_stat(lat, a, "power_w", "sum", 1, as_of=now, **s),
        "high_carbon_assets": R.high_carbon_count(lat, a, 0.018, as_of=now, **s),
        "estimated_carbon_trend": r.trend(TS.series("co2_estimate"), **trend),
        "grid_mix_and_thermal_context": r.trend(
            TS.series("emission_factor", "outlet_temp"),
            **trend),
        "rack_carbon_contribution": R.rack_carbon(lat, a, room, rack),
        "top_emitting_assets": K.top_carbon_assets(lat, a, 20, **s),
        "carbon_alert_watch": A.alert_feed(r.alerts, rules=CARBON_WATCH_RULES, limit=20,
                                           columns=["ts", "room_name", "rack_name", "asset_name", "severity",
                                                    "message"], **s),
        "room_rack_footprint": R.footprint(lat, a, room, rack),
    }


def sustainability(r: Refresh, start=None, end=None, meta: DataFrame | None = None) -> dict[str, DataFrame]:
    k = r.kpi
    newest = latest_row(k)
    trend = dict(start=start, end=end)
    nul = k.withColumn("asset_id", F.lit(None))
    panels = {f"latest_{c}": KPI.latest_kpi(k, c) for c in ["pue", "ref", "erf", "cef", "co2_savings_kg", "ppw", "cue"]}
    panels.update({
        "pue_trend": TS.bucket_series(nul, None, TS.series("pue"), **trend),
        "co2_trend": TS.bucket_series(nul, None, TS.series("co2_emissions"), **trend),
        "ref_trend": TS.bucket_series(nul, None, TS.series("ref"), **trend),
        "co2_savings_trend": TS.bucket_series(nul, None, TS.series("co2_savings"), **trend),
        "baseline_vs_current_co2": KPI.baseline_vs_current(newest),
        "advanced_kpi_section": KPI.advanced_kpis(newest),
        "metric_export": KPI.kpi_long(newest).select(
            "ts", "metric_name", F.round("metric_value", 4).alias("metric_value")).orderBy("metric_name"),
        "average_metrics": R.range_avgs_long(k, start, end),
        "average_metrics_detail": R.range_avgs_wide(k, start, end),
    })
    if meta is not None:
        panels["kpi_interpretation_guide"] = KPI.kpi_guide(meta)
    return panels


def ai_optimisation(r: Refresh, model: str = "Extended XGBoost", models: DataFrame | None = None,
                    features: DataFrame | None = None, importance: DataFrame | None = None,
                    start=None, end=None) -> dict[str, DataFrame]:
    panels = {"actual_vs_predicted_power": TS.actual_vs_predicted(r.tm, model, start=start, end=end)}
    if models is not None:
        panels["energy_by_model"] = MOD.model_energy(models)
        panels["accuracy_vs_energy"] = MOD.model_tradeoff(models)
    if features is not None:
        panels["telemetry_feature_inputs"] = MOD.feature_guide(features)
    if importance is not None:
        panels["xgboost_feature_importance"] = MOD.feature_importance(importance, "XGBoost")
    return panels


def accelerators(platforms: DataFrame, scenario: DataFrame, runs: DataFrame) -> dict[str, DataFrame]:
    return {
        "scenario_values": ACC.scenario_values(scenario),
        "training_latency": ACC.platforms_by(platforms, "training_latency_ms"),
        "inference_latency": ACC.platforms_by(platforms, "inference_latency_ms"),
        "performance_per_watt": ACC.platforms_by(platforms, "performance_per_watt"),
        "speedup_comparison": ACC.speedups_long(platforms),
        "before_after_energy": ACC.before_after(scenario, "baseline_energy_j", "optimised_energy_j",
                                                "Baseline energy", "Optimised energy"),
        "before_after_co2": ACC.before_after(scenario, "baseline_co2_kg", "optimised_co2_kg",
                                             "Baseline CO2", "Optimised CO2"),
        "platform_metrics": ACC.platform_table(platforms),
        "workload_stages": REG.stage_status(runs),
    }


def connect(r: Refresh, sources: DataFrame, dc_name: str) -> dict[str, DataFrame]:
    fresh = REG.source_freshness(sources, r.latest)
    return {
        "available_profiles": REG.list_sources(sources, "user_visible"),
        "selected_profile_status": REG.source_status(fresh, dc_name),
        "registry_added_profiles": REG.list_sources(sources, "user_added"),
        "last_sync": REG.last_sync_epoch(fresh, dc_name),
    }


def run_all(panels: dict[str, DataFrame], threads: int = 8, sink: str | None = None) -> dict[str, int | None]:
    """Execute every panel of a refresh. Panels are independent queries, so they
    are submitted concurrently from a thread pool (Spark schedules jobs from
    several threads side by side; with the FAIR scheduler they share executors
    fairly). ``sink=None`` returns row counts; ``sink="noop"`` only executes."""
    from concurrent.futures import ThreadPoolExecutor

    def one(item):
        name, df = item
        if sink:
            df.write.format(sink).mode("overwrite").save()
            return name, None
        return name, df.count()

    with ThreadPoolExecutor(max_workers=max(1, threads)) as pool:
        return dict(pool.map(one, panels.items()))
