"""Registered queries: each is ``(spark, sf_dir) -> DataFrame`` over the whole
driver tables, composed from the library's operators."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewatt.operators import alerts as A
from sitewatt.operators.latest import latest_per_key
from sitewatt.session import checkpoint_dir
from sitewatt.sources.fixture import MODEL_TABLES, Fixture, input_signature, materialize_model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


_VIEWS: dict = {}
_LOCK = threading.RLock()


class Ctx:
    """Views shared by the operators of the registered queries, once per session
    and directory: the derived telemetry and assets are written once under
    ``spark.checkpoint.dir`` (date-partitioned, see ``materialize_model``) and
    read back; other fixture tables stay lazy projections of the driver tables."""

    LATEST_METHOD = "max_by"

    def __new__(cls, spark: SparkSession, sf_dir: str):
        key = (id(spark), spark.sparkContext.applicationId, sf_dir, input_signature(spark, sf_dir, MODEL_TABLES))
        with _LOCK:  # one materialisation per key even when queries run in threads
            for old in [k for k in _VIEWS if k[:3] == key[:3] and k != key]:
                del _VIEWS[old]  # a replaced table: views, as_of and memo go together
            return cls._get(spark, sf_dir, key)

    @classmethod
    def _get(cls, spark: SparkSession, sf_dir: str, key):
        if key not in _VIEWS:
            self = super().__new__(cls)
            self.fx = Fixture(spark, sf_dir)
            stored = materialize_model(spark, sf_dir, checkpoint_dir(spark))
            self.tm_stored = stored["telemetry_metrics"]       # with the date partition column dt
            self.tm = self.tm_stored.drop("dt")
            self.assets = stored["assets"]
            self._memo = {}
            _VIEWS[key] = self
        return _VIEWS[key]

    def __init__(self, spark: SparkSession, sf_dir: str):
        pass

    def _once(self, name, build):
        if name not in self._memo:
            self._memo[name] = build()
        return self._memo[name]

    @property
    def latest(self) -> DataFrame:
        return self.latest_of(*[c for c in self.tm.columns if c not in ("ts", "asset_id")])

    def latest_of(self, *columns: str) -> DataFrame:
        """Latest row per asset with only the ``columns`` a panel needs: the
        aggregate's struct would otherwise keep the scan from being pruned."""
        facts = self.tm_stored.select("ts", "asset_id", *columns, "dt")
        return self._once(("latest", columns), lambda: latest_per_key(
            facts, ["asset_id"], "ts", self.LATEST_METHOD, partition_col="dt").drop("dt"))

    @property
    def as_of(self):
        """Stands in for NOW(): the newest telemetry timestamp, computed once per
        view set (one scalar through the driver) and used as a literal, so the
        panels of a refresh share one instant and no panel re-scans for it."""
        def newest():
            ts = self.tm.agg(F.max("ts")).first()[0]
            return F.lit(ts).cast("timestamp_ntz") if ts is None else F.lit(ts.isoformat(sep=" ")).cast("timestamp_ntz")
        return self._once("as_of", newest)

    @property
    def alerts(self) -> DataFrame:
        return self._once("alerts", lambda: A.active_alerts(self.latest, self.assets))


@query("latest_asset_metrics")
def q_latest(spark, sf_dir):
    return Ctx(spark, sf_dir).latest


@query("active_alerts")
def q_active_alerts(spark, sf_dir):
    return Ctx(spark, sf_dir).alerts


@query("alert_feed")
def q_alert_feed(spark, sf_dir):
    return A.alert_feed(Ctx(spark, sf_dir).alerts, limit=25)


# ---------------------------------------------------------------------------
# Current state: rollups, scoped single values, top-k tables, alert panels.
from sitewatt.operators import rollups as R  # noqa: E402
from sitewatt.operators import topk as K  # noqa: E402

# Scope used by the scoped variants (a room, a rack inside it, a server inside that).
SCOPE_ROOM = "EUROPE"
SCOPE_RACK = "NATION_3"
SCOPE_SERVER = "Customer#000000010"  # in room EUROPE, rack NATION_13
SCOPE_SERVER_RACK = "NATION_13"


@query("rack_rollup")
def q_rack_rollup(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return R.rack_rollup(c.latest, c.assets)


@query("room_rollup")
def q_room_rollup(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return R.room_rollup(c.latest, c.assets)


@query("site_summary")
def q_site_summary(spark, sf_dir):
    return R.site_summary(Ctx(spark, sf_dir).latest)


def _stat(column, fn, digits, **scope_args):
    def run(spark, sf_dir):
        c = Ctx(spark, sf_dir)
        return R.scoped_stat(c.latest_of(column), c.assets, column, fn, digits, as_of=c.as_of, **scope_args)
    return run


QUERIES["site_power"] = _stat("power_w", "sum", 1)
QUERIES["avg_cpu"] = _stat("cpu_usage", "avg", 1)
QUERIES["avg_inlet"] = _stat("inlet_temp_c", "avg", 1)
QUERIES["current_co2"] = _stat("carbon_kg", "sum", 3)
QUERIES["peak_outlet"] = _stat("outlet_temp_c", "max", 1)
QUERIES["avg_emission_factor"] = _stat("emission_factor_kg_per_kwh", "avg", 3)
QUERIES["site_power_room_scope"] = _stat("power_w", "sum", 1, room=SCOPE_ROOM)
QUERIES["avg_cpu_rack_scope"] = _stat("cpu_usage", "avg", 1, room=SCOPE_ROOM, rack=SCOPE_RACK)


@query("rack_power")
def q_rack_power(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return R.rack_power(c.latest_of("power_w"), c.assets)


@query("rack_power_room_scope")
def q_rack_power_room(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return R.rack_power(c.latest_of("power_w"), c.assets, room=SCOPE_ROOM)


@query("rack_stress")
def q_rack_stress(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return R.rack_stress(c.latest_of("cpu_usage", "outlet_temp_c"), c.assets)


@query("rack_carbon")
def q_rack_carbon(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return R.rack_carbon(c.latest_of("carbon_kg"), c.assets)


@query("footprint")
def q_footprint(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return R.footprint(c.latest_of("power_w", "carbon_kg"), c.assets)


@query("assets_in_scope")
def q_assets_in_scope(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return R.assets_in_scope(c.assets, as_of=c.as_of)


@query("assets_in_room_scope")
def q_assets_in_room(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return R.assets_in_scope(c.assets, room=SCOPE_ROOM, as_of=c.as_of)


@query("high_carbon_assets")
def q_high_carbon(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return R.high_carbon_count(c.latest_of("carbon_kg"), c.assets, 0.018, as_of=c.as_of)


@query("alert_count")
def q_alert_count(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return A.alert_count(c.alerts, as_of=c.as_of)


@query("alert_pressure")
def q_alert_pressure(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return A.alert_pressure(c.alerts, as_of=c.as_of)


@query("alert_pressure_room_scope")
def q_alert_pressure_room(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return A.alert_pressure(c.alerts, room=SCOPE_ROOM, as_of=c.as_of)


FEED_SHORT = ["ts", "asset_name", "severity", "rule_name", "message"]
FEED_CARBON = ["ts", "room_name", "rack_name", "asset_name", "severity", "message"]
CARBON_RULES = ["Power spike", "Thermal envelope", "Operational state"]


@query("analytics_alert_feed")
def q_analytics_feed(spark, sf_dir):
    return A.alert_feed(Ctx(spark, sf_dir).alerts, limit=20, columns=FEED_SHORT)


@query("carbon_alert_watch")
def q_carbon_watch(spark, sf_dir):
    return A.alert_feed(Ctx(spark, sf_dir).alerts, rules=CARBON_RULES, limit=20, columns=FEED_CARBON)


@query("hottest_assets")
def q_hottest(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return K.hottest_assets(c.latest, c.assets, 15)


@query("top_power_assets")
def q_top_power(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return K.top_power_assets(c.latest, c.assets, 20)


@query("top_carbon_assets")
def q_top_carbon(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return K.top_carbon_assets(c.latest, c.assets, 20)


@query("live_status")
def q_live_status(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return K.live_status(c.latest, c.assets, 25)


@query("live_status_room_scope")
def q_live_status_room(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return K.live_status(c.latest, c.assets, 25, room=SCOPE_ROOM)


# ---------------------------------------------------------------------------
# Trends, forecast, KPI pipeline and its readers.
from sitewatt.operators import timeseries as TS  # noqa: E402
from sitewatt.operators import kpi as KPI  # noqa: E402
from sitewatt.operators.latest import latest_row  # noqa: E402


def _series(series, scoped=True, **scope_args):
    def run(spark, sf_dir):
        c = Ctx(spark, sf_dir)
        return TS.bucket_series(c.tm, c.assets if scoped else None, series, **scope_args)
    return run


QUERIES["power_trend"] = _series(TS.series("power_draw"))
QUERIES["power_trend_room_scope"] = _series(TS.series("power_draw"), room=SCOPE_ROOM)
QUERIES["observed_power_trend"] = _series(TS.series("observed_power"))
QUERIES["cpu_trend"] = _series(TS.series("average_cpu"))
QUERIES["carbon_trend"] = _series(TS.series("co2_estimate"))
QUERIES["thermal_envelope"] = _series(TS.series("inlet_temp", "outlet_temp"))
QUERIES["cpu_thermal_drift"] = _series(TS.series("cpu_percent", "outlet_temp"))
QUERIES["grid_mix_thermal"] = _series(TS.series("emission_factor", "outlet_temp"))
QUERIES["thermal_envelope_rack_scope"] = _series(TS.series("inlet_temp", "outlet_temp"),
                                                 room=SCOPE_ROOM, rack=SCOPE_RACK)


@query("thermal_envelope_wide")
def q_thermal_wide(spark, sf_dir):
    long = QUERIES["thermal_envelope"](spark, sf_dir)
    return TS.to_wide(long, ["Inlet Temp", "Outlet Temp"], ["inlet_temp", "outlet_temp"])


@query("power_trend_per_snapshot")
def q_power_per_snapshot(spark, sf_dir):
    return TS.per_snapshot_bucket(Ctx(spark, sf_dir).tm, "power_w", 1, label="Power Draw")


@query("actual_vs_predicted")
def q_actual_vs_predicted(spark, sf_dir):
    return TS.actual_vs_predicted(Ctx(spark, sf_dir).tm, "Extended XGBoost")


@query("actual_vs_predicted_lstm")
def q_actual_vs_predicted_lstm(spark, sf_dir):
    return TS.actual_vs_predicted(Ctx(spark, sf_dir).tm, "LSTM")


@query("forecast_15m")
def q_forecast_15m(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return TS.forecast(c.tm_stored, c.assets, c.as_of, "15 minutes", partition_col="dt")


@query("forecast_6h")
def q_forecast_6h(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return TS.forecast(c.tm_stored, c.assets, c.as_of, "6 hours", partition_col="dt")


@query("forecast_6h_room_scope")
def q_forecast_6h_room(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return TS.forecast(c.tm_stored, c.assets, c.as_of, "6 hours", room=SCOPE_ROOM, partition_col="dt")


def _kpi_stored(c: Ctx) -> DataFrame:
    """The KPI snapshot table, written once per content of the inputs: its readers
    never scan the facts."""
    def build():
        from sitewatt.sources.fixture import materialize_derived
        spark = c.tm.sparkSession
        return materialize_derived(spark, c.fx.sf_dir, checkpoint_dir(spark), "sustainability_kpi_snapshots",
                                   lambda: KPI.kpi_snapshots(c.tm).withColumn("dt", F.to_date("ts")), "dt")
    return c._once("kpi", build)


def _kpi(c: Ctx) -> DataFrame:
    return _kpi_stored(c).drop("dt")


def _latest_kpi(c: Ctx) -> DataFrame:
    return c._once("latest_kpi", lambda: latest_row(_kpi(c)))


@query("kpi_snapshots")
def q_kpi_snapshots(spark, sf_dir):
    return KPI.as_double(_kpi(Ctx(spark, sf_dir)))


@query("kpi_inputs")
def q_kpi_inputs(spark, sf_dir):
    return R.kpi_inputs(Ctx(spark, sf_dir).tm).select(
        "ts", F.col("it_power_w").cast("double").alias("it_power_w"), "avg_inlet", "avg_outlet", "avg_ef",
        "warning_pressure", F.col("sum_cpu").cast("double").alias("sum_cpu"), "rows")


for _col in ["pue", "ref", "erf", "cef", "co2_savings_kg", "ppw", "cue"]:
    QUERIES[f"latest_{_col}"] = (lambda col: lambda spark, sf_dir: KPI.latest_kpi(_kpi(Ctx(spark, sf_dir)), col))(_col)


def _kpi_series(name):
    def run(spark, sf_dir):
        return TS.bucket_series(_kpi(Ctx(spark, sf_dir)).withColumn("asset_id", F.lit(None)), None,
                                TS.series(name))
    return run


QUERIES["pue_trend"] = _kpi_series("pue")
QUERIES["co2_trend"] = _kpi_series("co2_emissions")
QUERIES["ref_trend"] = _kpi_series("ref")
QUERIES["co2_savings_trend"] = _kpi_series("co2_savings")


@query("baseline_vs_current_co2")
def q_baseline_vs_current(spark, sf_dir):
    return KPI.baseline_vs_current(_latest_kpi(Ctx(spark, sf_dir)))


@query("advanced_kpis")
def q_advanced(spark, sf_dir):
    return KPI.advanced_kpis(_latest_kpi(Ctx(spark, sf_dir)))


@query("kpi_metric_export")
def q_kpi_export(spark, sf_dir):
    from sitewatt.operators.sinks import export_metrics
    return export_metrics(KPI.kpi_long(_latest_kpi(Ctx(spark, sf_dir))))


def _range_avg(column, digits):
    def run(spark, sf_dir):
        c = Ctx(spark, sf_dir)
        return R.range_avg(_kpi(c), column, digits, as_of=c.as_of)
    return run


QUERIES["avg_facility_power"] = _range_avg("total_facility_power_w", 1)
QUERIES["avg_co2"] = _range_avg("total_co2_kg", 3)
QUERIES["avg_ppw"] = _range_avg("ppw", 3)


@query("average_metrics")
def q_average_metrics(spark, sf_dir):
    return R.range_avgs_long(_kpi(Ctx(spark, sf_dir)))


@query("average_metrics_detail")
def q_average_metrics_detail(spark, sf_dir):
    return R.range_avgs_wide(_kpi(Ctx(spark, sf_dir)))


# ---------------------------------------------------------------------------
# Sources registry, options, workflow stages, bands, model scoring, data quality.
from sitewatt.operators import registry as REG  # noqa: E402
from sitewatt.operators import models as MOD  # noqa: E402
from sitewatt.operators import quality as DQ  # noqa: E402
from sitewatt.operators.sinks import fact_stats  # noqa: E402
from sitewatt.functions.bands import band  # noqa: E402
from sitewatt.sources.fixture import raw_samples  # noqa: E402

SELECTED_SOURCE = "Supplier#000000001"


def _freshness(c: Ctx) -> DataFrame:
    return c._once("freshness", lambda: REG.source_freshness(c.fx.sources, c.tm.select("ts")))


@query("source_freshness")
def q_source_freshness(spark, sf_dir):
    return _freshness(Ctx(spark, sf_dir))


@query("selected_source_status")
def q_selected_source(spark, sf_dir):
    return REG.source_status(_freshness(Ctx(spark, sf_dir)), SELECTED_SOURCE)


@query("last_sync_epoch")
def q_last_sync(spark, sf_dir):
    return REG.last_sync_epoch(_freshness(Ctx(spark, sf_dir)), SELECTED_SOURCE)


@query("visible_sources")
def q_visible_sources(spark, sf_dir):
    return REG.list_sources(Ctx(spark, sf_dir).fx.sources, "user_visible")


@query("user_added_sources")
def q_user_added(spark, sf_dir):
    return REG.list_sources(Ctx(spark, sf_dir).fx.sources, "user_added")


@query("room_options")
def q_room_options(spark, sf_dir):
    return REG.room_options(Ctx(spark, sf_dir).fx.rooms)


@query("rack_options")
def q_rack_options(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return REG.rack_options(c.fx.racks, c.fx.rooms)


@query("rack_options_room_scope")
def q_rack_options_room(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return REG.rack_options(c.fx.racks, c.fx.rooms, SCOPE_ROOM)


@query("asset_options_rack_scope")
def q_asset_options(spark, sf_dir):
    return REG.asset_options(Ctx(spark, sf_dir).assets, SCOPE_ROOM, SCOPE_RACK)


@query("asset_options")
def q_asset_options_all(spark, sf_dir):
    return REG.asset_options(Ctx(spark, sf_dir).assets)


@query("source_options")
def q_source_options(spark, sf_dir):
    return REG.source_options(Ctx(spark, sf_dir).fx.sources)


@query("source_ip")
def q_source_ip(spark, sf_dir):
    return REG.source_ip(Ctx(spark, sf_dir).fx.sources, SELECTED_SOURCE)


@query("workflow_stage_status")
def q_stage_status(spark, sf_dir):
    return REG.stage_status(Ctx(spark, sf_dir).fx.runs)


@query("rack_power_bands")
def q_rack_power_bands(spark, sf_dir):
    return q_rack_power(spark, sf_dir).withColumn("colour", band("value", "rack_power_w"))


@query("power_predictions")
def q_power_predictions(spark, sf_dir):
    p = MOD.predict_all_models(Ctx(spark, sf_dir).tm)
    return p.withColumn("predicted_power_w", F.col("predicted_power_w").cast("double"))


@query("fact_stats")
def q_fact_stats(spark, sf_dir):
    return fact_stats(Ctx(spark, sf_dir).tm)


@query("dq_telemetry_nulls")
def q_dq_nulls(spark, sf_dir):
    return DQ.check_not_null(Ctx(spark, sf_dir).tm)


@query("dq_duplicate_samples")
def q_dq_duplicates(spark, sf_dir):
    return DQ.check_unique(raw_samples(Ctx(spark, sf_dir).fx.table("events")), ["ts", "asset_id"])


@query("dq_orphan_telemetry")
def q_dq_orphans(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return DQ.check_fk(c.tm, c.assets, ["asset_id"])


@query("dq_orphan_assets")
def q_dq_orphan_assets(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return DQ.check_fk(c.assets, c.fx.racks, ["rack_id"])


# ---------------------------------------------------------------------------
# Enrichment of measured samples (emission factor, carbon, status).
from sitewatt.operators.enrich import enrich_telemetry  # noqa: E402


@query("enriched_telemetry")
def q_enriched(spark, sf_dir):
    """Every raw event as a measured sample at its own (minute-resolution)
    time, enriched with the time-of-day emission factor, carbon and status."""
    c = Ctx(spark, sf_dir)
    s = raw_samples(c.fx.table("events"))
    measured = s.select(
        F.col("event_ts").alias("ts"), "asset_id", "event_id",
        (F.col("cpu_c") / 100).alias("cpu_usage"), (F.col("power_c") / 100).alias("power_w"),
        (F.col("inlet_c") / 100).alias("inlet_temp_c"), (F.col("outlet_c") / 100).alias("outlet_temp_c"),
        F.col("state").alias("operational_state"))
    out = enrich_telemetry(measured.drop("event_id"), c.assets)
    return out.select(*[F.col(x).cast("double").alias(x) if x not in ("ts", "asset_id", "status_level", "operational_state")
                        else F.col(x) for x in out.columns])


# ---------------------------------------------------------------------------
# Remaining reducers and variants.
from sitewatt.operators.latest import last_not_null  # noqa: E402


@query("pue_last_not_null")
def q_pue_last_not_null(spark, sf_dir):
    k = _kpi(Ctx(spark, sf_dir)).select("ts", F.col("pue").cast("double").alias("pue"))
    return last_not_null(k, "pue")


@query("power_bounds")
def q_power_bounds(spark, sf_dir):
    return R.min_max_bounds(Ctx(spark, sf_dir).tm, "power_w").select(
        F.col("min_power_w").cast("double").alias("min_power_w"),
        F.col("max_power_w").cast("double").alias("max_power_w"))


@query("alert_feed_ranked")
def q_alert_feed_ranked(spark, sf_dir):
    return A.alert_feed(Ctx(spark, sf_dir).alerts, limit=25, severity_rank=True)


@query("forecast_6h_site_level")
def q_forecast_site(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return TS.forecast(c.tm_stored, c.assets, c.as_of, "6 hours", level="site", partition_col="dt")


@query("cpu_trend_server_scope")
def q_cpu_trend_server(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return TS.bucket_series(c.tm, c.assets, TS.series("average_cpu"),
                            room=SCOPE_ROOM, rack=SCOPE_SERVER_RACK, server=SCOPE_SERVER)


@query("hottest_assets_rack_scope")
def q_hottest_rack(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return K.hottest_assets(c.latest, c.assets, 15, room=SCOPE_ROOM, rack=SCOPE_RACK)


@query("latest_kpi_bands")
def q_latest_kpi_bands(spark, sf_dir):
    """Newest KPI values with the colour of each metric's own step list."""
    from sitewatt.functions.bands import band_by_metric
    newest = _latest_kpi(Ctx(spark, sf_dir))
    long = KPI.kpi_long(newest, [(c, c) for c in BAND_KPIS], prefix="")
    return long.select("metric_name", F.round("metric_value", 3).alias("value")).select(
        "metric_name", "value", band_by_metric("metric_name", "value", {c: c for c in BAND_KPIS}).alias("colour"))


BAND_KPIS = ["pue", "ref", "erf", "cef", "co2_savings_kg", "ppw", "cue"]


# ---------------------------------------------------------------------------
# Trends served from the stored bucket rollup (derived once from the facts).
def _rollup(c: Ctx) -> DataFrame:
    def build():
        from sitewatt.sources.fixture import materialize_derived
        return materialize_derived(c.tm.sparkSession, c.fx.sf_dir, checkpoint_dir(c.tm.sparkSession),
                                   "bucket_rollup_5m", lambda: TS.bucket_partials(c.tm, "5 minutes"))
    return c._once("rollup", build)


@query("power_trend_from_rollup")
def q_power_trend_rollup(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return TS.series_from_partials(_rollup(c), c.assets, TS.series("power_draw"))


@query("thermal_envelope_from_rollup_room_scope")
def q_thermal_rollup_room(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return TS.series_from_partials(_rollup(c), c.assets, TS.series("inlet_temp", "outlet_temp"),
                                   room=SCOPE_ROOM)


@query("peak_outlet_trend_from_rollup")
def q_peak_outlet_rollup(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return TS.series_from_partials(_rollup(c), c.assets, [("Peak Outlet", "outlet_temp_c", "max", 1),
                                                          ("Lowest Inlet", "inlet_temp_c", "min", 1)])

from sitewatt.plans import history  # noqa: E402, F401
