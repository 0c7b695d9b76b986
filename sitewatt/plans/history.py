"""Registered queries over time: state at chosen instants, ranges, backtests, episodes, all levels at once."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sitewatt.operators import kpi as KPI
from sitewatt.operators import rollups as R
from sitewatt.operators import timeseries as TS
from sitewatt.operators import topk as K
from sitewatt.operators.asof import asof_join
from sitewatt.operators.episodes import alert_episodes
from sitewatt.operators.key_index import append_absent, key_bitmaps
from sitewatt.operators.keyed_table import KeyedTable
from sitewatt.operators.latest import latest_per_key
from sitewatt.operators.moving import forecast_backtest
from sitewatt.operators.quality import write_checked
from sitewatt.operators.ranges import prefix_sums, range_means, range_sums
from sitewatt.plans.catalog import QUERIES, SCOPE_ROOM, Ctx, _kpi, _kpi_stored, _rollup, query
from sitewatt.session import checkpoint_dir
from sitewatt.sources.fixture import TELEMETRY, input_signature, materialize_derived, replayed, sent_samples

AS_OF = "2024-01-15 12:00:00"
KPI_AVERAGES = {n: c for c, n, _ in R.RANGE_AVGS_WIDE}


def _stored(c: Ctx, name: str, build, partition_col: str | None = None):
    spark = c.tm.sparkSession
    return c._once(name, lambda: materialize_derived(spark, c.fx.sf_dir, checkpoint_dir(spark), name, build, partition_col))


def _doubles(df):
    return df.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


# ---------------------------------------------------------------------------
# State at a chosen instant.
@query("latest_asset_metrics_as_of")
def q_latest_as_of(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return latest_per_key(c.tm_stored, ["asset_id"], "ts", c.LATEST_METHOD, "dt", as_of=AS_OF).drop("dt")


@query("rack_rollup_as_of")
def q_rack_rollup_as_of(spark, sf_dir):
    return R.rack_rollup(q_latest_as_of(spark, sf_dir), Ctx(spark, sf_dir).assets)


@query("asset_state_as_of")
def q_asset_state_as_of(spark, sf_dir):
    """Every order with the state its asset had when the order came in."""
    c = Ctx(spark, sf_dir)
    orders = c.fx.table("orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("asset_id"),
                                         replayed("o_orderdate").alias("as_of"))
    return _doubles(asof_join(orders, c.tm.select("asset_id", "ts", "cpu_usage", "power_w", "outlet_temp_c", "status_level",
                                                  "operational_state"), ["asset_id"]))


# ---------------------------------------------------------------------------
# Any number of time ranges, from prefix sums.
def _ranges(c: Ctx):
    """One range per order date: the six hours from its replayed instant on."""
    start = replayed("o_orderdate")
    return c.fx.table("orders").select(start.alias("start"), (start + F.expr("interval 6 hours")).alias("end"))


@query("range_metrics")
def q_range_metrics(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    columns = ["power_w", "carbon_kg", "cpu_usage", "inlet_temp_c", "outlet_temp_c"]
    totals = range_sums(_stored(c, "telemetry_prefix", lambda: prefix_sums(c.tm, columns), "dt"), _ranges(c))
    return totals.select("start", "end", F.col("n").alias("samples"), F.col("sum_power_w").cast("double").alias("power_w"),
                         F.col("sum_carbon_kg").cast("double").alias("carbon_kg"),
                         *range_means(totals, {f"avg_{m}": m for m in columns[2:]}))


@query("range_kpi_averages")
def q_range_kpi(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    totals = range_sums(_stored(c, "kpi_prefix", lambda: prefix_sums(_kpi(c), KPI_AVERAGES.values()), "dt"), _ranges(c))
    return totals.select("start", "end", F.col("n").alias("snapshots"), *range_means(totals, KPI_AVERAGES))


def _hours(c: Ctx, hours: int) -> dict:
    """The dashboard's range: the last ``hours`` before the newest sample."""
    return {"start": c.as_of - F.expr(f"interval {hours} hours"), "end": c.as_of, "partition_col": "dt"}


def _ranged_trend(hours, *names, **scope_args):
    def run(spark, sf_dir):
        c = Ctx(spark, sf_dir)
        return TS.bucket_series(c.tm_stored, c.assets, TS.series(*names), **_hours(c, hours), **scope_args)
    return run


QUERIES["power_trend_6h"] = _ranged_trend(6, "power_draw")
QUERIES["power_trend_24h_room_scope"] = _ranged_trend(24, "power_draw", room=SCOPE_ROOM)
QUERIES["thermal_envelope_24h"] = _ranged_trend(24, "inlet_temp", "outlet_temp")
QUERIES["cpu_thermal_drift_6h"] = _ranged_trend(6, "cpu_percent", "outlet_temp")
QUERIES["carbon_trend_24h"] = _ranged_trend(24, "co2_estimate")


@query("actual_vs_predicted_24h")
def q_avp_24h(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return TS.actual_vs_predicted(c.tm_stored, "Extended XGBoost", **_hours(c, 24))


@query("average_metrics_detail_24h")
def q_average_detail_24h(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return R.range_avgs_wide(_kpi_stored(c), **_hours(c, 24))


@query("avg_facility_power_6h")
def q_avg_facility_6h(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return R.range_avg(_kpi_stored(c), "total_facility_power_w", 1, as_of=c.as_of, **_hours(c, 6))


# ---------------------------------------------------------------------------
# The forecast of every instant against what came.
def _backtest(key, hours):
    def run(spark, sf_dir):
        c = Ctx(spark, sf_dir)
        buckets = (R.with_assets(_rollup(c).select("asset_id", "time", "sum_power_w", "n_power_w"), c.assets,
                                 columns=("asset_id", "asset_name", "room_name", "rack_name"))
                   .groupBy(key, "time").agg(F.sum("sum_power_w").alias("total"), F.sum("n_power_w").alias("n")))
        return forecast_backtest(buckets, [key], hours * 3600)
    return run


QUERIES["forecast_backtest"] = _backtest("rack_name", 6)
QUERIES["forecast_backtest_room_1h"] = _backtest("room_name", 1)


# ---------------------------------------------------------------------------
# Alert episodes; all levels and all racks at once.
@query("alert_episodes")
def q_alert_episodes(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return alert_episodes(c.tm, c.assets)


@query("rollup_all_levels")
def q_rollup_all_levels(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return R.rollup_all_levels(c.latest, c.assets)


@query("top_power_per_rack")
def q_top_power_per_rack(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return K.top_per_group(c.latest, c.assets, "rack_name", "power_w", 5, K.POWER_SPEC)


@query("hottest_per_room")
def q_hottest_per_room(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return K.top_per_group(c.latest, c.assets, "room_name", "outlet_temp_c", 3, K.HOTTEST_SPEC)


# ---------------------------------------------------------------------------
# Ingestion: checks in flight, first-wins appends against the key index, keyed upserts.
INDEXED_UNTIL, SENT_FROM = "2024-01-20 00:00:00", "2024-01-18 00:00:00"


@query("ingest_quality")
def q_ingest_quality(spark, sf_dir):
    """Counts of one checked load of all events; facts and rejects are written in the same pass."""
    c = Ctx(spark, sf_dir)
    path = f"{checkpoint_dir(spark)}/sitewatt-ingest-{uuid.uuid4().hex}"
    counts = write_checked(sent_samples(c.fx.table("events")), path, ["ts", "asset_id"], "event_id", c.assets, "asset_id", TELEMETRY)
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{k} long" for k in counts))


@query("new_samples")
def q_new_samples(spark, sf_dir):
    """What a batch that re-sends two known days and brings later ones adds to the facts."""
    c = Ctx(spark, sf_dir)
    index = _stored(c, "sample_index", lambda: key_bitmaps(c.tm.where(F.col("ts") < F.lit(INDEXED_UNTIL).cast("timestamp_ntz"))), "dt")
    batch = sent_samples(c.fx.table("events").where(F.col("ts") >= F.lit(SENT_FROM).cast("timestamp_ntz")))
    return append_absent(index, batch, "event_id").select(*TELEMETRY)


@query("inventory_upsert")
def q_inventory_upsert(spark, sf_dir):
    """The asset inventory after two batches of orders were merged into it: every asset with its last run."""
    c = Ctx(spark, sf_dir)

    def build():
        customers, orders = c.fx.table("customer"), c.fx.table("orders")
        key = input_signature(spark, sf_dir, ["customer", "orders"])
        table = KeyedTable(f"{checkpoint_dir(spark)}/sitewatt-model/inventory-{key}", ["asset_id"], "last_run_at", buckets=16)
        names = customers.select(F.col("c_custkey").alias("asset_id"), F.col("c_name").alias("asset_name"))
        runs = (orders.join(names, F.col("o_custkey") == F.col("asset_id"))
                .select("asset_id", "asset_name", F.col("o_orderdate").cast("timestamp_ntz").alias("last_run_at"),
                        F.col("o_orderkey").alias("last_run"), F.col("o_totalprice").alias("last_price")))
        late = F.col("last_run_at") >= F.lit("1998-01-01").cast("timestamp_ntz")
        none = [F.lit(None).cast(t).alias(n) for n, t in runs.dtypes[2:]]
        table.merge(names.select("*", *none))
        table.merge(runs.where(~late))
        table.merge(runs.where(late))
        return table.current(spark)
    return c._once("inventory", build)
