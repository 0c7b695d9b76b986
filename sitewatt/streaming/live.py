"""Structured Streaming forms of the operators (STR-1..8).

The original application polls: a writer appends one snapshot every 10 s and
every panel re-runs its SQL. Here a file (or Kafka) stream is transformed
incrementally; checkpoints live under the shared ``spark.checkpoint.dir`` so a
restarted driver or lost executor resumes from the last committed batch.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewatt.operators.alerts import ASSET_COLUMNS, evaluate_alerts
from sitewatt.operators.enrich import enrich_telemetry
from sitewatt.operators.joins import checked_broadcast
from sitewatt.operators.kpi import kpi_formulas
from sitewatt.operators.keyed_table import KeyedTable
from sitewatt.operators.rollups import kpi_inputs
from sitewatt.operators.sinks import last_wins
from sitewatt.schemas import KPI_COLUMNS, TELEMETRY
from sitewatt.session import checkpoint_dir


def stream_telemetry(spark: SparkSession, path: str, schema=TELEMETRY, fmt: str = "parquet",
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming source over a folder of telemetry files (SRC-3)."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.load(path)


def stream_kafka(spark: SparkSession, servers: str, topic: str, schema=TELEMETRY) -> DataFrame:
    """Kafka connector form (needs the Kafka package on the classpath): JSON
    values parsed with the declared schema."""
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
           .option("subscribe", topic).load())
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("r")).select("r.*")


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need an instant: cast a wall-clock (NTZ) column under UTC."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def dedup_stream(stream: DataFrame, delay: str = "1 hour", keys=("ts", "asset_id")) -> DataFrame:
    """STR-1: drop re-sent samples of a key within the watermark delay. State
    is bounded by the delay; rows later than it are dropped (the monotone
    high-water-mark guard in its scalable form). The first row to *arrive*
    wins; a batch re-ingest should use ``append_first_wins`` instead."""
    return event_time(stream).withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def enrich_stream(raw_stream: DataFrame, assets: DataFrame) -> DataFrame:
    """STR-2: stateless stream-static enrichment (checked-broadcast assets)."""
    return enrich_telemetry(raw_stream, assets)


def trend_stream(stream: DataFrame, series, width: str = "5 minutes", delay: str = "1 hour",
                 watermarked: bool = False) -> DataFrame:
    """STR-3: windowed trend, one row per closed bucket in append mode.
    ``series`` = [(output column, column, "sum"|"avg"|"max"|"min", digits)]."""
    fns = {"sum": F.sum, "max": F.max, "min": F.min,
           "avg": lambda c: F.try_divide(F.sum(c), F.count(c).cast("decimal(20,0)"))}  # exact, as in batch
    s = stream if watermarked else event_time(stream).withWatermark("ts", delay)
    return (s.groupBy(F.window("ts", width).alias("w"))
            .agg(*[F.round(fns[fn](c), d).cast("double").alias(n) for n, c, fn, d in series])
            .select(F.col("w.start").alias("time"), *[n for n, _, _, _ in series]))


def alert_event_stream(stream: DataFrame, assets: DataFrame) -> DataFrame:
    """STR-4: every sample that breaks a rule becomes an alert event. This is an
    event stream, not the active-alert view (which needs the latest row)."""
    j = stream.join(checked_broadcast(assets.select(*ASSET_COLUMNS)), "asset_id")
    return evaluate_alerts(j)


def latest_state_stream(stream: DataFrame) -> DataFrame:
    """STR-5: latest row per asset as a stateful aggregation (complete/update
    mode); the state is one row per asset."""
    return last_wins(stream, ["asset_id"], "ts")


def kpi_stream(stream: DataFrame, delay: str = "1 hour", profile=None, watermarked: bool = False) -> DataFrame:
    """STR-7: KPI snapshot per timestamp once the watermark passes it (append).
    ``watermarked=True`` keeps the watermark an upstream operator already set."""
    s = stream if watermarked else event_time(stream).withWatermark("ts", delay)
    f = kpi_formulas(kpi_inputs(s), profile)
    return f.select("ts", *[F.round(F.col(c), d).cast(f"decimal(18,{d})").alias(c) for c, d in KPI_COLUMNS])


def _listed(spark: SparkSession, path: str) -> list:
    """Entries of a folder through the Hadoop FileSystem (any shared storage); none if it is missing."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [st.getPath() for st in fs.listStatus(hpath)] if fs.exists(hpath) else []


class LatestStateTable(KeyedTable):
    """STR-6: the latest row of every asset, maintained with ``foreachBatch``; batch operators
    (rollups, active alerts, site summary) run on ``current``.

    A micro-batch is reduced to its own latest rows and merged last-wins into the key
    buckets it touches; others are neither read nor written. Versions are numbered by what
    is stored, not by the stream's epochs, so a backfilled state, a new checkpoint or another
    stream never replace what is there, and an epoch that comes again changes nothing.
    """

    def __init__(self, path: str, keys=("asset_id",), ts: str = "ts", buckets: int = 256):
        super().__init__(path, keys, ts, buckets)

    def merge_epoch(self, batch: DataFrame, epoch_id: int | None = None) -> None:
        self.merge(batch)

    def start(self, stream: DataFrame, name: str = "latest_state", trigger: dict | None = None):
        cp = os.path.join(checkpoint_dir(stream.sparkSession), name)
        w = (stream.writeStream.foreachBatch(self.merge_epoch).option("checkpointLocation", cp)
             .queryName(name))
        return w.trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def start_stream(df: DataFrame, name: str, sink: str = "memory", output_mode: str = "append",
                 trigger: dict | None = None, path: str | None = None, partition_by: list[str] | None = None):
    """STR-8: start a query with a checkpoint under ``spark.checkpoint.dir``.
    Default cadence is the 10-second refresh; tests pass ``{"availableNow": True}``."""
    cp = os.path.join(checkpoint_dir(df.sparkSession), name)
    w = df.writeStream.outputMode(output_mode).format(sink).queryName(name).option("checkpointLocation", cp)
    if path:
        w = w.option("path", path)
    if partition_by:
        w = w.partitionBy(*partition_by)
    return w.trigger(**(trigger or {"processingTime": "10 seconds"})).start()


FACTS, KPIS, ROLLUP = "telemetry_metrics", "sustainability_kpi_snapshots", "bucket_rollup_5m"


def _table_path(out_dir: str, part: str, table: str) -> str:
    return f"{out_dir.rstrip('/')}/{part}/{table}"


def read_store(spark: SparkSession, out_dir: str, table: str = FACTS) -> DataFrame | None:
    """History and all live runs of a stored table as one (None where nothing has been written).

    Wall-clock and instant columns meet as instants (the session's zone is UTC). Facts
    of a key that several parts hold (a sample re-sent later) count once, the first part wins.
    """
    runs = sorted(p.toString() for p in _listed(spark, _table_path(out_dir, "live", table)) if p.getName().startswith("run="))
    keys = {FACTS: ["ts", "asset_id"], KPIS: ["ts"]}.get(table)
    whole = None
    for path in [_table_path(out_dir, "history", table), *runs]:
        if not any(not p.getName().startswith(("_", ".")) for p in _listed(spark, path)):
            continue
        df = spark.read.parquet(path)  # a run's folder: what its sink has committed
        df = df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})
        if whole is None:
            whole = df
        else:
            fresh = df.join(whole.select(*keys), keys, "left_anti") if keys else df
            whole = whole.unionByName(fresh, allowMissingColumns=True)
    return whole


def start_live_sink(df: DataFrame, out_dir: str, table: str, name: str, trigger: dict | None = None,
                    partition_by: list[str] | None = None):
    """Exactly-once append to a run's own folder ``<out_dir>/live/<table>/run=<name>-<k>``.

    A file sink skips epochs that its folder's log already holds, so a new
    checkpoint gets a new run; a restart from its checkpoint goes on in the same one.
    """
    spark = df.sparkSession
    base = _table_path(out_dir, "live", table)
    runs = [int(p.getName().rpartition("-")[2]) for p in _listed(spark, base) if p.getName().startswith(f"run={name}-")]
    resumed = bool(runs) and bool(_listed(spark, os.path.join(checkpoint_dir(spark), name)))
    k = max(runs, default=0) + (not resumed)
    return start_stream(df, name, sink="parquet", trigger=trigger, path=f"{base}/run={name}-{k}", partition_by=partition_by)


RAW_COLUMNS = ["ts", "asset_id", "cpu_usage", "power_w", "inlet_temp_c", "outlet_temp_c", "operational_state"]


def _follow(spark: SparkSession, path: str, schema, trigger: dict, query) -> DataFrame:
    """Stream of what a live sink commits to ``path``. A finite trigger reads what its writer has written by then."""
    if "processingTime" not in trigger:
        query.awaitTermination()
    # the sink's log decides which files count: it must be there before the first look at the folder
    log = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_spark_metadata")
    log.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(log)
    return spark.readStream.schema(schema).parquet(path)


ROLLUP_LEVELS = {"bucket_rollup_1h": "1 hour", "bucket_rollup_1d": "1 day"}


def start_live_loop(raw_stream: DataFrame, assets: DataFrame, out_dir: str, delay: str = "1 hour",
                        trigger: dict | None = None, name: str = "live") -> dict:
    """The live loop as streaming queries, each with its own checkpoint under
    ``spark.checkpoint.dir``:

    * ``ingest``: measured samples -> first-wins de-duplication within the
      watermark -> enrichment (emission factor, carbon, status) -> exactly-once
      append to date-partitioned Parquet facts (``<out_dir>/live/telemetry_metrics``). The only
      query that reads the samples and the only one with de-duplication state; the
      others follow the facts it commits, so a crash between sinks repeats nothing;
    * ``latest``: the latest-state table maintained by ``foreachBatch``
      (``<out_dir>/latest_state``), for rollups, alerts and site stats;
    * ``kpi``: KPI snapshots per timestamp once the watermark passes it
      (``<out_dir>/live/sustainability_kpi_snapshots``);
    * ``rollup``: 5-minute per-asset partial aggregates for trend panels
      (``<out_dir>/live/bucket_rollup_5m``, date-partitioned), and from its closed buckets
      ``bucket_rollup_1h``, from whose closed buckets ``bucket_rollup_1d``.

    A row the ingest accepts is never late for its followers: their watermark comes from
    rows committed before. Backfilled history stands under ``<out_dir>/history``: the streaming
    file sink reads its own log only, so the two never share a folder. ``read_store`` gives both.
    Returns the started queries and the output paths.
    """
    spark = raw_stream.sparkSession
    trig = trigger or {"processingTime": "10 seconds"}
    facts_path, kpi_path, rollup_path = (_table_path(out_dir, "live", t) for t in (FACTS, KPIS, ROLLUP))
    clean = dedup_stream(raw_stream.select(*RAW_COLUMNS), delay)
    facts = enrich_stream(clean, assets).withColumn("dt", F.to_date("ts"))
    started = {}

    def sink(df: DataFrame, table: str, query: str, partition_by=None):
        started[query] = start_live_sink(df, out_dir, table, f"{name}_{query}", trig, partition_by)
        run = sorted((p.getName() for p in _listed(spark, _table_path(out_dir, "live", table)) if p.getName().startswith(f"run={name}_{query}-")),
                     key=lambda r: int(r.rpartition("-")[2]))[-1]
        return f"{_table_path(out_dir, 'live', table)}/{run}"

    def committed(path: str, schema, query: str) -> DataFrame:
        return _follow(spark, path, schema, trig, started[query])

    facts_run = sink(facts, FACTS, "ingest", ["dt"])
    follow = lambda: committed(facts_run, facts.schema, "ingest").drop("dt")
    table = LatestStateTable(f"{out_dir.rstrip('/')}/latest_state")
    started["latest"] = table.start(follow(), name=f"{name}_latest", trigger=trig)
    sink(kpi_stream(follow(), delay), KPIS, "kpi")
    rolled = rollup_stream(follow(), "5 minutes", delay).withColumn("dt", F.to_date("time"))
    run, query = sink(rolled, ROLLUP, "rollup", ["dt"]), "rollup"
    for level, width in ROLLUP_LEVELS.items():
        rolled = combine_rollup(committed(run, rolled.schema, query).drop("dt"), width).withColumn("dt", F.to_date("time"))
        query = "rollup_" + level.rpartition("_")[2]
        run = sink(rolled, level, query, ["dt"])
    return {**started, "facts_path": facts_path, "kpi_path": kpi_path, "rollup_path": rollup_path, "latest_table": table}


def _wider(schema) -> list:
    """Aggregates that combine partial rows of a rollup; sums keep their type."""
    fn = {"sum": F.sum, "n": F.sum, "max": F.max, "min": F.min}
    return [fn[f.name.split("_")[0]](f.name).cast(f.dataType).alias(f.name)
            for f in schema if f.name.split("_")[0] in fn and "_" in f.name]


def combine_rollup(stream: DataFrame, width: str, delay: str = "0 seconds") -> DataFrame:
    """A coarser rollup from the closed buckets of a finer one (``time``, ``asset_id``, partials).

    Closed buckets arrive in the order of their ends, so no delay is needed."""
    s = event_time(stream, "time").withWatermark("time", delay)
    return (s.groupBy(F.window("time", width).alias("w"), "asset_id").agg(*_wider(stream.schema))
            .select(F.col("w.start").alias("time"), "asset_id", *[c for c in stream.columns if c not in ("time", "asset_id")]))


def rollup_chain(stream: DataFrame, widths=("5 minutes", "1 hour", "1 day"), delay: str = "1 hour",
                 watermarked: bool = False, measures=None) -> DataFrame:
    """The coarsest of ``widths`` in one append-mode query: every level aggregates the closed windows of
    the level before through ``window_time`` and keeps one row per open window and asset."""
    from sitewatt.operators.timeseries import ROLLUP_MEASURES
    s = stream if watermarked else event_time(stream).withWatermark("ts", delay)
    aggs = [a for m in measures or ROLLUP_MEASURES for a in (
        F.sum(m).alias(f"sum_{m}"), F.count(m).alias(f"n_{m}"), F.max(m).alias(f"max_{m}"), F.min(m).alias(f"min_{m}"))]
    level = s.groupBy(F.window("ts", widths[0]).alias("w"), "asset_id").agg(*aggs)
    for width in widths[1:]:
        level = level.groupBy(F.window(F.window_time("w"), width).alias("w"), "asset_id").agg(*_wider(level.schema))
    return level.select(F.col("w.start").alias("time"), *[c for c in level.columns if c != "w"])


def rollup_stream(stream: DataFrame, width: str = "5 minutes", delay: str = "1 hour",
                  watermarked: bool = False, measures=None) -> DataFrame:
    """Bucket rollup maintained live: per (bucket, asset) partials, emitted in
    append mode once the watermark closes the bucket; write it to a
    date-partitioned table and serve trends with ``series_from_partials``."""
    from sitewatt.operators.timeseries import bucket_partials
    s = stream if watermarked else event_time(stream).withWatermark("ts", delay)
    return bucket_partials(s, width, measures)


def backfill(facts: DataFrame, out_dir: str, force: bool = False) -> dict:
    """Batch backfill beside the live loop, only into an empty store (the backfill
    guard looks at the data of both parts): date-partitioned facts, KPI snapshots and the
    5-minute rollup under ``<out_dir>/history``, and a new version of the latest state.
    ``force`` replaces the history, never live rows; the latest state is then made
    of the new history and the live facts."""
    from sitewatt.operators.kpi import kpi_snapshots
    from sitewatt.operators.sinks import is_empty
    from sitewatt.operators.timeseries import bucket_partials
    spark = facts.sparkSession
    facts_path, kpi_path, rollup_path = (_table_path(out_dir, "history", t) for t in (FACTS, KPIS, ROLLUP))
    stored = read_store(spark, out_dir)
    if not force and stored is not None and not is_empty(stored):
        return {"written": False, "facts_path": facts_path}

    def write(df: DataFrame, path: str, partitioned: bool = True) -> None:
        w = df.write.mode("overwrite").option("partitionOverwriteMode", "static")  # old days go, whatever the session says
        (w.partitionBy("dt") if partitioned else w).parquet(path)

    write(facts.withColumn("dt", F.to_date("ts")).repartitionByRange("ts", "asset_id").sortWithinPartitions("ts", "asset_id"),
          facts_path)
    history = spark.read.parquet(facts_path).drop("dt")
    write(kpi_snapshots(history), kpi_path, partitioned=False)
    write(bucket_partials(history, "5 minutes").withColumn("dt", F.to_date("time")), rollup_path)
    table = LatestStateTable(f"{out_dir.rstrip('/')}/latest_state")
    table.replace(read_store(spark, out_dir).drop("dt"))
    return {"written": True, "facts_path": facts_path, "kpi_path": kpi_path, "rollup_path": rollup_path, "latest_table": table}
