"""Source registry and freshness (CON-1..4), drill-down options (NAV-1..4),
ordered-workflow status (STG-1) and literal option lists (PRJ-3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewatt.functions.scalar import epoch_seconds
from sitewatt.operators.filters import ALL, scope
from sitewatt.operators.joins import attach_single, checked_broadcast

SOURCE_COLUMNS = ["dc_key", "dc_name", "location", "ip_address", "source_type", "jwt_status", "stream_status"]


def source_freshness(sources: DataFrame, latest: DataFrame) -> DataFrame:
    """Every registered source with the site-wide newest timestamp as
    ``last_sync``. Facts carry no source key, so all sources share the value;
    with no facts the sources survive with a null. Credentials never appear."""
    site = latest.agg(F.max("ts").alias("last_sync"))  # exactly one row
    return attach_single(sources.select(*SOURCE_COLUMNS), site)


def source_status(freshness: DataFrame, dc_name: str) -> DataFrame:
    """Status of one selected source."""
    return freshness.where(F.col("dc_name") == F.lit(dc_name))


def last_sync_epoch(freshness: DataFrame, dc_name: str) -> DataFrame:
    """``time, value`` = last sync and its epoch seconds for one source."""
    return source_status(freshness, dc_name).select(F.col("last_sync").alias("time"),
                                                    epoch_seconds("last_sync").alias("value"))


def list_sources(sources: DataFrame, flag: str = "user_visible",
                 columns=("dc_name", "location", "ip_address", "source_type")) -> DataFrame:
    """Sources whose boolean ``flag`` is true, in display order."""
    return (sources.where(F.col(flag)).orderBy("display_order", "dc_key")
            .select(*columns, *([flag] if flag == "user_added" else [])))


def room_options(rooms: DataFrame) -> DataFrame:
    return rooms.select(F.col("room_name").alias("text")).orderBy("text")


def rack_options(racks: DataFrame, rooms: DataFrame, room: str = ALL) -> DataFrame:
    """Rack names limited by the selected room (racks JOIN rooms USING room_id)."""
    j = racks.join(checked_broadcast(rooms), "room_id")
    return scope(j, room, ALL, ALL).select(F.col("rack_name").alias("text")).orderBy("text")


def asset_options(assets: DataFrame, room: str = ALL, rack: str = ALL) -> DataFrame:
    """Asset names limited by room and rack."""
    return scope(assets, room, rack, ALL).select(F.col("asset_name").alias("text")).orderBy("text")


def source_options(sources: DataFrame) -> DataFrame:
    """Visible source names in display order."""
    return (sources.where(F.col("user_visible")).orderBy("display_order", "dc_name")
            .select(F.col("dc_name").alias("text")))


def source_ip(sources: DataFrame, dc_name: str) -> DataFrame:
    """IP address of the named source(s)."""
    return (sources.where(F.col("dc_name") == F.lit(dc_name)).orderBy("display_order")
            .select(F.col("ip_address").alias("text")))


def model_options(models: DataFrame, alphabetical: bool = False) -> DataFrame:
    """Model names, best first, then preferred family, then name; with
    ``alphabetical=True`` plain name order (what a selector that re-sorts its
    options displays)."""
    order = ["model_name"] if alphabetical else [F.col("best_model").desc(), F.col("preferred_family").desc(),
                                                  "model_name"]
    return models.orderBy(*order).select(F.col("model_name").alias("text"))


# ---------------------------------------------------------------------------
# Workflow phases (value, label) and steps. A step is active in
# the listed phases and complete in the listed phases, else pending.
PHASE_OPTIONS = [
    ("baseline", "Baseline"), ("running", "Running"), ("scheduler", "Scheduler Active"),
    ("gpu_training", "GPU Training"), ("fpga_inference", "FPGA Inference"), ("optimised", "Optimised"),
]
WORKFLOW_STEPS = [
    (1, "Transactions received", ["baseline"],
     ["running", "scheduler", "gpu_training", "fpga_inference", "optimised"]),
    (2, "CPU baseline execution", ["baseline"],
     ["running", "scheduler", "gpu_training", "fpga_inference", "optimised"]),
    (3, "AI scheduler selects hardware", ["scheduler"], ["gpu_training", "fpga_inference", "optimised"]),
    (4, "GPU training starts", ["gpu_training"], ["fpga_inference", "optimised"]),
    (5, "FPGA scoring starts", ["fpga_inference"], ["optimised"]),
    (6, "Suspicious transactions flagged", [], ["optimised"]),
    (7, "Energy / performance improvement displayed", [], ["optimised"]),
]
# ---------------------------------------------------------------------------


def phase_options(spark: SparkSession) -> DataFrame:
    """The six phase options as a literal relation (``text, value``)."""
    return spark.createDataFrame([(label, value) for value, label in PHASE_OPTIONS], "text string, value string")


def _step_status(order: int, active_in, complete_in, phase) -> F.Column:
    # Step 1 is "active" in every phase that does not complete it.
    if order == 1:
        return F.when(phase.isin(complete_in), "complete").otherwise("active")
    st = F.lit("pending")
    if complete_in:
        st = F.when(phase.isin(complete_in), "complete").otherwise(st)
    if active_in:
        st = F.when(phase.isin(active_in), "active").otherwise(st)
    return st


def stage_status(runs: DataFrame, phase_col: str = "phase", key: str = "run_id") -> DataFrame:
    """Status of every workflow step for many runs at once: each run expands to
    its 7 steps through an array explode (no join), statuses from its phase."""
    phase = F.col(phase_col)
    steps = F.array(*[F.struct(F.lit(o).alias("step_order"), F.lit(name).alias("step"),
                               _step_status(o, act, comp, phase).alias("status"))
                      for o, name, act, comp in WORKFLOW_STEPS])
    return runs.select(key, phase_col, F.inline(steps))
