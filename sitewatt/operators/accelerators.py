"""Accelerator comparison (ACC-1..4) and its long forms (SET-3, SET-6, SET-7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewatt.operators.joins import attach_single

# ---------------------------------------------------------------------------
# Exported metric names (after a deployment-chosen prefix).
PLATFORM_EXPORT = [
    ("training_latency_ms", "fraud_training_latency_ms"),
    ("inference_latency_ms", "fraud_inference_latency_ms"),
    ("speedup_training", "fraud_speedup_training"),
    ("speedup_inference", "fraud_speedup_inference"),
    ("performance_per_watt", "fraud_perf_per_watt"),
]
IMPROVEMENT_METRIC = "optimization_improvement_percent"
SCHEDULER_METRIC = "ai_scheduler_state"
DEFAULT_PREFIX = "dc_"
PLATFORM_ORDER = ["CPU", "GPU"]
# ---------------------------------------------------------------------------


def platforms_by(platforms: DataFrame, column: str) -> DataFrame:
    """Platforms ordered by one metric, descending."""
    return platforms.orderBy(F.col(column).desc()).select("platform", column)


def platform_table(platforms: DataFrame) -> DataFrame:
    """Platform table in the fixed order CPU, GPU, then the rest."""
    rank = F.when(F.col("platform") == PLATFORM_ORDER[0], 1).when(F.col("platform") == PLATFORM_ORDER[1], 2) \
        .otherwise(3)
    return platforms.orderBy(rank, "platform").select(
        "platform", "role_description", "training_latency_ms", "inference_latency_ms", "speedup_training",
        "speedup_inference", "performance_per_watt")


def scenario_values(scenario: DataFrame) -> DataFrame:
    """The four headline values of the scenario."""
    return scenario.select("fpga_inference_speedup", "fpga_perf_per_watt", "energy_saving_percent",
                           "gpu_training_acceleration")


def platform_long(platforms: DataFrame, scenario: DataFrame, prefix: str = DEFAULT_PREFIX) -> DataFrame:
    """Platform metrics unpivoted (``platform, metric_name, metric_value``) plus
    the improvement of the baseline platform and a constant 1 for the training
    platform. Metric names are ``prefix`` + the fixed suffix."""
    pairs = [F.struct(F.lit(prefix + n).alias("metric_name"), F.col(c).cast("double").alias("metric_value"))
             for c, n in PLATFORM_EXPORT]
    long = platforms.select("platform", F.inline(F.array(*pairs)))
    extra = scenario.select(F.inline(F.array(
        F.struct(F.col("baseline_platform").alias("platform"),
                 F.lit(prefix + IMPROVEMENT_METRIC).alias("metric_name"),
                 F.col("energy_saving_percent").cast("double").alias("metric_value")),
        F.struct(F.col("training_platform").alias("platform"), F.lit(prefix + SCHEDULER_METRIC).alias("metric_name"),
                 F.lit(1.0).alias("metric_value")))))
    return long.unionByName(extra)


def speedups_long(platforms: DataFrame, accelerated=("GPU", "FPGA")) -> DataFrame:
    """Speed-up comparison rows: training and inference speed-ups of the
    accelerated platforms, labelled ``<platform> training speed-up`` etc."""
    rows = platforms.where(F.col("platform").isin(list(accelerated))).select("platform", F.inline(F.array(
        F.struct(F.lit("training").alias("kind"), F.col("speedup_training").alias("value")),
        F.struct(F.lit("inference").alias("kind"), F.col("speedup_inference").alias("value")))))
    return rows.select(
        F.concat(F.col("platform"), F.lit(" "), F.col("kind"), F.lit(" speed-up")).alias("metric"), "value")


def before_after(scenario: DataFrame, before: str, after: str, before_label: str, after_label: str) -> DataFrame:
    """Two scenario columns as ``metric, value`` rows."""
    return scenario.select(F.inline(F.array(
        F.struct(F.lit(before_label).alias("metric"), F.col(before).alias("value")),
        F.struct(F.lit(after_label).alias("metric"), F.col(after).alias("value")))))


def derive_platform_metrics(platforms: DataFrame, baseline: str = "CPU") -> DataFrame:
    """Derivations stated by the application: energy = power x time; improvement
    percent = (baseline - optimised) / baseline x 100; perf/W = throughput / power;
    speed-ups = baseline latency / platform latency. The baseline values are
    scalar subqueries."""
    b = platforms.where(F.col("platform") == F.lit(baseline)).select(
        F.col("training_latency_ms").alias("b_train"), F.col("inference_latency_ms").alias("b_inf"),
        F.col("power_w").alias("b_power")).limit(1)
    j = attach_single(platforms, b)
    energy = F.col("power_w") * F.col("inference_latency_ms") / F.lit(1000.0)
    b_energy = F.col("b_power") * F.col("b_inf") / F.lit(1000.0)
    return j.select(
        "platform",
        F.try_divide(F.col("throughput"), F.col("power_w")).alias("derived_perf_per_watt"),
        F.try_divide(F.col("b_train"), F.col("training_latency_ms")).alias("derived_speedup_training"),
        F.try_divide(F.col("b_inf"), F.col("inference_latency_ms")).alias("derived_speedup_inference"),
        energy.alias("inference_energy_j"),
        (F.try_divide(b_energy - energy, b_energy) * F.lit(100.0)).alias("energy_improvement_percent"))
