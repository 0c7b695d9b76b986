"""Nested JSON reference data -> flat tables (SRC-2).

Explicit schemas make absent optional fields null; list position becomes a
1-based ``display_order`` through ``posexplode``; missing flags default to false.
Nothing is parsed on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewatt.schemas import KPI_CONFIG_FIELDS, PLATFORM_METRIC_FIELDS, SCENARIO_METRIC_FIELDS

S, D, B, I = T.StringType(), T.DoubleType(), T.BooleanType(), T.IntegerType()


def _st(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


KPI_FILE = _st(
    ("profile_name", S),
    ("config", _st(*[(c, D) for c in KPI_CONFIG_FIELDS])),
    ("kpis", T.ArrayType(_st(("key", S), ("label", S), ("direction", S), ("interpretation", S),
                             ("is_advanced", B)))),
    ("outcome_statement", S),
)
MODELS_FILE = _st(
    ("models", T.ArrayType(_st(("name", S), ("type", S), ("purpose", S), ("energy_j", D),
                               ("accuracy_percent", D), ("interpretation", S), ("best_model", B),
                               ("preferred_family", B)))),
    ("features", T.ArrayType(_st(("name", S), ("description", S)))),
    ("feature_importance", T.ArrayType(_st(("model_name", S), ("feature_name", S), ("importance_score", D)))),
    ("outcome_statement", S),
)
ACCEL_FILE = _st(
    ("workload", _st(("name", S), ("model", S), ("goal", S), ("hardware_backends", T.ArrayType(S)))),
    ("platforms", T.ArrayType(_st(("platform", S), ("role", S), *[(c, D) for c in PLATFORM_METRIC_FIELDS]))),
    ("scenario", _st(("baseline_platform", S), ("training_platform", S), ("inference_platform", S),
                     *[(c, D) for c in SCENARIO_METRIC_FIELDS])),
)
SOURCES_FILE = _st(
    ("data_centres", T.ArrayType(_st(("key", S), ("name", S), ("location", S), ("ip_address", S),
                                     ("source_type", S), ("default_username", S), ("default_password", S),
                                     ("jwt_status", S), ("stream_status", S), ("display_order", I),
                                     ("user_visible", B), ("user_added", B)))),
)

FILE_SCHEMAS = {"kpis": KPI_FILE, "models": MODELS_FILE, "accelerators": ACCEL_FILE, "sources": SOURCES_FILE}


def read_reference_file(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMAS[kind]).option("multiLine", True).json(path)


def flatten_kpis(doc: DataFrame) -> dict[str, DataFrame]:
    config = doc.select("profile_name", "config.*")
    meta = (doc.select(F.posexplode("kpis").alias("pos", "k"))
            .select(F.col("k.key").alias("kpi_key"), F.col("k.label").alias("label"),
                    F.col("k.direction").alias("direction"), F.col("k.interpretation").alias("interpretation"),
                    F.coalesce(F.col("k.is_advanced"), F.lit(False)).alias("is_advanced"),
                    (F.col("pos") + 1).cast("int").alias("display_order")))
    return {"sustainability_kpi_config": config, "sustainability_kpi_metadata": meta}


def flatten_models(doc: DataFrame) -> dict[str, DataFrame]:
    models = (doc.select(F.explode("models").alias("m"))
              .select(F.col("m.name").alias("model_name"), F.col("m.type").alias("model_type"),
                      F.col("m.purpose").alias("purpose"), F.col("m.energy_j").alias("energy_j"),
                      F.col("m.accuracy_percent").alias("accuracy_percent"),
                      F.col("m.interpretation").alias("interpretation"),
                      F.coalesce(F.col("m.best_model"), F.lit(False)).alias("best_model"),
                      F.coalesce(F.col("m.preferred_family"), F.lit(False)).alias("preferred_family")))
    features = (doc.select(F.posexplode("features").alias("pos", "f"))
                .select(F.col("f.name").alias("feature_name"), F.col("f.description").alias("description"),
                        (F.col("pos") + 1).cast("int").alias("display_order")))
    importance = doc.select(F.inline("feature_importance"))
    return {"ai_model_results": models, "ai_model_features": features, "ai_feature_importance": importance}


def flatten_accelerators(doc: DataFrame) -> dict[str, DataFrame]:
    workload = doc.select(F.col("workload.name").alias("workload_name"),
                          F.col("workload.model").alias("model_name"), F.col("workload.goal").alias("goal"))
    platforms = (doc.select(F.explode("platforms").alias("p"))
                 .select(F.col("p.platform").alias("platform"), F.col("p.role").alias("role_description"),
                         *[F.col(f"p.{c}").alias(c) for c in PLATFORM_METRIC_FIELDS]))
    scenario = doc.select(F.col("workload.name").alias("scenario_name"), "scenario.*")
    return {"gpu_fpga_workload": workload, "gpu_fpga_platform_metrics": platforms,
            "gpu_fpga_scenario": scenario}


def flatten_sources(doc: DataFrame) -> dict[str, DataFrame]:
    """Registered sources; the credential fields are dropped on load."""
    src = (doc.select(F.explode("data_centres").alias("d"))
           .select(F.col("d.key").alias("dc_key"), F.col("d.name").alias("dc_name"),
                   F.col("d.location").alias("location"), F.col("d.ip_address").alias("ip_address"),
                   F.col("d.source_type").alias("source_type"), F.col("d.jwt_status").alias("jwt_status"),
                   F.col("d.stream_status").alias("stream_status"), F.col("d.display_order").alias("display_order"),
                   F.coalesce(F.col("d.user_visible"), F.lit(True)).alias("user_visible"),
                   F.coalesce(F.col("d.user_added"), F.lit(False)).alias("user_added")))
    return {"data_centre_sources": src}


_FLATTEN = {"kpis": flatten_kpis, "models": flatten_models, "accelerators": flatten_accelerators,
            "sources": flatten_sources}


def load_reference_json(spark: SparkSession, path: str, kind: str) -> dict[str, DataFrame]:
    """Flat tables from one nested reference file of the given ``kind``."""
    return _FLATTEN[kind](read_reference_file(spark, path, kind))
