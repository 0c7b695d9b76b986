"""Model scoring and comparison (MOD-1..5)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewatt.operators.joins import attach_single

from sitewatt.operators.timeseries import DEFAULT_COEFFICIENTS, INLET_OFFSET, MODEL_COEFFICIENTS, predicted_power


def predict_power(tm: DataFrame, model: str) -> DataFrame:
    """Telemetry rows with the named model's predicted power (exact decimal)."""
    return tm.withColumn("predicted_power_w", predicted_power(model))


MODEL_NAMES = ["LSTM", "Random Forest", "XGBoost", "Extended XGBoost"]


def predict_all_models(tm: DataFrame, models=None) -> DataFrame:
    """Every telemetry row scored by every model in one pass: the coefficient
    rows are a literal array exploded per row (no join), so the fact is read
    once and never shuffled. Names without own coefficients use the default."""
    names = list(models or MODEL_NAMES)
    rows = []
    for n in names:
        a, b, c, d = (F.lit(Decimal(x)) for x in MODEL_COEFFICIENTS.get(n, DEFAULT_COEFFICIENTS))
        rows.append(F.struct(F.lit(n).alias("model_name"), a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d")))
    m = F.col("m")
    p, cpu, o, i = F.col("power_w"), F.col("cpu_usage"), F.col("outlet_temp_c"), F.col("inlet_temp_c")
    pred = p * m.a + cpu * m.b + (o - i) * m.c + (i - F.lit(Decimal(INLET_OFFSET))) * m.d
    return (tm.select("ts", "asset_id", "power_w", "cpu_usage", "outlet_temp_c", "inlet_temp_c",
                      F.explode(F.array(*rows)).alias("m"))
            .select("ts", "asset_id", F.col("m.model_name").alias("model_name"),
                    pred.alias("predicted_power_w")))


def model_tradeoff(models: DataFrame) -> DataFrame:
    """Accuracy (2) and energy-efficiency index ``100 (1 - (e - min)/(max - min))``
    (2), ordered best, preferred, then accuracy descending with nulls first.
    Equal energies give a null index (``NULLIF``), not an error."""
    bounds = models.agg(F.min("energy_j").alias("min_e"), F.max("energy_j").alias("max_e"))  # one row
    j = attach_single(models, bounds)
    idx = F.lit(100) * (F.lit(1) - F.try_divide(F.col("energy_j") - F.col("min_e"),
                                                F.nullif(F.col("max_e") - F.col("min_e"), F.lit(0.0))))
    return (j.orderBy(F.col("best_model").desc(), F.col("preferred_family").desc(),
                      F.col("accuracy_percent").desc_nulls_first())
            .select("model_name", F.round("accuracy_percent", 2).alias("accuracy_percent"),
                    F.round(idx, 2).alias("energy_efficiency_index")))


def model_energy(models: DataFrame) -> DataFrame:
    """Energy per model (0 digits), highest first, nulls last."""
    return (models.orderBy(F.col("energy_j").desc_nulls_last())
            .select("model_name", F.round("energy_j", 0).alias("energy_j")))


def feature_importance(fi: DataFrame, model: str = "XGBoost") -> DataFrame:
    """Feature importance of one model (3 digits), descending."""
    return (fi.where(F.col("model_name") == F.lit(model)).orderBy(F.col("importance_score").desc())
            .select("feature_name", F.round("importance_score", 3).alias("importance")))


def feature_guide(features: DataFrame) -> DataFrame:
    """Feature dictionary in display order."""
    return features.orderBy("display_order").select("feature_name", "description")
