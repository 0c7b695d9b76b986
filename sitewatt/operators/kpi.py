"""Sustainability KPI pipeline (KPI-1..16) and KPI readers (SET-2/4/5, PRJ-2).

One ``groupBy(ts)`` over the facts yields the inputs; every KPI is then a column
expression over that one row per timestamp. Chained values stay unrounded;
each output is rounded once at the end and stored as an exact decimal, so
later averages over the snapshots are exact.

Two details keep the numbers identical to an exact-numeric engine: means are
taken as ``double(sum) / count`` (no truncated decimal average feeding the
formulas), and IT energy is multiplied in decimal (``sum(power) * 0.001``),
because 2-digit watts / 1000 at 4 digits sits exactly on rounding ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewatt.functions.scalar import clamp, dec, hourly_phase
from sitewatt.operators.joins import attach_single
from sitewatt.operators.latest import latest_row
from sitewatt.operators.rollups import kpi_inputs
from sitewatt.schemas import KPI_COLUMNS, KPI_CONFIG_FIELDS

# ---------------------------------------------------------------------------
# The default KPI profile (coefficients of the formulas).
DEFAULT_PROFILE = {
    "profile_name": "default",
    "facility_overhead_base": 1.26,
    "facility_overhead_wave": 0.08,
    "renewable_fraction_base": 0.46,
    "renewable_fraction_wave": 0.18,
    "reused_energy_fraction_base": 0.12,
    "reused_energy_fraction_wave": 0.05,
    "baseline_co2_multiplier": 1.24,
    "performance_factor": 18.0,
    "cue_it_energy_share": 0.91,
    "hue_base": 0.72,
    "she_base": 0.58,
    "apcren_base": 0.55,
    "dca_base": 0.57,
}
# Export names of the KPI metrics (column -> metric name suffix).
EXPORT_METRICS = [
    ("pue", "pue"), ("ref", "ref"), ("erf", "erf"), ("cue", "cue"), ("cef", "cef_kgco2_per_kwh"),
    ("co2_savings_kg", "co2_savings_kg"), ("ppw", "ppw"), ("hue", "hue"), ("she", "she"),
    ("apcren", "apcren"), ("dca", "dca"),
]
# Metric names are exported behind a deployment-chosen prefix.
EXPORT_PREFIX = "dc_"
ADVANCED_KPIS = [("HUE", "hue"), ("SHE", "she"), ("APCren", "apcren"), ("DCA", "dca")]
# Clamp ranges of the bounded KPIs (lower, upper).
KPI_CLAMPS = {
    "pue": (1.12, 1.68),
    "ref": (0.18, 0.88),
    "erf": (0.04, 0.36),
    "hue": (0.45, 1.05),
    "she": (0.35, 1.0),
    "apcren": (0.30, 1.0),
    "dca": (0.30, 1.0),
}
# The numeric coefficients written inside ``kpi_formulas`` (phase shifts,
# weights, thresholds such as 31 C and 0.30 kg/kWh) are fixed values as well.
# ---------------------------------------------------------------------------


def _cfg(profile, name: str) -> Column:
    """A coefficient: a Python number (constant-folded) or a column of a
    broadcast one-row profile."""
    if isinstance(profile, dict):
        return F.lit(float(profile[name]))
    return F.col(f"cfg_{name}")


def kpi_formulas(inputs: DataFrame, profile=None, ts: str = "ts") -> DataFrame:
    """Unrounded KPI columns from per-timestamp inputs."""
    profile = DEFAULT_PROFILE if profile is None else profile
    df = inputs
    if not isinstance(profile, dict):  # one-row DataFrame of coefficients: scalar subqueries
        one = profile.select(*[F.col(c).alias(f"cfg_{c}") for c in KPI_CONFIG_FIELDS]).limit(1)
        df = attach_single(df, one)
    c = lambda n: _cfg(profile, n)
    phi = hourly_phase(ts)
    w = F.col("warning_pressure")
    outlet, inlet, ef = F.col("avg_outlet"), F.col("avg_inlet"), F.col("avg_ef")
    it_power = F.col("it_power_w").cast("double")
    pue = clamp(c("facility_overhead_base") + c("facility_overhead_wave") * F.sin(phi - F.lit(0.7))
                + F.lit(0.012) * F.greatest(outlet - F.lit(31.0), F.lit(0.0)) + F.lit(0.045) * w, *KPI_CLAMPS["pue"])
    ref = clamp(c("renewable_fraction_base") + c("renewable_fraction_wave") * F.sin(phi - F.lit(1.1))
                - F.lit(0.24) * F.greatest(ef - F.lit(0.30), F.lit(0.0)), *KPI_CLAMPS["ref"])
    erf = clamp(c("reused_energy_fraction_base") + c("reused_energy_fraction_wave") * F.cos(phi + F.lit(0.35))
                + F.lit(0.012) * F.greatest(outlet - inlet - F.lit(6.0), F.lit(0.0)), *KPI_CLAMPS["erf"])
    df = df.select("*", pue.alias("pue"), ref.alias("ref"), erf.alias("erf"))
    pue, ref, erf = F.col("pue"), F.col("ref"), F.col("erf")
    facility = it_power * pue
    energy = facility / F.lit(1000.0)
    co2 = energy * ef
    baseline = co2 * c("baseline_co2_multiplier")
    perf = F.col("sum_cpu").cast("double") * c("performance_factor") * (F.lit(0.92) + ref * F.lit(0.18))
    df = df.select("*", facility.alias("total_facility_power_w"), energy.alias("total_energy_kwh"),
                   co2.alias("total_co2_kg"), baseline.alias("baseline_co2_kg"), perf.alias("performance_score"))
    facility, energy, co2 = F.col("total_facility_power_w"), F.col("total_energy_kwh"), F.col("total_co2_kg")
    out = {
        "renewable_energy_kwh": energy * ref,
        "reused_energy_kwh": energy * erf,
        "co2_savings_kg": F.col("baseline_co2_kg") - co2,
        "ppw": F.col("performance_score") / F.greatest(facility, F.lit(1.0)),
        "cue": co2 / F.greatest((it_power / F.lit(1000.0)) * c("cue_it_energy_share"), F.lit(0.001)),
        "cef": co2 / F.greatest(energy, F.lit(0.001)),
        "hue": clamp(c("hue_base") + F.lit(0.52) * erf + F.lit(0.04) * F.sin(phi + F.lit(0.9))
                     - F.lit(0.03) * w, *KPI_CLAMPS["hue"]),
        "she": clamp(c("she_base") + F.lit(0.38) * ref + F.lit(0.24) * erf + F.lit(0.03) * F.cos(phi - F.lit(0.4)),
                     *KPI_CLAMPS["she"]),
        "apcren": clamp(c("apcren_base") + F.lit(0.44) * ref - F.lit(0.08) * w
                        + F.lit(0.03) * F.sin(phi * F.lit(2.0)), *KPI_CLAMPS["apcren"]),
        "dca": clamp(c("dca_base") + F.lit(0.24) * ref + F.lit(0.10) * erf
                     + F.lit(0.16) * clamp((F.lit(1.55) - pue) / F.lit(0.45), 0.0, 1.0) - F.lit(0.08) * w,
                     *KPI_CLAMPS["dca"]),
        "it_energy_kwh": F.col("it_power_w") * dec("0.001", 4, 3),
    }
    return df.select("*", *[v.alias(k) for k, v in out.items()])


def kpi_snapshots(tm: DataFrame, profile=None, ts: str = "ts") -> DataFrame:
    """One KPI row per timestamp: ``ts`` + 20 columns rounded once, as decimals."""
    f = kpi_formulas(kpi_inputs(tm, ts), profile, ts)
    return f.select(ts, *[F.round(F.col(c), d).cast(f"decimal(18,{d})").alias(c) for c, d in KPI_COLUMNS])


def as_double(kpi: DataFrame) -> DataFrame:
    """KPI rows with the measures as doubles (display / comparison form)."""
    return kpi.select("ts", *[F.col(c).cast("double").alias(c) for c, _ in KPI_COLUMNS])


def latest_kpi(kpi: DataFrame, column: str, digits: int = 3) -> DataFrame:
    """Newest value of one KPI (``time, value``); empty input -> no row."""
    return latest_row(kpi).select(F.col("ts").alias("time"),
                                  F.round(F.col(column), digits).cast("double").alias("value"))


def kpi_long(latest: DataFrame, metrics=None, prefix: str = EXPORT_PREFIX) -> DataFrame:
    """Unpivot the newest snapshot into ``ts, metric_name, metric_value`` (one
    scan instead of one per metric)."""
    metrics = metrics or EXPORT_METRICS
    pairs = [F.struct(F.lit(prefix + name).alias("metric_name"),
                      F.col(col).cast("double").alias("metric_value")) for col, name in metrics]
    return latest.select("ts", F.inline(F.array(*pairs)))


def baseline_vs_current(latest: DataFrame) -> DataFrame:
    """Baseline and current CO2 of the newest snapshot (3 digits)."""
    pairs = [F.struct(F.lit("Baseline CO2").alias("metric"), F.round("baseline_co2_kg", 3).cast("double").alias("value")),
             F.struct(F.lit("Current CO2").alias("metric"), F.round("total_co2_kg", 3).cast("double").alias("value"))]
    return latest.select(F.inline(F.array(*pairs)))


def advanced_kpis(latest: DataFrame) -> DataFrame:
    """HUE, SHE, APCren, DCA of the newest snapshot as ``metric, value``."""
    pairs = [F.struct(F.lit(label).alias("metric"), F.round(col, 3).cast("double").alias("value"))
             for label, col in ADVANCED_KPIS]
    return latest.select(F.inline(F.array(*pairs)))


def kpi_guide(meta: DataFrame) -> DataFrame:
    """KPI interpretation guide: label, target wording, interpretation, ordered
    by ``is_advanced, display_order``."""
    target = F.when(F.col("direction") == "higher", "Higher is better").otherwise("Lower is better")
    return (meta.orderBy("is_advanced", "display_order")
            .select(F.col("label").alias("kpi"), target.alias("target"), "interpretation"))
