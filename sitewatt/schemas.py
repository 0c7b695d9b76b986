"""Spark schemas of the operational tables (explicit, never inferred)."""

from pyspark.sql import types as T

M2 = T.DecimalType(18, 2)   # CPU, power, temperatures
M4 = T.DecimalType(18, 4)   # emission factor, carbon

ROOMS = T.StructType([
    T.StructField("room_id", T.StringType(), False),
    T.StructField("room_name", T.StringType(), False),
])

RACKS = T.StructType([
    T.StructField("rack_id", T.StringType(), False),
    T.StructField("room_id", T.StringType(), False),
    T.StructField("rack_name", T.StringType(), False),
    T.StructField("capacity_u", T.IntegerType(), False),
    T.StructField("power_capacity_w", M2, False),
])

ASSETS = T.StructType([
    T.StructField("asset_id", T.StringType(), False),
    T.StructField("asset_name", T.StringType(), False),
    T.StructField("room_id", T.StringType(), False),
    T.StructField("room_name", T.StringType(), False),
    T.StructField("rack_id", T.StringType(), False),
    T.StructField("rack_name", T.StringType(), False),
    T.StructField("asset_type", T.StringType(), False),
    T.StructField("u_position", T.IntegerType(), True),
    T.StructField("u_height", T.IntegerType(), True),
    T.StructField("accessible", T.BooleanType(), True),
    T.StructField("nominal_power_w", M2, False),
])

TELEMETRY = T.StructType([
    T.StructField("ts", T.TimestampType(), False),
    T.StructField("asset_id", T.StringType(), False),
    T.StructField("cpu_usage", M2, False),
    T.StructField("power_w", M2, False),
    T.StructField("inlet_temp_c", M2, False),
    T.StructField("outlet_temp_c", M2, False),
    T.StructField("emission_factor_kg_per_kwh", M4, False),
    T.StructField("carbon_kg", M4, False),
    T.StructField("status_level", T.StringType(), False),
    T.StructField("operational_state", T.StringType(), False),
])

KPI_COLUMNS = [
    # (column, output digits)
    ("total_facility_power_w", 2), ("it_power_w", 2), ("total_energy_kwh", 4),
    ("renewable_energy_kwh", 4), ("reused_energy_kwh", 4), ("total_co2_kg", 4),
    ("baseline_co2_kg", 4), ("performance_score", 2), ("it_energy_kwh", 4),
    ("pue", 3), ("ref", 3), ("erf", 3), ("cef", 3), ("co2_savings_kg", 4),
    ("ppw", 3), ("cue", 3), ("hue", 3), ("she", 3), ("apcren", 3), ("dca", 3),
]

KPI_SNAPSHOTS = T.StructType(
    [T.StructField("ts", T.TimestampType(), False)]
    + [T.StructField(c, T.DecimalType(18, d), False) for c, d in KPI_COLUMNS]
)

KPI_CONFIG_FIELDS = [
    "facility_overhead_base", "facility_overhead_wave", "renewable_fraction_base",
    "renewable_fraction_wave", "reused_energy_fraction_base", "reused_energy_fraction_wave",
    "baseline_co2_multiplier", "performance_factor", "cue_it_energy_share",
    "hue_base", "she_base", "apcren_base", "dca_base",
]

KPI_CONFIG = T.StructType(
    [T.StructField("profile_name", T.StringType(), False)]
    + [T.StructField(c, T.DoubleType(), False) for c in KPI_CONFIG_FIELDS]
)

KPI_METADATA = T.StructType([
    T.StructField("kpi_key", T.StringType(), False),
    T.StructField("label", T.StringType(), False),
    T.StructField("direction", T.StringType(), False),
    T.StructField("interpretation", T.StringType(), False),
    T.StructField("is_advanced", T.BooleanType(), False),
    T.StructField("display_order", T.IntegerType(), False),
])

AI_MODEL_RESULTS = T.StructType([
    T.StructField("model_name", T.StringType(), False),
    T.StructField("model_type", T.StringType(), False),
    T.StructField("purpose", T.StringType(), False),
    T.StructField("energy_j", T.DoubleType(), True),
    T.StructField("accuracy_percent", T.DoubleType(), True),
    T.StructField("interpretation", T.StringType(), False),
    T.StructField("best_model", T.BooleanType(), False),
    T.StructField("preferred_family", T.BooleanType(), False),
])

AI_MODEL_FEATURES = T.StructType([
    T.StructField("feature_name", T.StringType(), False),
    T.StructField("description", T.StringType(), False),
    T.StructField("display_order", T.IntegerType(), False),
])

AI_FEATURE_IMPORTANCE = T.StructType([
    T.StructField("model_name", T.StringType(), False),
    T.StructField("feature_name", T.StringType(), False),
    T.StructField("importance_score", T.DoubleType(), False),
])

DATA_CENTRE_SOURCES = T.StructType([
    T.StructField("dc_key", T.StringType(), False),
    T.StructField("dc_name", T.StringType(), False),
    T.StructField("location", T.StringType(), False),
    T.StructField("ip_address", T.StringType(), False),
    T.StructField("source_type", T.StringType(), False),
    T.StructField("jwt_status", T.StringType(), False),
    T.StructField("stream_status", T.StringType(), False),
    T.StructField("display_order", T.IntegerType(), False),
    T.StructField("user_visible", T.BooleanType(), False),
    T.StructField("user_added", T.BooleanType(), False),
])

GPU_FPGA_WORKLOAD = T.StructType([
    T.StructField("workload_name", T.StringType(), False),
    T.StructField("model_name", T.StringType(), False),
    T.StructField("goal", T.StringType(), False),
])

PLATFORM_METRIC_FIELDS = [
    "training_latency_ms", "inference_latency_ms", "speedup_training", "speedup_inference",
    "performance_per_watt", "power_w", "throughput",
]

GPU_FPGA_PLATFORM_METRICS = T.StructType(
    [T.StructField("platform", T.StringType(), False),
     T.StructField("role_description", T.StringType(), False)]
    + [T.StructField(c, T.DoubleType(), False) for c in PLATFORM_METRIC_FIELDS]
)

SCENARIO_METRIC_FIELDS = [
    "baseline_energy_j", "optimised_energy_j", "baseline_co2_kg", "optimised_co2_kg",
    "energy_saving_percent", "throughput_improvement_percent", "fpga_inference_speedup",
    "fpga_perf_per_watt", "gpu_training_acceleration",
]

GPU_FPGA_SCENARIO = T.StructType(
    [T.StructField("scenario_name", T.StringType(), False),
     T.StructField("baseline_platform", T.StringType(), False),
     T.StructField("training_platform", T.StringType(), False),
     T.StructField("inference_platform", T.StringType(), False)]
    + [T.StructField(c, T.DoubleType(), False) for c in SCENARIO_METRIC_FIELDS]
)

# Primary keys and references (enforced by the data-quality operators, not Spark).
PRIMARY_KEYS = {
    "rooms": ["room_id"],
    "racks": ["rack_id"],
    "assets": ["asset_id"],
    "telemetry_metrics": ["ts", "asset_id"],
    "ai_model_results": ["model_name"],
    "ai_model_features": ["feature_name"],
    "ai_feature_importance": ["model_name", "feature_name"],
    "sustainability_kpi_config": ["profile_name"],
    "sustainability_kpi_metadata": ["kpi_key"],
    "sustainability_kpi_snapshots": ["ts"],
    "data_centre_sources": ["dc_key"],
    "gpu_fpga_workload": ["workload_name"],
    "gpu_fpga_platform_metrics": ["platform"],
    "gpu_fpga_scenario": ["scenario_name"],
}

FOREIGN_KEYS = [
    # (child, child columns, parent, parent columns)
    ("racks", ["room_id"], "rooms", ["room_id"]),
    ("assets", ["room_id"], "rooms", ["room_id"]),
    ("assets", ["rack_id"], "racks", ["rack_id"]),
    ("telemetry_metrics", ["asset_id"], "assets", ["asset_id"]),
    ("ai_feature_importance", ["model_name"], "ai_model_results", ["model_name"]),
    ("ai_feature_importance", ["feature_name"], "ai_model_features", ["feature_name"]),
]

TABLE_SCHEMAS = {
    "rooms": ROOMS, "racks": RACKS, "assets": ASSETS, "telemetry_metrics": TELEMETRY,
    "ai_model_results": AI_MODEL_RESULTS, "ai_model_features": AI_MODEL_FEATURES,
    "ai_feature_importance": AI_FEATURE_IMPORTANCE, "sustainability_kpi_config": KPI_CONFIG,
    "sustainability_kpi_metadata": KPI_METADATA, "sustainability_kpi_snapshots": KPI_SNAPSHOTS,
    "data_centre_sources": DATA_CENTRE_SOURCES, "gpu_fpga_workload": GPU_FPGA_WORKLOAD,
    "gpu_fpga_platform_metrics": GPU_FPGA_PLATFORM_METRICS, "gpu_fpga_scenario": GPU_FPGA_SCENARIO,
}
