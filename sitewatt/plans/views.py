"""SQL surface: the operational views as Spark temp views.

``register_views`` publishes the tables and the derived views under the names
dashboards and scripts already use (``latest_asset_metrics``,
``latest_rack_metrics``, ``active_alerts``, ``sustainability_prom_metrics``,
...), each backed by the corresponding DataFrame operator, so existing SQL can
run on ``spark.sql`` with only dialect changes (e.g. ``::NUMERIC`` casts, which
in Spark mean ``DECIMAL(10,0)``, should be dropped).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitewatt.operators import alerts as A
from sitewatt.operators import kpi as KPI
from sitewatt.operators import rollups as R
from sitewatt.operators.accelerators import platform_long
from sitewatt.operators.latest import latest_per_key, latest_row
from sitewatt.operators.registry import source_freshness


def register_views(spark: SparkSession, telemetry: DataFrame, assets: DataFrame, rooms: DataFrame | None = None,
                   racks: DataFrame | None = None, kpi: DataFrame | None = None, sources: DataFrame | None = None,
                   platforms: DataFrame | None = None, scenario: DataFrame | None = None,
                   extra: dict[str, DataFrame] | None = None) -> list[str]:
    """Create or replace the temp views; returns their names. ``kpi`` defaults
    to the KPI pipeline over ``telemetry``."""
    latest = latest_per_key(telemetry)
    kpi = kpi if kpi is not None else KPI.kpi_snapshots(telemetry)
    latest_kpi = latest_row(kpi)
    views = {
        "telemetry_metrics": telemetry,
        "assets": assets,
        "latest_asset_metrics": latest,
        "latest_rack_metrics": R.rack_rollup(latest, assets),
        "latest_room_metrics": R.room_rollup(latest, assets),
        "latest_site_summary": R.site_summary(latest),
        "active_alerts": A.active_alerts(latest, assets),
        "sustainability_kpi_snapshots": kpi,
        "latest_sustainability_snapshot": latest_kpi,
        "sustainability_prom_metrics": KPI.kpi_long(latest_kpi),
    }
    if rooms is not None:
        views["rooms"] = rooms
    if racks is not None:
        views["racks"] = racks
    if sources is not None:
        views["data_centre_sources"] = sources
        views["latest_connection_status"] = source_freshness(sources, latest)
    if platforms is not None:
        views["gpu_fpga_platform_metrics"] = platforms
    if scenario is not None:
        views["gpu_fpga_scenario"] = scenario
    if platforms is not None and scenario is not None:
        views["gpu_fpga_prom_metrics"] = platform_long(platforms, scenario)
    views.update(extra or {})
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)
