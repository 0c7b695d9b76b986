"""SQL over the registered views equals the DataFrame operators."""

from conftest import SF_SMALL

from sitewatt.plans.catalog import QUERIES, Ctx
from sitewatt.plans.views import register_views


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_sql_views_match_operators(spark):
    c = Ctx(spark, SF_SMALL)
    names = register_views(spark, c.tm, c.assets, rooms=c.fx.rooms, racks=c.fx.racks, sources=c.fx.sources)
    assert {"latest_asset_metrics", "active_alerts", "latest_rack_metrics", "latest_connection_status"} <= set(names)
    assert spark.sql("SELECT COUNT(*) AS n FROM active_alerts").first()["n"] == QUERIES["active_alerts"](spark, SF_SMALL).count()
    panel = spark.sql("""
        SELECT a.rack_name, CAST(ROUND(SUM(l.power_w), 1) AS DOUBLE) AS value
        FROM latest_asset_metrics l JOIN assets a USING (asset_id)
        GROUP BY a.rack_name""")
    assert _rows(panel) == _rows(QUERIES["rack_power"](spark, SF_SMALL))
    assert _rows(spark.table("latest_rack_metrics")) == _rows(QUERIES["rack_rollup"](spark, SF_SMALL))
    n = spark.sql("SELECT COUNT(*) AS n FROM sustainability_prom_metrics").first()["n"]
    assert n == 11
