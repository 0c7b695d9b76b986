"""A dashboard refresh (shared, persisted latest state) equals the registered
single-panel queries."""

from conftest import SF_SMALL

from sitewatt.plans import dashboards as DB
from sitewatt.plans.catalog import QUERIES, Ctx


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_overview_and_carbon_panels_match_queries(spark):
    c = Ctx(spark, SF_SMALL)
    with DB.Refresh(c.tm, c.assets, as_of=c.as_of) as r:
        ov = DB.overview(r)
        cb = DB.carbon(r)
        an = DB.analytics(r, horizon="6 hours")
        pairs = [(ov["site_power_draw"], "site_power"), (ov["average_cpu"], "avg_cpu"),
                 (ov["active_alerts"], "alert_count"), (ov["power_trend"], "power_trend"),
                 (ov["active_alert_feed"], "alert_feed"), (ov["live_asset_status"], "live_status"),
                 (cb["high_carbon_assets"], "high_carbon_assets"), (cb["room_rack_footprint"], "footprint"),
                 (an["forecast"], "forecast_6h"), (an["rack_stress_score"], "rack_stress")]
        for df, name in pairs:
            assert _rows(df) == _rows(QUERIES[name](spark, SF_SMALL)), name
        counts = DB.run_all(ov)
        assert len(counts) == 15


def test_sustainability_and_connect(spark):
    c = Ctx(spark, SF_SMALL)
    with DB.Refresh(c.tm, c.assets, as_of=c.as_of) as r:
        su = DB.sustainability(r)
        assert _rows(su["latest_pue"]) == _rows(QUERIES["latest_pue"](spark, SF_SMALL))
        assert _rows(su["average_metrics_detail"]) == _rows(QUERIES["average_metrics_detail"](spark, SF_SMALL))
        cn = DB.connect(r, c.fx.sources, "Supplier#000000001")
        assert _rows(cn["last_sync"]) == _rows(QUERIES["last_sync_epoch"](spark, SF_SMALL))
        ai = DB.ai_optimisation(r)
        assert _rows(ai["actual_vs_predicted_power"]) == _rows(QUERIES["actual_vs_predicted"](spark, SF_SMALL))


def test_refresh_from_rollup_equals_raw(spark):
    from sitewatt.operators.timeseries import bucket_partials
    c = Ctx(spark, SF_SMALL)
    rollup = bucket_partials(c.tm)
    with DB.Refresh(c.tm, c.assets, as_of=c.as_of) as raw, DB.Refresh(c.tm, c.assets, as_of=c.as_of,
                                                                       rollup=rollup) as rolled:
        for page in (DB.overview, DB.carbon):
            a, b = page(raw, room="EUROPE"), page(rolled, room="EUROPE")
            for name in a:
                if "trend" in name or "envelope" in name or "context" in name:
                    assert _rows(a[name]) == _rows(b[name]), name
