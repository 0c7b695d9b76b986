"""Command line: run one dashboard page over a directory of driver tables.

    python -m sitewatt overview --sf /root/testdata/sf0.01 --room EUROPE
    python -m sitewatt carbon --sf /root/testdata/sf0.01 --rows 5
"""

from __future__ import annotations

import argparse

from sitewatt.plans import dashboards as DB
from sitewatt.plans.catalog import Ctx
from sitewatt.session import get_session

PAGES = {"overview": DB.overview, "analytics": DB.analytics, "carbon": DB.carbon,
         "sustainability": DB.sustainability}


def main(argv=None):
    ap = argparse.ArgumentParser(prog="sitewatt")
    ap.add_argument("page", choices=sorted(PAGES))
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--master", default="local[*]")
    ap.add_argument("--room", default="All")
    ap.add_argument("--rack", default="All")
    ap.add_argument("--server", default="All")
    ap.add_argument("--rows", type=int, default=10)
    ap.add_argument("--start", default=None, help="time range start, e.g. '2024-01-30 00:00:00'")
    ap.add_argument("--end", default=None, help="time range end (inclusive)")
    ap.add_argument("--horizon", default="15 minutes", help="forecast window (analytics page)")
    a = ap.parse_args(argv)
    spark = get_session(a.master, 8)
    c = Ctx(spark, a.sf)
    with DB.Refresh(c.tm, c.assets, as_of=c.as_of) as r:
        rng = dict(start=a.start, end=a.end)
        if a.page == "sustainability":
            panels = DB.sustainability(r, **rng)
        elif a.page == "analytics":
            panels = DB.analytics(r, room=a.room, rack=a.rack, server=a.server, horizon=a.horizon, **rng)
        else:
            panels = PAGES[a.page](r, room=a.room, rack=a.rack, server=a.server, **rng)
        for name, df in panels.items():
            print(f"== {name}")
            df.show(a.rows, truncate=False)


if __name__ == "__main__":
    main()
