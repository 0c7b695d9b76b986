"""sitewatt: data-centre operations analytics as plain Spark DataFrame operators.

Telemetry (CPU, power, inlet/outlet temperature, grid emission factor) becomes
current-state views per asset, rack, room and site, rule-based alerts, bucketed
trends, a short-horizon forecast, carbon accounting and sustainability KPIs.
Every operator is a ``DataFrame -> DataFrame`` function built from native
Spark expressions; nothing runs row-at-a-time in Python.
"""

from sitewatt.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
