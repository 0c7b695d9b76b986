"""Scalar column expressions (JVM-side, inside whole-stage codegen).

All formulas are written with ``pyspark.sql.functions`` so that Catalyst can
fold constants and fuse them into the surrounding stage; no Python UDFs.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for identical results).
# Status thresholds: CPU percent, outlet temperature in C, and power as a
# multiple of the asset's nominal power.
CPU_CRITICAL = 90
CPU_WARNING = 75
OUTLET_CRITICAL = 36
OUTLET_WARNING = 34
POWER_CRITICAL_FACTOR = Decimal("1.18")
POWER_WARNING_FACTOR = Decimal("1.08")
# Grid emission factor curve: base 0.34, daily wave 0.05 shifted by 6 h,
# 8-hourly wave 0.03, clamped to [0.24, 0.43] kg CO2 per kWh.
EF_BASE = 0.34
EF_DAILY_AMPLITUDE = 0.05
EF_DAILY_SHIFT_H = 6.0
EF_BALANCING_AMPLITUDE = 0.03
EF_MIN = 0.24
EF_MAX = 0.43
# ---------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dec(value, precision: int = 18, scale: int | None = None) -> Column:
    """Exact decimal literal (``1.08`` stays 1.08, not a binary double)."""
    d = Decimal(str(value))
    if scale is None:
        scale = max(0, -d.as_tuple().exponent)
    return F.lit(d).cast(f"decimal({precision},{scale})")


def clamp(value, lower, upper) -> Column:
    """``max(lower, min(upper, value))`` on columns or literals."""
    return F.greatest(F.lit(lower), F.least(F.lit(upper), _col(value)))


def round_to(c, digits: int) -> Column:
    """HALF_UP rounding (the SQL ``ROUND``); exact when ``c`` is decimal."""
    return F.round(_col(c), digits)


def to_double(c) -> Column:
    return _col(c).cast("double")


def num_text(c) -> Column:
    """Text of a number as SQL prints it: a decimal keeps its scale (``90.0``, ``540``)."""
    return _col(c).cast("string")


def epoch_seconds(ts) -> Column:
    """Seconds since the epoch as double (``EXTRACT(EPOCH FROM ts)``) of a UTC
    wall-clock timestamp; independent of the session time zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, _col(ts).cast("timestamp_ntz")) / F.lit(1_000_000.0)


def day_fraction(ts) -> Column:
    """(60 h + m) / 1440 of the UTC wall clock."""
    t = _col(ts)
    return (F.hour(t) * 60 + F.minute(t)) / F.lit(1440.0)


def hourly_phase(ts) -> Column:
    """2 pi times the fraction of the day."""
    return F.lit(2 * math.pi) * day_fraction(ts)


def emission_factor(ts) -> Column:
    """Grid emission factor (kg CO2/kWh) from the time of day, UTC."""
    t = _col(ts)
    hour = F.hour(t) + F.minute(t) / F.lit(60.0)
    # Evaluated left to right as ``(h - 6) / 24 * 2 * pi`` so every bit matches.
    pi = F.lit(math.pi)
    renewable = F.lit(EF_BASE) + F.lit(EF_DAILY_AMPLITUDE) * F.sin(
        (hour - F.lit(EF_DAILY_SHIFT_H)) / F.lit(24.0) * F.lit(2.0) * pi)
    balancing = F.lit(EF_BALANCING_AMPLITUDE) * F.sin((hour * F.lit(3.0)) / F.lit(24.0) * F.lit(2.0) * pi)
    return clamp(renewable + balancing, EF_MIN, EF_MAX)


def carbon_kg(power_w, ef) -> Column:
    """kg CO2 per hour at the given draw: power / 1000 * emission factor."""
    return _col(power_w) / F.lit(1000.0) * _col(ef)


def status_level(cpu, outlet, power, nominal, state) -> Column:
    """critical / warning / normal, evaluated on unrounded measurements."""
    cpu, outlet, power, nominal, state = map(_col, (cpu, outlet, power, nominal, state))
    critical = ((cpu >= CPU_CRITICAL) | (outlet >= OUTLET_CRITICAL)
                | (power >= nominal * F.lit(POWER_CRITICAL_FACTOR)))
    warning = ((cpu >= CPU_WARNING) | (outlet >= OUTLET_WARNING)
               | (power >= nominal * F.lit(POWER_WARNING_FACTOR)) | (state != "running"))
    return F.when(critical, "critical").when(warning, "warning").otherwise("normal")
