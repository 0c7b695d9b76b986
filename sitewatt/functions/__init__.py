"""Column-level building blocks: scalar formulas, rounding, bands."""

from sitewatt.functions.scalar import (
    clamp, dec, emission_factor, carbon_kg, status_level, day_fraction, hourly_phase,
    to_double, round_to, num_text, epoch_seconds,
)
from sitewatt.functions.bands import band, STEP_LISTS

__all__ = [
    "clamp", "dec", "emission_factor", "carbon_kg", "status_level", "day_fraction",
    "hourly_phase", "to_double", "round_to", "num_text", "epoch_seconds", "band", "STEP_LISTS",
]
