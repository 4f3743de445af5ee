"""Measurement unit guessed from a column name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords tested in this order, first hit wins.
UNIT_KEYWORDS = [
    ("°C", ["temp"]),
    ("Degrees", ["inc", "azi", "tool-face", "angle"]),
    ("G", ["vibe", "accel", "shock", "gx", "gy", "gz", "grav"]),
    ("CPS", ["gamma"]),
    ("Counts", ["pulse", "flow"]),
    ("V", ["1v8", "5v", "3v3", "bat", "bus"]),
    ("mA", ["current"]),
    ("Gauss", ["mag", "mx", "my", "mz"]),
    ("RPM", ["rpm"]),
]
NO_UNIT = "units"

# Names of channels computed from others.
DERIVED_WORDS = ["calibrated", "calculated", "computed", "corrected", "derived", "adjusted"]


def infer_unit(name: Column) -> Column:
    low = F.lower(name)
    out = None
    for unit, words in UNIT_KEYWORDS:
        hit = low.rlike("|".join(words))
        out = F.when(hit, unit) if out is None else out.when(hit, unit)
    return out.otherwise(NO_UNIT)


def channel_role(name: Column) -> Column:
    """0 raw source, 2 derived output, 1 neither."""
    low = F.lower(name)
    return F.when(low.startswith("raw"), 0).when(low.rlike("|".join(DERIVED_WORDS)), 2).otherwise(1)
