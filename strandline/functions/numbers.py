"""Text cells to numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n\x0b\x0c"
# Fixed value: what counts as a decimal number (infinities and NaN are missing anyway).
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def stripped(c: Column) -> Column:
    return F.btrim(c.cast("string"), F.lit(BLANKS))


def to_number(c: Column) -> Column:
    """Trimmed cell as a double; NULL when it is no finite decimal number."""
    s = stripped(c)
    v = F.when(s.rlike(NUMBER), s).try_cast("double")
    return F.when(F.abs(v) != float("inf"), v)


def share_numeric(c: Column) -> Column:
    """Aggregate: share of all cells that are finite numbers (0 for no cells)."""
    return F.coalesce(F.avg(to_number(c).isNotNull().cast("double")), F.lit(0.0))
