"""Time axis columns and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def wall_micros(c: Column) -> Column:
    """Microseconds since 1970 of a zone-free timestamp, whatever the session zone."""
    days = F.unix_date(c.cast("date")).cast("bigint") * 86_400_000_000
    clock = F.hour(c).cast("bigint") * 3_600_000_000 + F.minute(c).cast("bigint") * 60_000_000
    return days + clock + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")


def wall_time(micros: Column) -> Column:
    """Zone-free timestamp from microseconds since 1970."""
    return F.timestamp_add("MICROSECOND", micros, F.expr("timestamp_ntz'1970-01-01 00:00:00'"))


def epoch_seconds(df: DataFrame, name: str) -> Column:
    """Numeric axis of a column: epoch seconds for times (zone-free ones read as UTC), else the number."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        return wall_micros(F.col(name)) / F.lit(1e6)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(name)) / F.lit(1e6)
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(name)) * F.lit(86400.0)
    return F.col(name).cast("double")


def format_epoch(seconds: Column) -> Column:
    """`yyyy-MM-dd HH:mm:ss`, with milliseconds (cut, not rounded) only when there is a fraction."""
    whole = F.floor(seconds)
    nanos = F.floor((seconds - whole) * 1e9)
    text = wall_time(whole.cast("bigint") * 1_000_000).cast("string")
    millis = F.lpad(F.floor(nanos / 1e6).cast("string"), 3, "0")
    return F.when(nanos == 0, text).otherwise(F.concat(text, F.lit("."), millis))
