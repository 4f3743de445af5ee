"""Date patterns: which text matches which, and text to epoch seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.numbers import stripped
from strandline.functions.times import wall_micros, wall_time

RFC3339 = "rfc3339"

# Accepted date layouts in order of preference (earlier wins ties).
DATE_FORMATS = [
    "%Y-%m-%dT%H:%M:%S%.f",
    "%Y-%m-%dT%H:%M:%S",
    "%Y-%m-%d %H:%M:%S",
    "%m/%d/%Y %H:%M:%S",
    "%d/%m/%Y %H:%M:%S",
    "%Y/%m/%d %H:%M:%S",
    "%m-%d-%Y %H:%M:%S",
    "%d-%m-%Y %H:%M:%S",
    "%Y-%m-%d %H:%M:%S%.f",
    "%m/%d/%Y %H:%M:%S%.f",
    "%d/%m/%Y %H:%M:%S%.f",
    "%Y/%m/%d %H:%M:%S%.f",
    "%m-%d-%Y %H:%M:%S%.f",
    "%d-%m-%Y %H:%M:%S%.f",
    "%m/%d/%Y %I:%M:%S %p",
    "%d/%m/%Y %I:%M:%S %p",
    "%Y-%m-%d %I:%M:%S %p",
    "%m/%d/%Y %I:%M %p",
    "%d/%m/%Y %I:%M %p",
    "%Y-%m-%d %I:%M %p",
    "%Y-%m-%d",
    "%m/%d/%Y",
    "%d/%m/%Y",
    "%Y/%m/%d",
    "%m-%d-%Y",
    "%d-%m-%Y",
]
# Time-of-day layouts.
TIME_FORMATS = ["%I:%M:%S %p", "%I:%M %p", "%H:%M:%S%.f", "%H:%M:%S", "%H:%M"]

RFC3339_SHAPE = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"

# field: (group pattern, Spark pattern letter)
_FIELDS = {
    "%Y": (r"\d{1,4}", "y"), "%m": (r"\d{1,2}", "M"), "%d": (r"\d{1,2}", "d"), "%H": (r"\d{1,2}", "H"),
    "%I": (r"\d{1,2}", "h"), "%M": (r"\d{1,2}", "m"), "%S": (r"\d{1,2}", "s"), "%p": (r"[AaPp][Mm]", "a"),
    "%.f": (r"(?:\.\d{1,9})?", "[.SSSSSSSSS]"),
}


def _parts(fmt: str) -> list[str]:
    out, i = [], 0
    while i < len(fmt):
        size = 3 if fmt.startswith("%.f", i) else 2 if fmt[i] == "%" else 1
        out.append(fmt[i : i + size])
        i += size
    return out


def _shape(fmt: str) -> str:
    return "^" + "".join(_FIELDS[p][0] if p in _FIELDS else r"\s*" if p == " " else p for p in _parts(fmt)) + "$"


def _pattern(fmt: str) -> str:
    return "".join(_FIELDS[p][1] if p in _FIELDS else f"'{p}'" if p.isalpha() else p for p in _parts(fmt))


def _tidy(v: Column, fmt: str) -> Column:
    """Exactly one blank before AM / PM and between date and time, upper-case AM / PM."""
    if "%p" in fmt:
        v = F.regexp_replace(F.upper(v), r"\s*([AP]M)$", " $1")
    return F.regexp_replace(v, r"\s+", " ")


def parse_time(v: Column, fmt: str) -> Column:
    """Timestamp (UTC wall clock, no zone) of a text in one layout, else NULL."""
    if fmt == RFC3339:
        text = F.when(v.rlike(RFC3339_SHAPE), F.upper(v))
        return wall_time(F.unix_micros(F.try_to_timestamp(text)))
    text = F.when(v.rlike(_shape(fmt)), _tidy(v, fmt))
    return _ntz(text, fmt)


def _ntz(text: Column, fmt: str) -> Column:
    # read as UTC whatever the session zone: parse with an explicit zone suffix, then drop it
    at = F.try_to_timestamp(F.concat(text, F.lit("|Z")), F.lit(_pattern(fmt) + "'|'XXX"))
    return wall_time(F.unix_micros(at))


def epoch_of_text(v: Column, fmt: str) -> Column:
    """Epoch seconds at millisecond resolution of a trimmed text, NULL when it does not match."""
    return F.floor(wall_micros(parse_time(stripped(v), fmt)) / 1000.0) / F.lit(1000.0)


def matches_date(v: Column, fmt: str) -> Column:
    return parse_time(v, fmt).isNotNull()


def matches_time(v: Column, fmt: str) -> Column:
    """A bare time of day in one layout (with any date the clock fields must be valid)."""
    text = F.when(v.rlike(_shape(fmt)), F.concat(F.lit("2000-1-1 "), _tidy(v, fmt)))
    return _ntz(text, "%Y-%m-%d " + fmt).isNotNull()


def is_date_only(fmt: str | None) -> bool:
    return fmt is not None and fmt != RFC3339 and "%H" not in fmt and "%I" not in fmt
