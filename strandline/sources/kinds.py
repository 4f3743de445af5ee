"""Column kinds of text tables: datetime, numeric or text, judged from whole columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.dates import (
    DATE_FORMATS,
    RFC3339,
    TIME_FORMATS,
    epoch_of_text,
    is_date_only,
    matches_date,
    matches_time,
)
from strandline.functions.numbers import share_numeric
from strandline.functions.units import channel_role, infer_unit

STARTS = r"^\d{1,4}[-/:]"
DATE_SHARE, TIME_SHARE, NUMERIC_SHARE = 0.7, 0.8, 0.5


def column(name: str) -> Column:
    """A column by its plain name, whatever signs that has."""
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class Guess:
    """Best date layout of a column's values, and whether they are bare times."""

    date_format: str | None
    time_only: bool

    @property
    def date_only(self) -> bool:
        return is_date_only(self.date_format)


def guess_dates(df: DataFrame, cols: Sequence[str]) -> dict[str, Guess]:
    """Score every layout on all non-empty cells in one aggregation; the best share wins, the earliest layout on ties.

    Every layout begins with a number and its separator; cells that do not are counted, but tried in none.
    """
    layouts = [RFC3339, *DATE_FORMATS]
    c = F.when(F.col("cell").rlike(STARTS), F.col("cell"))
    scores = [F.avg(matches_date(c, f).cast("double")).alias(f"d{i}") for i, f in enumerate(layouts)]
    scores += [F.avg(matches_time(c, f).cast("double")).alias(f"t{i}") for i, f in enumerate(TIME_FORMATS)]
    cells = df.select(F.posexplode(F.array(*[column(c) for c in cols])).alias("position", "cell")).filter("cell is not null and cell <> ''")
    rows = cells.groupBy("position").agg(*scores).collect()
    out = {c: Guess(None, False) for c in cols}
    for r in rows:
        best = max(range(len(layouts)), key=lambda i: (r[f"d{i}"], -i))
        fmt = layouts[best] if r[f"d{best}"] > 0 else None
        out[cols[r.position]] = Guess(fmt, any(r[f"t{i}"] > TIME_SHARE for i in range(len(TIME_FORMATS))))
    return out


def infer_kinds(
    df: DataFrame, order: Sequence[str], cols: Sequence[str] | None = None, guesses: dict[str, Guess] | None = None
) -> DataFrame:
    """(position, column, kind, numeric, date_format, date_share, numeric_share, unit, role) per column.

    datetime when over 70 % of all cells parse in the best layout, numeric when at least half are
    numbers, else text; typed columns need no look at the data.
    """
    cols = [c for c in (cols or df.columns) if c not in order]
    text = [c for c in cols if isinstance(df.schema[c].dataType, T.StringType)]
    guesses = guesses or (guess_dates(df, text) if text else {})
    measured = []
    for i, c in enumerate(text):
        fmt = guesses[c].date_format
        share = F.avg(epoch_of_text(column(c), fmt).isNotNull().cast("double")) if fmt else F.lit(0.0)
        measured += [F.coalesce(share, F.lit(0.0)).alias(f"d{i}"), share_numeric(column(c)).alias(f"n{i}")]
    got = df.agg(*measured).first() if measured else {}
    rows = []
    for i, c in enumerate(cols):
        kind_ = df.schema[c].dataType
        if c in text:
            k = text.index(c)
            fmt, ds, ns = guesses[c].date_format, got[f"d{k}"], got[f"n{k}"]
            is_date = fmt is not None and ds > DATE_SHARE
        else:
            is_date = isinstance(kind_, (T.TimestampType, T.TimestampNTZType, T.DateType))
            fmt, ds, ns = None, float(is_date), float(isinstance(kind_, T.NumericType))
        kind = "datetime" if is_date else "numeric" if ns >= NUMERIC_SHARE else "text"
        rows.append((i, c, kind, kind != "text", fmt if is_date else None, float(ds), float(ns)))
    schema = "position int, column string, kind string, numeric boolean, date_format string, date_share double, numeric_share double"
    out = df.sparkSession.createDataFrame(rows, schema)
    return out.withColumn("unit", infer_unit(F.col("column"))).withColumn("role", channel_role(F.col("column")))


def typed(df: DataFrame, kinds: DataFrame) -> DataFrame:
    """Text columns turned into doubles and zone-free timestamps by their kind."""
    from strandline.functions.dates import parse_time
    from strandline.functions.numbers import stripped, to_number

    made = {}
    for r in kinds.collect():
        if not isinstance(df.schema[r.column].dataType, T.StringType):
            continue
        if r.kind == "datetime":
            made[r.column] = parse_time(stripped(column(r.column)), r.date_format)
        elif r.kind == "numeric":
            made[r.column] = to_number(column(r.column))
    return df.withColumns(made) if made else df


def merge_date_time(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Join each date-only column with a time-only column right after it into `Date Time`."""
    cols = [c for c in df.columns if c not in order]
    guesses = guess_dates(df, cols)
    out, i = [], 0
    while i < len(cols):
        here, then = cols[i], cols[i + 1] if i + 1 < len(cols) else None
        if then and guesses[here].date_only and guesses[then].time_only:
            a, b = F.trim(F.coalesce(column(here), F.lit(""))), F.trim(F.coalesce(column(then), F.lit("")))
            joined = F.when((a == "") | (b == ""), "").otherwise(F.concat(a, F.lit(" "), b))
            out.append(joined.alias(f"{here.strip()} {then.strip()}"))
            i += 2
        else:
            out.append(column(here))
            i += 1
    return df.select(*order, *out)
