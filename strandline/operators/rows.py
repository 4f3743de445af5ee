"""Row search, filters, ordering and paging."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions import fx
from strandline.functions.numbers import to_number
from strandline.plans.layout import BUCKET, DEFAULT, ROW, Layout
from strandline.plans.ordering import Ordered, composite, facts, find_ranges, join_sized, order_rows

PAGE_DEFAULT = 20
TOP_ROWS = 20_000  # pages that end further down are found by ranges


def number_of(df: DataFrame, name: str) -> Column:
    """A column as finite doubles, whether it is typed or text."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return to_number(F.col(name))
    return fx.finite(F.col(name).cast("double")) if isinstance(kind, T.FractionalType) else F.col(name).cast("double")


def contains(c: Column, needle: str) -> Column:
    return F.lower(c.cast("string")).contains(needle.lower())


def search(df: DataFrame, needle: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows where any column contains the text, ignoring case; an empty text keeps all."""
    if not needle:
        return df
    hit = [F.coalesce(contains(F.col(c), needle), F.lit(False)) for c in (cols or df.columns)]
    return df.filter(reduce(Column.__or__, hit))


@dataclass(frozen=True)
class TextFilter:
    text: str

    def keeps(self, df: DataFrame, name: str) -> Column:
        return contains(F.col(name), self.text) if self.text else F.lit(True)


@dataclass(frozen=True)
class RangeFilter:
    """Inclusive bounds, either open; cells that are no number fail."""

    low: float | None = None
    high: float | None = None

    def keeps(self, df: DataFrame, name: str) -> Column:
        kind = df.schema[name].dataType
        v = F.col(name) if isinstance(kind, T.NumericType) else number_of(df, name)
        out = v.isNotNull() if not isinstance(kind, T.FractionalType) else v.isNotNull() & ~F.isnan(v)
        if self.low is not None:
            out = out & (v >= F.lit(float(self.low)))
        if self.high is not None:
            out = out & (v <= F.lit(float(self.high)))
        return out


def filter_columns(df: DataFrame, filters: Mapping[str, TextFilter | RangeFilter]) -> DataFrame:
    """Rows that pass every column filter."""
    for name, f in filters.items():
        df = df.filter(f.keeps(df, name))
    return df


def filter_rows(df: DataFrame, cond: Column) -> DataFrame:
    """Rows where a formula condition holds; an undecided (missing) one drops the row."""
    return df.filter(cond)


def row_range(o: Ordered, start: int | None = None, end: int | None = None) -> DataFrame:
    d = o.df
    if start is not None:
        d = d.filter(F.col(ROW) >= start)
    return d if end is None else d.filter(F.col(ROW) < end)


def x_range(df: DataFrame, x: str, low: float | None = None, high: float | None = None) -> DataFrame:
    if low is not None:
        df = df.filter(fx.ge(x, low))
    return df if high is None else df.filter(fx.le(x, high))


def view_window(o: Ordered, x: str, low: float, high: float) -> DataFrame:
    """Rows with x in [low, high] plus one row on each side, so that lines run on past the view."""
    c = F.col(x)
    pads = o.df.groupBy(*o.by).agg(
        F.max(F.when(c < low, F.col(ROW))).alias("_lo"), F.min(F.when(c > high, F.col(ROW))).alias("_hi")
    )
    if o.by:
        d = join_sized(o.df, pads, o.by)
        lo, hi = F.col("_lo"), F.col("_hi")
    else:
        d, pad = o.df, facts(pads)
        lo, hi = pad["_lo"], pad["_hi"]
    inside = ((c >= low) & (c <= high)) | F.coalesce(F.col(ROW) == lo, F.lit(False))
    return d.filter(inside | F.coalesce(F.col(ROW) == hi, F.lit(False))).drop("_lo", "_hi")


def scatter(df: DataFrame, order_by: Sequence[str], x: str, y: str) -> DataFrame:
    """Finite (x, y) pairs in row order with their colour fraction i / (n - 1)."""
    pairs = df.select(*order_by, number_of(df, x).alias("x"), number_of(df, y).alias("y")).filter(
        "x is not null and y is not null"
    )
    o = order_rows(pairs, order_by)
    frac = F.col(ROW) / F.lit(float(o.n - 1)) if o.n > 1 else F.lit(0.0)
    return o.df.select(ROW, "x", "y", frac.alias("time_frac"))


def log_y(df: DataFrame, y: str) -> DataFrame:
    """Positive values only, as log10."""
    return df.filter(fx.gt(y, 0.0)).withColumn(y, F.log10(F.col(y).cast("double")))


def sort_keys(df: DataFrame, name: str, desc: bool = False, numeric: bool | None = None, tie: Sequence[str] = (ROW,)):
    """Sort expressions: numbers before blanks (blanks first when descending), ties in row order."""
    kind = df.schema[name].dataType
    if numeric is None:
        numeric = isinstance(kind, T.NumericType)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) or not numeric:
        c = F.col(name)
    else:
        c = number_of(df, name)
    return [c.desc_nulls_first() if desc else c.asc_nulls_last(), *[F.col(t).asc() for t in tie]]


def sort_rows(df: DataFrame, name: str | None = None, desc: bool = False, tie: Sequence[str] = (ROW,), **kw) -> DataFrame:
    """Sorted rows; without a column the original order."""
    return df.orderBy(*(sort_keys(df, name, desc, tie=tie, **kw) if name else tie))


@dataclass(frozen=True)
class RowQuery:
    search: str = ""
    filters: Mapping[str, TextFilter | RangeFilter] = field(default_factory=dict)
    cond: Column | None = None
    sort: str | None = None
    desc: bool = False
    columns: Sequence[str] | None = None

    def matching(self, df: DataFrame) -> DataFrame:
        out = filter_columns(search(df, self.search), self.filters)
        return out if self.cond is None else filter_rows(out, self.cond)

    def total(self, df: DataFrame) -> DataFrame:
        return self.matching(df).agg(F.count(F.lit(1)).alias("total"))

    def page(
        self, df: DataFrame, offset: int = 0, limit: int = PAGE_DEFAULT, tie: Sequence[str] = (ROW,), layout: Layout = DEFAULT
    ) -> DataFrame:
        """One page in view order.

        Near the top it is a top-k of offset + limit rows.  Further down the rows of each value range are counted, and
        only the ranges that the page touches are sorted, each in its own task.
        """
        found = self.matching(df)
        sort = self.sort if self.sort in df.columns else None
        if offset + limit > TOP_ROWS:
            out = _deep_page(found, sort, self.desc, tie, offset, limit, layout)
        else:
            out = sort_rows(found, sort, self.desc, tie=tie).offset(offset).limit(limit)
        return out if self.columns is None else out.select(*self.columns)


def _view_keys(df: DataFrame, name: str, desc: bool) -> DataFrame:
    """Adds `_blank` and `_k`, which sort in ascending order as the column does in view order."""
    kind = df.schema[name].dataType
    key = number_of(df, name) if isinstance(kind, T.NumericType) else F.col(name)
    if desc and isinstance(kind, T.NumericType):
        key = -key
    elif desc and isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        key = -F.unix_micros(F.col(name).cast("timestamp"))
    elif desc:
        # hex digits of the bytes, mirrored, and a sign above all of them: a longer text comes before its own beginning
        key = F.concat(F.translate(F.hex(F.col(name).cast("string")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("~"))
    d = df.withColumn("_blank", key.isNull() if not desc else key.isNotNull())
    return d.withColumn("_k", key)


def view_index(df: DataFrame, name: str, tie: Sequence[str], desc: bool = False) -> DataFrame:
    """Rows numbered in view order, without a single-task sort: ranges over (key, row order)."""
    d = _view_keys(df, name, desc)
    return order_rows(d, ["_blank", "_k", *tie]).df.withColumnRenamed(ROW, "view_row").drop("_blank", "_k")


def page_ranges(df: DataFrame, sort: str | None, desc: bool, tie: Sequence[str], offset: int, limit: int, layout: Layout) -> tuple[DataFrame, list[str], dict[int, int]]:
    """Rows of the value ranges that the page touches, the keys that order them, and the rows before each range."""
    d = _view_keys(df, sort, desc) if sort else df
    names = ["_blank", "_k", *tie] if sort else list(tie)
    ranges = find_ranges(d, names, d.count(), layout)
    keyed = ranges.assign(d, composite(d, names))
    before, seen = {}, 0
    for r in sorted(keyed.groupBy(BUCKET).count().collect(), key=lambda r: r[BUCKET]):
        if seen < offset + limit and seen + r["count"] > offset:
            before[r[BUCKET]] = seen
        seen += r["count"]
    return keyed.filter(F.col(BUCKET).isin(list(before))), names, before


def _deep_page(df: DataFrame, sort: str | None, desc: bool, tie: Sequence[str], offset: int, limit: int, layout: Layout) -> DataFrame:
    rows, names, before = page_ranges(df, sort, desc, tie, offset, limit, layout)
    place = F.row_number().over(Window.partitionBy(BUCKET).orderBy(*names)) - 1
    if before:
        place = place + F.element_at(F.create_map(*[F.lit(v) for kv in before.items() for v in kv]), F.col(BUCKET))
    page = rows.withColumn("_place", place).filter((F.col("_place") >= offset) & (F.col("_place") < offset + limit))
    return page.orderBy("_place").select(*df.columns)


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence, k: int) -> DataFrame:
    """First k rows per group; ranks are cut on the map side first."""
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rn", rn).filter(F.col("_rn") <= k).drop("_rn")


def export_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None, cond: Column | None = None) -> int:
    """Write selected columns of matching rows as quoted CSV; returns the rows written."""
    out = df if cond is None else filter_rows(df, cond)
    out = out.select(*columns) if columns else out
    seen = Observation("export")
    out.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").csv(
        path, header=True, escape='"', emptyValue="", nullValue=""
    )
    return seen.get["rows"]
