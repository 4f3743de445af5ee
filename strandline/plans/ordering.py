"""Value ranges and the dense row index.

A global row number would sort the whole table in one task.  Here rows are first assigned to value
ranges of the complete ordering key (so ties on the leading key, or one dominant series, are split
too), numbered inside each range, and shifted by the number of rows in the ranges before.  The range
limits come from a small key sample and are literals in the plan: they only decide balance, never the
result, and every task or retry sees the same ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.times import wall_micros
from strandline.plans.layout import BUCKET, DEFAULT, ROW, Layout


@dataclass(frozen=True)
class Ordered:
    """A DataFrame whose `row_idx` numbers the rows 0.. (per series when `by` is set)."""

    df: DataFrame
    n: int
    by: tuple[str, ...] = ()
    layout: Layout = DEFAULT

    @property
    def block(self) -> int:
        return self.layout.block_for(self.n)

    def with_df(self, df: DataFrame) -> Ordered:
        return replace(self, df=df)

    def select(self, *cols) -> Ordered:
        """Keep the series keys, the row index and the given columns."""
        return self.with_df(self.df.select(*self.by, ROW, *cols))

    def with_column(self, name: str, c: Column) -> Ordered:
        return self.with_df(self.df.withColumn(name, c))


def sortable(df: DataFrame, name: str) -> Column:
    """The column as a JSON-safe value with the same order."""
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, T.TimestampNTZType):
        return wall_micros(c)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.DateType):
        return F.unix_date(c)
    if isinstance(kind, T.BooleanType):
        return c.cast("int")
    if isinstance(kind, (T.NumericType, T.StringType)):
        return c
    raise TypeError(f"column {name} of type {kind.simpleString()} cannot be an ordering key")


@dataclass(frozen=True)
class Ranges:
    """Range limits of a composite key: limit i is the smallest key of range i + 1."""

    limits: tuple[str, ...]
    struct: str

    @property
    def n(self) -> int:
        return len(self.limits) + 1

    def array(self) -> Column:
        return F.from_json(F.lit("[" + ",".join(self.limits) + "]"), f"array<{self.struct}>")

    def assign(self, df: DataFrame, key: Column, name: str = BUCKET) -> DataFrame:
        """Add the range number by bisection; one narrow projection per halving, all generated code."""
        if not self.limits:
            return df.withColumn(name, F.lit(0))
        limits = self.array()
        df = df.withColumn("_key", key).withColumn(name, F.lit(0))
        step = 1 << (len(self.limits).bit_length() - 1)
        while step:
            at = F.col(name) + (step - 1)
            df = df.withColumn(
                name, F.col(name) + F.when(F.get(limits, at) <= F.col("_key"), step).otherwise(0)
            )
            step >>= 1
        return df.drop("_key")


def composite(df: DataFrame, names: Sequence[str]) -> Column:
    return F.struct(*[sortable(df, c).alias(f"k{i}") for i, c in enumerate(names)])


def find_ranges(df: DataFrame, names: Sequence[str], n_rows: int, layout: Layout) -> Ranges:
    """Range limits from a hash-picked key sample of bounded size (about samples_per_bucket each)."""
    wanted = layout.buckets_for(n_rows)
    keys = df.select(composite(df, names).alias("k"))
    struct = keys.schema["k"].dataType.simpleString()
    if wanted == 1:
        return Ranges((), struct)
    share = min(1.0, wanted * layout.samples_per_bucket / n_rows)
    if share < 1.0:
        keys = keys.filter(F.xxhash64("k") < F.lit(int(-(2**63) + share * (2**64 - 1))))
    sample = [r.j for r in keys.distinct().orderBy("k").select(F.to_json("k").alias("j")).collect()]
    picks = [sample[len(sample) * i // wanted] for i in range(1, wanted)] if sample else []
    return Ranges(tuple(dict.fromkeys(picks)), struct)


def null_safe(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in names:
        cond = cond & left[c].eqNullSafe(right[c])
    return cond


def join_small(
    df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left", broadcast: bool = True
) -> DataFrame:
    """Null-safe join that keeps one copy of the keys.  Broadcast only for sides of a proven bound."""
    renamed = small.select(
        *[F.col(k).alias(f"_j_{k}") for k in keys], *[c for c in small.columns if c not in keys]
    )
    cond = F.lit(True)
    for k in keys:
        cond = cond & df[k].eqNullSafe(renamed[f"_j_{k}"])
    return df.join(F.broadcast(renamed) if broadcast else renamed, cond, how).drop(*[f"_j_{k}" for k in keys])


def order_rows(
    df: DataFrame,
    order_by: Sequence[str] | str,
    by: Sequence[str] | str = (),
    n: int | None = None,
    layout: Layout = DEFAULT,
) -> Ordered:
    """Add the dense `row_idx` (0-based, per series when `by` is given) in the order of `order_by`.

    The key must be unique within a series.  Equal keys always meet in one range, so the check rides
    in the same window and raises when a duplicate is read.
    """
    order_by = (order_by,) if isinstance(order_by, str) else tuple(order_by)
    by = (by,) if isinstance(by, str) else tuple(by)
    n = df.count() if n is None else n
    names = (*by, *order_by)
    ranges = find_ranges(df, names, n, layout)
    keyed = ranges.assign(df, composite(df, names))

    w = Window.partitionBy(BUCKET, *by).orderBy(*order_by)
    key = F.struct(*order_by)
    clash = F.lag(key).over(w).eqNullSafe(key)
    rank = F.when(
        clash, F.raise_error(F.lit(f"order key {', '.join(order_by)} is not unique")).cast("bigint")
    ).otherwise(F.row_number().over(w).cast("bigint") - 1)
    out = keyed.withColumn(ROW, rank)
    if ranges.n > 1:
        out = join_small(out, _offsets(keyed, ranges, by), (*by, BUCKET))
        out = out.withColumn(ROW, F.col(ROW) + F.coalesce("_before", F.lit(0))).drop("_before")
    return Ordered(out.drop(BUCKET), n, by, layout)


def _offsets(keyed: DataFrame, ranges: Ranges, by: tuple[str, ...]) -> DataFrame:
    """Rows before each (series, range) fragment, only where not 0: at most one row per range limit."""
    if by:
        limits = keyed.sparkSession.range(1).select(F.explode(ranges.array()).alias("k"))
        spanning = limits.select(*[F.col(f"k.k{i}").alias(f"_s{i}") for i in range(len(by))]).distinct()
        cond = F.lit(True)
        for i, c in enumerate(by):
            cond = cond & sortable(keyed, c).eqNullSafe(F.col(f"_s{i}"))
        keyed = keyed.join(F.broadcast(spanning), cond, "left_semi")
    counts = keyed.groupBy(*by, BUCKET).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    return (
        counts.withColumn("_before", F.sum("_n").over(before)).filter("_before is not null").drop("_n")
    )


BROADCAST_ROWS = 100_000


def join_sized(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join per-series facts, broadcasting them only after counting that they are few.

    Beyond the limit a shuffled join is used, where adaptive execution splits a dominant series.
    """
    if not keys:
        return df.join(F.broadcast(small), how=how)
    few = small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return join_small(df, small, keys, how, broadcast=few)


def with_series_size(o: Ordered, name: str = "_n") -> Ordered:
    """Add the number of rows of each row's series."""
    if not o.by:
        return o.with_df(o.df.withColumn(name, F.lit(o.n).cast("bigint")))
    sizes = o.df.groupBy(*o.by).agg(F.count(F.lit(1)).alias(name))
    return o.with_df(join_sized(o.df, sizes, o.by))


def facts(small: DataFrame) -> Column:
    """The single row of an aggregate as a struct-valued scalar subquery."""
    return small.select(F.struct("*").alias("f")).scalar()
