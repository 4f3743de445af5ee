"""Exact order statistics without sorting the data.

The built-in exact percentile keeps every distinct value of a group in one task.  Here the (group,
value) line is cut into ranges, rows per range are counted (partial aggregation, no data shuffle), the
ranges that hold a wanted rank are found on that small table, and only their rows - pre-counted by
distinct value, so a dominant value is one row - are shuffled and ranked.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.plans.layout import BUCKET, DEFAULT, Layout
from strandline.plans.ordering import Ranges, composite, find_ranges, join_small
from strandline.plans.staging import settled

Pick = Callable[[Column], Column]


def upper_median_rank(n: Column) -> Column:
    """0-based rank of the upper middle value."""
    return F.floor(n / 2)


def lower_median_rank(n: Column) -> Column:
    return F.floor((n - 1) / 2)


def nearest_rank(f: float) -> Pick:
    """0-based rank round((n - 1) * f), halves away from zero."""
    return lambda n: F.floor((n - 1) * F.lit(float(f)) + 0.5)


def truncated_rank(f: float, of_last: bool) -> Pick:
    """0-based rank int(n * f), or int((n - 1) * f)."""
    return lambda n: F.floor(((n - 1) if of_last else n) * F.lit(float(f)))


def pick_ranks(
    df: DataFrame,
    value: str,
    picks: dict[str, Pick],
    by: Sequence[str] = (),
    n: int | None = None,
    layout: Layout = DEFAULT,
    largest: int | None = None,
) -> DataFrame:
    """Value at each requested rank of the non-null `value`s: (by.., n, one column per pick).

    `n` bounds the rows in all, `largest` those of any one group (both counted or taken as `n` when
    unknown).  Groups small enough for one task skip the ranges.
    """
    by = tuple(by)
    d = df.select(*by, value).filter(F.col(value).isNotNull())
    n = d.count() if n is None else n
    if (n if largest is None else largest) <= layout.direct_rows:
        ranges = Ranges((), "")
    else:
        ranges = find_ranges(d, (*by, value), n, layout)
    d = ranges.assign(d, composite(d, (*by, value)) if ranges.limits else F.lit(0))
    rank = {k: f(F.col("n")).cast("bigint") for k, f in picks.items()}

    if ranges.n == 1:
        ranked = d.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
        part: tuple[str, ...] = by
        ranked = ranked.withColumn("n", F.sum("_c").over(Window.partitionBy(*by))).withColumn("_before", F.lit(0))
    else:
        counts = d.groupBy(*by, BUCKET).agg(F.count(F.lit(1)).alias("_c"))
        seq = Window.partitionBy(*by).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(seq), F.lit(0))).withColumn(
            "n", F.sum("_c").over(Window.partitionBy(*by))
        )
        hit = F.lit(False)
        for r in rank.values():
            hit = hit | ((r >= F.col("_before")) & (r < F.col("_before") + F.col("_c")))
        wanted = settled(counts.filter(hit).drop("_c"))
        # distinct range numbers: at most max_buckets rows
        d = d.join(F.broadcast(wanted.select(BUCKET).distinct()), BUCKET, "left_semi")
        ranked = d.groupBy(*by, BUCKET, value).agg(F.count(F.lit(1)).alias("_c"))
        ranked = join_small(ranked, wanted, (*by, BUCKET), "inner", broadcast=False)
        part = (*by, BUCKET)

    upto = Window.partitionBy(*part).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.withColumn("_upto", F.col("_before") + F.sum("_c").over(upto))
    chosen = [
        F.max(F.when((r >= F.col("_upto") - F.col("_c")) & (r < F.col("_upto")), F.col(value))).alias(k)
        for k, r in rank.items()
    ]
    return ranked.groupBy(*by).agg(F.max("n").alias("n"), *chosen)
