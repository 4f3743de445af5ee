"""Row blocks: neighbouring rows that one task handles, with copied edges where a window looks across.

`row_idx div block` names the home block.  A window that looks back b rows and ahead a rows gets the
last b rows of the block before and the first a rows of the block after copied in, so every home row
sees its full frame and no task ever holds more than a block plus its edges.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.plans.layout import BLOCK, ROW
from strandline.plans.ordering import Ordered, join_small


def home_block(size: int) -> Column:
    return F.floor(F.col(ROW) / size).cast("bigint") if size & (size - 1) else F.shiftright(
        F.col(ROW), size.bit_length() - 1
    )


def with_halo(o: Ordered, back: int = 0, ahead: int = 0, size: int | None = None) -> DataFrame:
    """Assign rows to blocks, copying edge rows to the neighbours that need them."""
    size = max(size or o.block, back, ahead, 1)
    home = home_block(size)
    if not back and not ahead:
        return o.df.withColumn(BLOCK, home)
    pos = F.col(ROW) - home * size
    targets = [home]
    if back:
        targets.append(F.when(pos >= size - back, home + 1))
    if ahead:
        targets.append(F.when((pos < ahead) & (home > 0), home - 1))
    return o.df.withColumn(BLOCK, F.explode(F.array_compact(F.array(*targets))))


def block_window(o: Ordered, *extra: str):
    return Window.partitionBy(*o.by, *extra, BLOCK).orderBy(ROW)


def over_blocks(
    o: Ordered,
    back: int,
    ahead: int,
    build: Callable[[Window], dict[str, Column]],
    keep_block: bool = False,
) -> DataFrame:
    """Evaluate row-frame window expressions that look at most `back` / `ahead` rows away."""
    size = max(o.block, back, ahead, 1)
    d = with_halo(o, back, ahead, size)
    made = build(block_window(o))
    kept = [c for c in d.columns if c not in made]
    d = d.select(*kept, *[c.alias(k) for k, c in made.items()])
    if back or ahead:
        d = d.filter(F.col(BLOCK) == home_block(size))
    return d if keep_block else d.drop(BLOCK)


def running_total(o: Ordered, value: Column, name: str, blocked: bool = False) -> DataFrame:
    """Running sum in row order: sums inside blocks plus the broadcast total of the blocks before.

    Only blocks after a series' first need an offset, so the broadcast side has at most
    n / block <= max_blocks rows whatever the number of series.  Set `blocked` when `o.df` already
    carries the home block, which saves the shuffle.
    """
    d = o.df if blocked else o.df.withColumn(BLOCK, home_block(o.block))
    d = d.withColumn("_v", value)
    totals = d.groupBy(*o.by, BLOCK).agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*o.by).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_off", F.sum("_t").over(before)).drop("_t").filter(F.col(BLOCK) > 0)
    inside = F.sum("_v").over(block_window(o).rowsBetween(Window.unboundedPreceding, 0))
    d = join_small(d.withColumn("_in", inside), offsets, (*o.by, BLOCK))
    return d.withColumn(name, F.col("_in") + F.coalesce("_off", F.lit(0.0))).drop(
        "_v", "_in", "_off", BLOCK
    )


def last_marked(o: Ordered, marked: Column, name: str) -> DataFrame:
    """For each row the latest non-null `marked` struct at or before it (its first field is row_idx)."""
    d = o.df.withColumn(BLOCK, home_block(o.block)).withColumn("_m", marked)
    tails = d.groupBy(*o.by, BLOCK).agg(F.max("_m").alias("_t"))
    before = Window.partitionBy(*o.by).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.withColumn("_carry", F.max("_t").over(before)).drop("_t").filter(F.col(BLOCK) > 0)
    inside = F.max("_m").over(block_window(o).rowsBetween(Window.unboundedPreceding, 0))
    d = join_small(d.withColumn("_in", inside), carry, (*o.by, BLOCK))
    return d.withColumn(name, F.coalesce("_in", "_carry")).drop("_m", "_in", "_carry", BLOCK)


def longest_runs(o: Ordered, cols: Sequence[str]) -> DataFrame:
    """Longest run of equal neighbours (missing equals missing) per column: (by.., column, longest_run).

    Each block is reduced to one row of numbers per column: its best run, the rows before its first
    change and the rows since its last.  Runs that cross block edges are joined up on that small table.
    """
    w = Window.partitionBy(*o.by, BLOCK).orderBy(ROW)
    d = with_halo(o.select(*cols), back=1)
    changes = [
        F.when(F.lag(ROW).over(w).isNull() | ~F.lag(c).over(w).eqNullSafe(F.col(c)), F.col(ROW)).alias(f"_c{i}")
        for i, c in enumerate(cols)
    ]
    d = d.select(*o.by, ROW, BLOCK, *changes).filter(F.col(BLOCK) == home_block(o.block))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    first, last = F.min(ROW), F.max(ROW)
    begun = [F.max(f"_c{i}").over(upto).alias(f"_s{i}") for i in range(len(cols))]
    d = d.select("*", *begun)
    aggs = [first.alias("_lo"), last.alias("_hi")]
    for i in range(len(cols)):
        # rows of a run begun in an earlier block count from this block's start
        aggs.append(F.max(F.col(ROW) - F.col(f"_s{i}") + 1).alias(f"_best{i}"))
        aggs += [F.min(f"_c{i}").alias(f"_min{i}"), F.max(f"_c{i}").alias(f"_max{i}")]
    per_block = d.groupBy(*o.by, BLOCK).agg(*aggs)
    parts = []
    for i, c in enumerate(cols):
        head = F.coalesce(F.col(f"_min{i}"), F.col("_hi") + 1) - F.col("_lo")
        tail = F.col("_hi") + 1 - F.col(f"_max{i}")
        best = F.coalesce(F.col(f"_best{i}"), F.lit(0)).cast("bigint")

        def end(e: int, n: Column, c: str = c, best: Column = best) -> Column:
            return F.struct(F.lit(c).alias("column"), F.lit(e).alias("e"), n.alias("len"), best.alias("best"))

        parts += [end(0, head), F.when(F.col(f"_max{i}").isNotNull(), end(1, tail))]
    ends = per_block.select(*o.by, BLOCK, F.explode(F.array_compact(F.array(*parts))).alias("p"))
    ends = ends.select(*o.by, BLOCK, "p.*")
    seq = Window.partitionBy(*o.by, "column").orderBy(BLOCK, "e").rowsBetween(Window.unboundedPreceding, 0)
    chained = ends.withColumn("_chain", F.sum("e").over(seq))
    joined = chained.groupBy(*o.by, "column", "_chain").agg(
        F.sum("len").alias("joined"), F.max("best").alias("best")
    )
    return joined.groupBy(*o.by, "column").agg(
        F.greatest(F.max("joined"), F.max("best")).alias("longest_run")
    )


def group_runs(
    rows: DataFrame, by: Sequence[str], block: int, max_gap: int = 2
) -> DataFrame:
    """Join row indices at most `max_gap` + 1 apart into runs: (by.., start, end, count).

    Runs are formed inside blocks; only those close enough to a block edge to continue (at most two
    per block) meet in the second, small pass.
    """
    reach = max_gap + 1
    block = max(block, 2 * reach)
    d = rows.select(*by, ROW).withColumn(BLOCK, home_block(block))
    w = Window.partitionBy(*by, BLOCK).orderBy(ROW)
    fresh = F.coalesce(F.col(ROW) - F.lag(ROW).over(w) > reach, F.lit(True)).cast("int")
    runs = (
        d.withColumn("_f", fresh)
        .withColumn("_r", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*by, BLOCK, "_r")
        .agg(F.min(ROW).alias("start"), F.max(ROW).alias("end"), F.count(F.lit(1)).alias("count"))
    )
    at_edge = (F.col("start") - F.col(BLOCK) * block < reach) | (
        (F.col(BLOCK) + 1) * block - F.col("end") <= reach
    )
    inner = runs.filter(~at_edge).select(*by, "start", "end", "count")
    seq = Window.partitionBy(*by).orderBy("start")
    fresh = F.coalesce(F.col("start") - F.lag("end").over(seq) > reach, F.lit(True)).cast("int")
    edge = (
        runs.filter(at_edge)
        .withColumn("_f", fresh)
        .withColumn("_r", F.sum("_f").over(seq.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*by, "_r")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("count").alias("count"))
        .drop("_r")
    )
    return inner.unionByName(edge)
