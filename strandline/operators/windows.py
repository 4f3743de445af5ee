"""Order-dependent transforms: rolling statistics, differences, sums, normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import fx
from strandline.operators.stats import safe_pearson
from strandline.plans.blocks import block_window, over_blocks, running_total, with_halo, home_block
from strandline.plans.layout import BLOCK, ROW
from strandline.plans.ordering import Ordered, facts, join_sized

# Direct frames cost `window` steps per row; beyond this the two-part form costs a fixed number.
DIRECT_WINDOW = 64


def _check(window: int) -> None:
    if window < 2:
        raise ValueError("a rolling window needs at least 2 rows")


def _direct(stat: str, a: Column, b: Column | None, frame) -> Column:
    if stat == "mean":
        return F.avg(a).over(frame)
    if stat == "std":
        return F.stddev_pop(a).over(frame)
    if stat == "min":
        return F.min(a).over(frame)
    if stat == "max":
        return F.max(a).over(frame)
    return safe_pearson(a, b, frame)


def rolling(o: Ordered, stat: str, col: str, window: int, name: str, other: str | None = None) -> DataFrame:
    """Trailing mean / std / min / max, or corr of two columns, over the last `window` rows.

    Missing values are left out of a window; NULL when none is left (corr: under two pairs or no spread).
    """
    _check(window)
    if stat not in ("mean", "std", "min", "max", "corr"):
        raise ValueError(f"unknown rolling statistic {stat}")
    a = fx.finite(F.col(col).cast("double"))
    b = fx.finite(F.col(other).cast("double")) if other else None
    if window <= DIRECT_WINDOW:
        return over_blocks(
            o,
            window - 1,
            0,
            lambda w: {name: _direct(stat, a, b, w.rowsBetween(-(window - 1), 0))},
        )
    return _rolling_wide(o, stat, a, b, window, name)


def _rolling_wide(o: Ordered, stat: str, a: Column, b: Column | None, window: int, name: str) -> DataFrame:
    """Same result at a fixed cost per row for any window.

    Rows are cut into slabs of `window` rows, so a trailing window is the tail of one slab plus the head
    of the next.  Both parts are running aggregates and are merged without subtraction.
    """
    size = max(o.block, window)
    d = with_halo(o, window - 1, 0, size)
    if stat == "corr":
        both = a.isNotNull() & b.isNotNull()
        a, b = F.when(both, a), F.when(both, b)
    d = d.withColumn("_a", a).withColumn("_b", b if b is not None else F.lit(None).cast("double"))
    d = d.withColumn("_slab", F.floor(F.col(ROW) / window))
    head = Window.partitionBy(*o.by, BLOCK, "_slab").orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0)
    tail = Window.partitionBy(*o.by, BLOCK, "_slab").orderBy(F.col(ROW).desc()).rowsBetween(Window.unboundedPreceding, 0)

    def part(w) -> Column:
        x, y = F.col("_a"), F.col("_b")
        fields = {"n": F.count(x).over(w).cast("double")}
        if stat in ("min", "max"):
            fields["v"] = (F.min if stat == "min" else F.max)(x).over(w)
        else:
            fields["mx"] = F.avg(x).over(w)
            fields["sxx"] = F.var_pop(x).over(w) * fields["n"]
        if stat == "corr":
            fields["my"] = F.avg(y).over(w)
            fields["syy"] = F.var_pop(y).over(w) * fields["n"]
            fields["sxy"] = F.covar_pop(x, y).over(w) * fields["n"]
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    d = d.withColumn("_tail", part(tail)).withColumn("_head", part(head))
    along = block_window(o)
    d = d.withColumn("_t", F.lag("_tail", window - 1).over(along))
    h, t = F.col("_head"), F.col("_t")
    one_part = (F.col(ROW) % window == window - 1) | t.isNull()
    n = h["n"] + t["n"]

    def mean(k: str) -> Column:
        return F.when(h["n"] == 0, t[k]).when(t["n"] == 0, h[k]).otherwise(h[k] + (t[k] - h[k]) * t["n"] / n)

    def spread(k: str, p: str, q: str) -> Column:
        cross = (t[p] - h[p]) * (t[q] - h[q]) * h["n"] * t["n"] / n
        return F.when(h["n"] == 0, t[k]).when(t["n"] == 0, h[k]).otherwise(h[k] + t[k] + cross)

    if stat == "min":
        out = F.when(one_part, h["v"]).otherwise(F.least(h["v"], t["v"]))
    elif stat == "max":
        out = F.when(one_part, h["v"]).otherwise(F.greatest(h["v"], t["v"]))
    elif stat == "mean":
        out = F.when(one_part, h["mx"]).otherwise(mean("mx"))
    elif stat == "std":
        var = F.when(one_part, F.try_divide(h["sxx"], h["n"])).otherwise(F.try_divide(spread("sxx", "mx", "mx"), n))
        out = F.sqrt(F.when(var < 0, 0.0).otherwise(var))
    else:
        sxx = F.when(one_part, h["sxx"]).otherwise(spread("sxx", "mx", "mx"))
        syy = F.when(one_part, h["syy"]).otherwise(spread("syy", "my", "my"))
        sxy = F.when(one_part, h["sxy"]).otherwise(spread("sxy", "mx", "my"))
        pairs = F.when(one_part, h["n"]).otherwise(n)
        out = F.when(pairs >= 2, F.try_divide(sxy, F.sqrt(sxx * syy)))
    kept = [c for c in o.df.columns if c != name]
    return d.select(*kept, BLOCK, out.alias(name)).filter(F.col(BLOCK) == home_block(size)).drop(BLOCK)


def moving_average(o: Ordered, y: str, window: int, name: str) -> DataFrame:
    """Centred mean over `window // 2` rows each side, clamped at the ends; any missing value spoils it."""
    half = max(window, 1) // 2
    v = fx.as_nan(F.col(y))
    if half > DIRECT_WINDOW // 2:
        return _moving_average_wide(o, v, half, name)
    return over_blocks(
        o, half, half, lambda w: {name: fx.stored(F.avg(v).over(w.rowsBetween(-half, half)))}
    )


def _moving_average_wide(o: Ordered, v: Column, half: int, name: str) -> DataFrame:
    """Same result at a fixed cost per row for any width.

    Rows are cut into slabs of one full window, so a window is the end of one slab and the start of the next: a
    running sum from behind, `half` rows back, and one from the front, `half` rows ahead.  Nothing is subtracted, so a
    missing value spoils just the windows that hold it.
    """
    width = 2 * half + 1
    size = max(o.block, width)
    d = with_halo(o, half, half, size).withColumn("_v", v).withColumn("_slab", F.floor(F.col(ROW) / width))
    keys = [*o.by, BLOCK]
    d = d.repartition(*keys)  # one shuffle for the slabs and the blocks they lie in
    slab = Window.partitionBy(*keys, "_slab")
    upto = slab.orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0)
    onward = slab.orderBy(F.col(ROW).desc()).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_front", F.sum("_v").over(upto)).withColumn("_back", F.sum("_v").over(onward))
    block = Window.partitionBy(*keys).orderBy(ROW)
    end = block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.greatest(F.col(ROW) - half, F.lit(0))
    last = F.least(F.col(ROW) + half, F.max(ROW).over(end))
    front = F.coalesce(F.lead("_front", half).over(block), F.last("_front").over(end))
    d = d.withColumns({"_a": first, "_b": last, "_front": front, "_back": F.lag("_back", half).over(block)})
    a, b = F.floor(F.col("_a") / width), F.floor(F.col("_b") / width)
    # within one slab the window starts with it, or ends with the last row of the series
    total = F.when((a == b) & (F.col("_a") == a * width), F.col("_front")).when(a == b, F.col("_back")).otherwise(F.col("_back") + F.col("_front"))
    kept = [c for c in o.df.columns if c != name]
    out = d.select(*kept, BLOCK, fx.stored(total / (F.col("_b") - F.col("_a") + 1)).alias(name))
    return out.filter(F.col(BLOCK) == home_block(size)).drop(BLOCK)


def row_delta(o: Ordered, x: str, name: str) -> DataFrame:
    """x minus the previous row's x."""
    c = F.col(x).cast("double")
    return over_blocks(o, 1, 0, lambda w: {name: c - F.lag(c).over(w)})


def derivative(o: Ordered, x: str, y: str, name: str) -> DataFrame:
    """Central difference, one-sided at the ends; 0 for a single row."""
    xs, ys = fx.as_nan(F.col(x)), fx.as_nan(F.col(y))

    def build(w):
        x0, x1 = F.coalesce(F.lag(xs).over(w), xs), F.coalesce(F.lead(xs).over(w), xs)
        y0, y1 = F.coalesce(F.lag(ys).over(w), ys), F.coalesce(F.lead(ys).over(w), ys)
        alone = F.lag(ROW).over(w).isNull() & F.lead(ROW).over(w).isNull()
        return {name: F.when(alone, 0.0).otherwise(fx.stored(fx.div(y1 - y0, x1 - x0)))}

    return over_blocks(o, 1, 1, build)


def integral(o: Ordered, x: str, y: str, name: str) -> DataFrame:
    """Cumulative trapezoid from 0; missing from the first missing input on."""
    xs, ys = fx.as_nan(F.col(x)), fx.as_nan(F.col(y))

    def build(w):
        step = (xs - F.lag(xs).over(w)) * (ys + F.lag(ys).over(w)) / 2.0
        return {"_step": F.coalesce(step, F.lit(0.0))}

    stepped = over_blocks(o, 1, 0, build, keep_block=True)
    total = running_total(o.with_df(stepped), F.col("_step"), name, blocked=True)
    return total.withColumn(name, fx.stored(F.col(name))).drop("_step")


def _normal(v: Column, s, kind: str) -> Column:
    if kind == "zscore":
        scaled, flat, spread = (v - s["_mean"]) / F.nullif(s["_std"], F.lit(0.0)), 0.0, s["_std"]
    else:
        span = s["_max"] - s["_min"]
        scaled, flat, spread = (v - s["_min"]) / F.nullif(span, F.lit(0.0)), 0.5, span
    return F.when(spread == 0, F.lit(flat)).when(spread.isNull(), v).otherwise(scaled)


def normalize(o_or_df, y: str, name: str, kind: str = "minmax", by: tuple[str, ...] = ()) -> DataFrame:
    """Scale to 0..1 by the (series') range, or to zero mean and unit deviation; flat data to 0.5 / 0."""
    df = o_or_df.df if isinstance(o_or_df, Ordered) else o_or_df
    by = o_or_df.by if isinstance(o_or_df, Ordered) else tuple(by)
    v = fx.finite(F.col(y).cast("double"))
    aggs = (
        [F.avg(v).alias("_mean"), F.stddev_pop(v).alias("_std")]
        if kind == "zscore"
        else [F.min(v).alias("_min"), F.max(v).alias("_max")]
    )
    stats = df.groupBy(*by).agg(*aggs)
    if by:
        d = join_sized(df, stats, by)
        return d.withColumn(name, fx.stored(_normal(v, {c: F.col(c) for c in d.columns}, kind))).drop(
            *[c for c in stats.columns if c not in by]
        )
    d = df.withColumn("_s", facts(stats))
    return d.withColumn(name, fx.stored(_normal(v, F.col("_s"), kind))).drop("_s")
