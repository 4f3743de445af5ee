"""Column statistics: profiles, summaries, order statistics, correlation, histograms, segments, bounds."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions import fx
from strandline.functions.times import epoch_seconds, format_epoch
from strandline.operators.rows import number_of
from strandline.plans.blocks import longest_runs, over_blocks
from strandline.plans.layout import ROW
from strandline.plans.ordering import Ordered, facts, join_sized
from strandline.plans.ranks import lower_median_rank, nearest_rank, pick_ranks, truncated_rank, upper_median_rank
from strandline.plans.selection import select
from strandline.plans.staging import settled, stage_rows

PAD = 0.05
DIRECT_COLUMNS = 6


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def to_long(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per (row, channel): (keep.., position, value), the channel as its position in `cols`.

    value is NULL when not finite.
    """
    cells = F.array(*[number_of(df, c).cast("double") for c in cols])
    return df.select(*keep, F.posexplode(cells).alias("position", "value"))


def named(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Put the channel name back next to its position."""
    return df.withColumn("column", F.get(F.array(*[F.lit(c) for c in cols]), F.col("position")))


def _stack(df: DataFrame, per_col: dict[str, Column], keep: Sequence[str] = ()) -> DataFrame:
    """One aggregate row with a struct per column, turned into one row per column."""
    row = df.groupBy(*keep).agg(*[s.alias(f"_s{i}") for i, s in enumerate(per_col.values())])
    items = [
        F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"), F.col(f"_s{i}").alias("s"))
        for i, c in enumerate(per_col)
    ]
    return row.select(*keep, F.explode(F.array(*items)).alias("e")).select(*keep, "e.column", "e.position", "e.s.*")


def _moments(v: Column) -> list[Column]:
    return [
        F.count(v).alias("count"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        (F.max(v) - F.min(v)).alias("peak_to_peak"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std_dev"),
    ]


def medians(df: DataFrame, cols: Sequence[str], n: int | None = None, **kw) -> DataFrame:
    """Exact median per column, averaging the middle two: (column, n, median).  All columns share their scans."""
    got = select(df, [number_of(df, c) for c in cols], {"lo": lower_median_rank, "hi": upper_median_rank})
    rows = [(cols[c], v["n"], (v["lo"] + v["hi"]) / 2.0) for (_, c), v in got.items()]
    return df.sparkSession.createDataFrame(rows, "column string, n bigint, median double")


def summary_stats(df: DataFrame, cols: Sequence[str], n: int | None = None, **kw) -> DataFrame:
    """count, min, max, peak_to_peak, mean, median, std_dev (population) of the finite values per column."""
    base = _stack(df, {c: F.struct(*_moments(number_of(df, c))) for c in cols})
    return base.join(medians(df, cols, n, **kw).drop("n"), "column", "left").filter("count > 0").drop("position")


def distinct_counts(df: DataFrame, cols: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct raw cells per column, a missing cell being one value: (column, distinct)."""
    if approximate:
        per = {
            c: F.struct(
                (F.approx_count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias("distinct")
            )
            for c in cols
        }
        return _stack(df, per).drop("position")
    seen = None
    for kind in dict.fromkeys(df.schema[c].dataType.simpleString() for c in cols):
        alike = [c for c in cols if df.schema[c].dataType.simpleString() == kind]
        at = {c: cols.index(c) for c in alike}
        cells = F.array(*[F.struct(F.lit(at[c]).alias("position"), F.col(c).alias("raw")) for c in alike])
        part = df.select(F.explode(cells).alias("c")).select("c.position", "c.raw").distinct()
        part = part.groupBy("position").agg(F.count(F.lit(1)).alias("distinct"))
        seen = part if seen is None else seen.unionByName(part)
    return named(seen, cols).select("column", "distinct")


def describe(o: Ordered, cols: Sequence[str]) -> DataFrame:
    """One profile row per column: totals, missing, share of zeros, distinct, longest run, summary.

    The indexed columns are written once: every part then scans them instead of sorting the table again.
    """
    o = stage_rows(o, *cols)
    df = o.df

    def facts_of(c: str) -> Column:
        v = number_of(df, c) if is_numeric(df, c) or isinstance(df.schema[c].dataType, T.StringType) else F.lit(
            None
        ).cast("double")
        zero = F.count(F.when(v == 0, 1))
        share = F.coalesce(F.try_divide(zero * F.lit(100.0), F.count(v)), F.lit(0.0))
        return F.struct(
            F.lit("numeric" if is_numeric(df, c) else "text").alias("kind"),
            F.count(F.lit(1)).alias("n_total"),
            (F.count(F.lit(1)) - F.count(v)).alias("n_missing"),
            F.round(share, 1).alias("pct_zero"),
            *_moments(v),
        )

    base = _stack(df, {c: facts_of(c) for c in cols})
    numbers = [c for c in cols if is_numeric(df, c) or isinstance(df.schema[c].dataType, T.StringType)]
    out = base.join(distinct_counts(df, cols), "column", "left").join(longest_runs(o, cols), "column", "left")
    if numbers:
        mid = medians(df, numbers, o.n, layout=o.layout).drop("n")
        out = out.join(mid, "column", "left")
    return out.drop("count")


def median_mad(df: DataFrame, value: str, by: Sequence[str] = (), n: int | None = None, **kw) -> DataFrame:
    """Upper median and upper-median absolute deviation per group: (by.., n, median, mad).

    The medians are settled before the deviations are ranked, so the second pass does not redo the first.
    """
    by = tuple(by)
    d = df.select(*by, value).filter(F.col(value).isNotNull())
    med = settled(pick_ranks(d, value, {"median": upper_median_rank}, by, n, **kw))
    joined = join_sized(d, med.drop("n"), by, "inner")
    dev = joined.select(*by, F.abs(F.col(value) - F.col("median")).alias("_dev"))
    mad = pick_ranks(dev, "_dev", {"mad": upper_median_rank}, by, n, **kw).drop("n")
    if not by:
        return med.join(F.broadcast(mad))
    return join_sized(med, mad, by, "inner")


def percentiles(
    df: DataFrame, value: str, fractions: dict[str, float], by: Sequence[str] = (), n: int | None = None, **kw
) -> DataFrame:
    """Nearest-rank percentiles, no interpolation."""
    picks = {k: nearest_rank(min(max(f, 0.0), 1.0)) for k, f in fractions.items()}
    return pick_ranks(df, value, picks, by, n, **kw)


def colour_range(df: DataFrame, magnitude: str, by: Sequence[str] = (), n: int | None = None, **kw) -> DataFrame:
    """5 % and 99.5 % points of log10 magnitude."""
    logs = df.select(*by, F.log10(F.col(magnitude) + 1e-12).alias("_log"))
    picks = {"low": truncated_rank(0.05, False), "high": truncated_rank(0.995, True)}
    return pick_ranks(logs, "_log", picks, by, n, **kw)


def robust_y_range(df: DataFrame, y: str, log: bool = False, at_least: int = 0, **kw) -> DataFrame:
    """1st-99th percentile view range with a 5 % pad; falls back to min-max, then to 0..1.

    `at_least`: with fewer values than this the plain min-max is used.
    """
    v = number_of(df, y)
    if log:
        v = F.when(v > 0, F.log10(v))
    d = df.select(v.alias("v"))
    q = percentiles(d, "v", {"q1": 0.01, "q99": 0.99}, **kw)
    ends = facts(d.agg(F.min("v").alias("lo"), F.max("v").alias("hi")))
    q = q.withColumn("_e", ends)
    lo, hi = F.col("_e.lo"), F.col("_e.hi")
    use_q = (F.col("n") >= at_least) & (F.col("q99") > F.col("q1"))
    low = F.when(use_q, F.col("q1")).when(hi > lo, lo).otherwise(0.0)
    high = F.when(use_q, F.col("q99")).when(hi > lo, hi).otherwise(1.0)
    q = q.select(low.alias("lo"), high.alias("hi"))
    pad = F.greatest((F.col("hi") - F.col("lo")) * PAD, F.lit(1e-9))
    return q.select((F.col("lo") - pad).alias("y_min"), (F.col("hi") + pad).alias("y_max"))


def data_bounds(df: DataFrame, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Min and max of the finite values; centre -1 / +1 when flat or empty."""
    v = number_of(df, y)
    ends = df.groupBy(*by).agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    flat = F.col("lo").isNull() | (F.abs(F.col("hi") - F.col("lo")) < 1e-15)
    centre = F.coalesce("lo", F.lit(0.0))
    return ends.select(
        *by,
        F.when(flat, centre - 1).otherwise(F.col("lo")).alias("y_min"),
        F.when(flat, centre + 1).otherwise(F.col("hi")).alias("y_max"),
    )


def _padded(lo: str, hi: str, share: float = PAD, flat: float = 0.5) -> tuple[Column, Column]:
    pad = (F.col(hi) - F.col(lo)) * share
    pad = F.when(F.abs(pad) < 1e-15, flat).otherwise(pad)
    return F.col(lo) - pad, F.col(hi) + pad


def fit_bounds(df: DataFrame, x: str, y: str, x_pad: float = PAD) -> DataFrame:
    """Padded view over all finite x and y of the given (visible) series."""
    vx, vy = number_of(df, x), number_of(df, y)
    b = df.agg(F.min(vx).alias("x0"), F.max(vx).alias("x1"), F.min(vy).alias("y0"), F.max(vy).alias("y1"))
    (x_min, x_max), (y_min, y_max) = _padded("x0", "x1", x_pad), _padded("y0", "y1")
    return b.filter("x0 is not null and y0 is not null").select(
        x_min.alias("x_min"), x_max.alias("x_max"), y_min.alias("y_min"), y_max.alias("y_max")
    )


def y_range_in(df: DataFrame, x: str, y: str, low: float, high: float, unit: str | None = None) -> DataFrame:
    """Padded y range of the points with x in [low, high], over all series or per unit.

    Over all series a flat range is padded by 0.5; per unit the pad is just the share.
    """
    vx, vy = number_of(df, x), number_of(df, y)
    keys = [unit] if unit else []
    d = df.filter((vx >= low) & (vx <= high))
    ends = d.groupBy(*keys).agg(F.min(vy).alias("lo"), F.max(vy).alias("hi")).filter("lo is not null")
    if unit:
        pad = (F.col("hi") - F.col("lo")) * PAD
        y_min, y_max = F.col("lo") - pad, F.col("hi") + pad
    else:
        y_min, y_max = _padded("lo", "hi")
    return ends.select(*keys, y_min.alias("y_min"), y_max.alias("y_max"))


def x_extent(df: DataFrame, x: str) -> DataFrame:
    v = number_of(df, x)
    return df.agg(F.min(v).alias("x_min"), F.max(v).alias("x_max")).filter("x_min is not null")


def safe_pearson(a: Column, b: Column, window=None) -> Column:
    """Pairwise-complete Pearson r; NULL under two pairs or without spread."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)

    def at(c: Column) -> Column:
        return c if window is None else c.over(window)

    spread = at(F.stddev_pop(x)) * at(F.stddev_pop(y))
    return F.when(at(F.count(x)) >= 2, at(F.covar_pop(x, y)) / F.nullif(spread, F.lit(0.0)))


def _pair_moments(parts: Iterator[pd.DataFrame], c: int) -> Iterator[pd.DataFrame]:
    """Pairwise-complete counts, centred means and products of c columns, one row a pair and task."""
    n = mean_x = mean_y = xx = yy = xy = None
    for pdf in parts:
        v = pdf.to_numpy(dtype=np.float64)
        seen = ~np.isnan(v)
        here, v = seen.astype(np.float64), np.where(seen, v, 0.0)
        k = here.T @ here
        some = np.maximum(k, 1)
        sx = v.T @ here
        ax, ay = sx / some, sx.T / some
        # about a shift common to a column, so that large values keep their digits
        shift = v.sum(0) / np.maximum(here.sum(0), 1)
        w = np.where(seen, v - shift, 0.0)
        s, q = w.T @ here, (w * w).T @ here
        bxx, bxy = q - s * s / some, w.T @ w - s * s.T / some
        byy = bxx.T
        if n is None:
            n, mean_x, mean_y, xx, yy, xy = k, ax, ay, bxx, byy, bxy
            continue
        total = np.maximum(n + k, 1)
        dx, dy, part = ax - mean_x, ay - mean_y, n * k / total
        xx, yy, xy = xx + bxx + dx * dx * part, yy + byy + dy * dy * part, xy + bxy + dx * dy * part
        mean_x, mean_y, n = mean_x + dx * k / total, mean_y + dy * k / total, n + k
    if n is not None:
        i, j = np.triu_indices(c, 1)
        yield pd.DataFrame({"i": i, "j": j, "n": n[i, j], "x": mean_x[i, j], "y": mean_y[i, j], "xx": xx[i, j], "yy": yy[i, j], "xy": xy[i, j]})


def _wide_correlations(df: DataFrame, cols: Sequence[str], v: dict[str, Column]) -> DataFrame:
    """Matrix products by task, merged per pair: one row a task and pair is shuffled, whatever the number of rows."""
    c = len(cols)
    plain = df.select(*[v[name].cast("double").alias(f"c{i}") for i, name in enumerate(cols)])
    parts = plain.mapInPandas(lambda it: _pair_moments(it, c), "i int, j int, n double, x double, y double, xx double, yy double, xy double")
    mean = parts.groupBy("i", "j").agg(F.sum("n").alias("n"), *[(F.sum(F.col(m) * F.col("n")) / F.nullif(F.sum("n"), F.lit(0.0))).alias(f"m{m}") for m in "xy"])
    far = parts.join(mean.select("i", "j", "mx", "my"), ["i", "j"])
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    sums = far.groupBy("i", "j").agg(
        F.sum("n").alias("n"), F.sum(F.col("xx") + F.col("n") * dx * dx).alias("xx"),
        F.sum(F.col("yy") + F.col("n") * dy * dy).alias("yy"), F.sum(F.col("xy") + F.col("n") * dx * dy).alias("xy"),
    )
    r = F.when(F.col("n") >= 2, F.col("xy") / F.nullif(F.sqrt(F.col("xx")) * F.sqrt(F.col("yy")), F.lit(0.0)))
    names = F.array(*[F.lit(name) for name in cols])
    return sums.select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), "i", "j", r.alias("r"))


def correlations(df: DataFrame, cols: Sequence[str], direct: int = DIRECT_COLUMNS) -> DataFrame:
    """Unrounded r for every unordered column pair in one pass: (a, b, i, j, r).

    Up to `direct` columns are plain aggregates; more go through matrix products in the tasks.
    """
    if len(cols) < 2:
        raise ValueError("correlation needs at least 2 numeric columns")
    if len(cols) > direct:
        return _wide_correlations(df, cols, {c: number_of(df, c) for c in cols})
    v = {c: number_of(df, c) for c in cols}
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    row = df.agg(*[safe_pearson(v[cols[i]], v[cols[j]]).alias(f"r{i}_{j}") for i, j in pairs])
    items = [
        F.struct(
            F.lit(cols[i]).alias("a"), F.lit(cols[j]).alias("b"), F.lit(i).alias("i"), F.lit(j).alias("j"),
            F.col(f"r{i}_{j}").alias("r"),
        )
        for i, j in pairs
    ]
    return row.select(F.explode(F.array(*items)).alias("p")).select("p.*")


def ranked_pairs(df: DataFrame, cols: Sequence[str], limit: int | None = None) -> DataFrame:
    """Pairs by |r|, strongest first, all or the first `limit`, r to 3 places."""
    r = correlations(df, cols).filter("r is not null").orderBy(F.abs("r").desc(), "i", "j")
    return (r if limit is None else r.limit(limit)).select("a", "b", F.round("r", 3).alias("r"))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """All ordered pairs incl. the unit diagonal, r to 3 places."""
    r = correlations(df, cols).select("a", "b", F.round("r", 3).alias("r"))
    both = F.array(F.struct("a", "b", "r"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "r"))
    off = r.select(F.explode(both).alias("p")).select("p.*")
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "a string")
    return off.unionByName(names.select("a", F.col("a").alias("b"), F.lit(1.0).alias("r")))


def histogram(df: DataFrame, value: str, bins: int = 40, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width counts incl. empty bins: (by.., bin, bin_center, count, n); nothing under 2 values."""
    bins = min(max(bins, 2), 200)
    v = number_of(df, value)
    d = df.select(*by, v.alias("_v")).filter("_v is not null")
    ends = d.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("_v").alias("n"))
    span = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-12))
    ends = ends.filter("n >= 2").withColumn("_span", span)
    if by:
        d = join_sized(d, ends, by, "inner")
        lo, span = F.col("_lo"), F.col("_span")
    else:
        d = d.withColumn("_e", facts(ends))
        lo, span = F.col("_e._lo"), F.col("_e._span")
    at = F.least(F.floor((F.col("_v") - lo) / span * bins), F.lit(bins - 1)).cast("int")
    counts = d.groupBy(*by, at.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = ends.select(
        *by, "n", "_lo", "_span", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    )
    return grid.join(counts, [*by, "bin"], "left").select(
        *by,
        "bin",
        (F.col("_lo") + F.col("_span") * (F.col("bin") + 0.5) / bins).alias("bin_center"),
        F.coalesce("count", F.lit(0)).alias("count"),
        "n",
    )


def modal_bin(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Fullest bin (the last of equals) and its centre to 3 places."""
    top = hist.groupBy(*by).agg(F.max(F.struct("count", "bin", "bin_center")).alias("m"))
    return top.select(*by, "m.bin", F.round("m.bin_center", 3).alias("bin_center"), "m.count")


def segment_of(k: int, n: Column | int) -> Column:
    """Equal row windows: segment s covers rows [s*n div k, (s+1)*n div k)."""
    n = F.lit(n).cast("bigint") if isinstance(n, int) else n
    return F.floor(((F.col(ROW) + 1) * k - 1) / n).cast("int")


def segment_stats(o: Ordered, cols: Sequence[str], segments: int = 10) -> DataFrame:
    """mean / std / min / max per column and equal row window (4 places), incl. windows without values."""
    k = min(max(segments, 2), 500)
    d = o.select(*cols).df.withColumn("segment", segment_of(k, o.n))
    stats = {
        c: F.struct(
            F.count(number_of(d, c)).alias("n_finite"),
            F.round(F.avg(number_of(d, c)), 4).alias("mean"),
            F.round(F.stddev_pop(number_of(d, c)), 4).alias("std"),
            F.round(F.min(number_of(d, c)), 4).alias("min"),
            F.round(F.max(number_of(d, c)), 4).alias("max"),
        )
        for c in cols
    }
    got = _stack(d, stats, ("segment",))
    names = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("position")) for i, c in enumerate(cols)])
    grid = df_range(o, k).select(F.col("id").cast("int").alias("segment"), F.explode(names).alias("c"))
    grid = grid.select("segment", "c.column", "c.position")
    lo = F.floor(F.col("segment").cast("bigint") * o.n / k).cast("bigint")
    hi = F.floor((F.col("segment").cast("bigint") + 1) * o.n / k).cast("bigint")
    out = grid.join(got.drop("position"), ["segment", "column"], "left")
    return out.select(
        "column", "segment", lo.alias("row_start"), hi.alias("row_end"), "mean", "std", "min", "max",
        F.when(F.coalesce("n_finite", F.lit(0)) == 0, "no finite values").alias("note"),
    )


def df_range(o: Ordered, k: int) -> DataFrame:
    return o.df.sparkSession.range(k)


def sample_rate(o: Ordered, ts: str) -> DataFrame:
    """1 / upper-median positive step of the time column, or 1.0: (sample_rate)."""
    t = o.df.select(*o.by, ROW, epoch_seconds(o.df, ts).alias("_t"))
    steps = over_blocks(o.with_df(t), 1, 0, lambda w: {"_dt": F.col("_t") - F.lag("_t").over(w)})
    steps = steps.select(*o.by, fx.finite(F.col("_dt")).alias("_dt")).filter("_dt > 0")
    med = pick_ranks(steps, "_dt", {"_md": upper_median_rank}, o.by, o.n, o.layout)
    rate = F.coalesce(F.lit(1.0) / F.col("_md"), F.lit(1.0))
    if o.by:
        return med.select(*o.by, rate.alias("sample_rate"))
    return med.agg(F.max("_md").alias("_md")).select(rate.alias("sample_rate"))


def dataset_summary(df: DataFrame, time_col: str | None = None) -> DataFrame:
    """Rows, columns, numeric columns and the formatted time range."""
    numeric = sum(isinstance(f.dataType, (T.NumericType, T.TimestampType, T.TimestampNTZType)) for f in df.schema)
    t = epoch_seconds(df, time_col) if time_col else F.lit(None).cast("double")
    out = df.agg(F.count(F.lit(1)).alias("n_rows"), F.min(t).alias("_a"), F.max(t).alias("_b"))
    return out.select(
        "n_rows",
        F.lit(len(df.columns)).alias("n_columns"),
        F.lit(numeric).alias("n_numeric_columns"),
        format_epoch(F.col("_a")).alias("time_start"),
        format_epoch(F.col("_b")).alias("time_end"),
    )
