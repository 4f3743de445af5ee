"""Fewer points for the same picture: min/max envelope, triangle downsampling, uniform resampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import fx
from strandline.operators.rows import view_window
from strandline.plans.blocks import home_block, over_blocks, with_halo
from strandline.plans.layout import BLOCK, ROW
from strandline.plans.ordering import BROADCAST_ROWS, Ordered, facts, join_sized, join_small, order_rows, with_series_size
from strandline.plans.staging import settled, stage

SPLINE_HALO = 64
SPLINE_CHUNK = 512
CHAIN_BUCKETS, CHAIN_ROWS, FAN = 64, 8192, 256


def finite_series(o: Ordered, x: str, y: str) -> Ordered:
    """Finite pairs only; numbered again only when some were dropped (a row count decides)."""
    d = o.df.select(
        *o.by, ROW, fx.finite(F.col(x).cast("double")).alias("x"), fx.finite(F.col(y).cast("double")).alias("y")
    )
    good = d.filter("x is not null and y is not null")
    n = good.count()
    if n == o.n:
        return o.with_df(d)
    s = order_rows(good.withColumnRenamed(ROW, "_old"), "_old", o.by, n, o.layout)
    return s.with_df(s.df.drop("_old"))


def minmax_envelope(o: Ordered, x: str, y: str, buckets: int) -> DataFrame:
    """First lowest and first highest row of each equal row bucket, in row order.

    A series of at most 2 * buckets rows is returned as it is; elsewhere missing y are passed over.  The
    extremes of the buckets come first, then the first rows that have them: plain numbers both times, so that rows
    are aggregated by hash and only a row for each bucket is shuffled.
    """
    d = with_series_size(o.select(x, y)).df
    if buckets == 0 or (not o.by and o.n <= 2 * buckets):
        return d.drop("_n")
    small = F.col("_n") <= 2 * buckets
    keys = [*o.by, "_b"]
    large = d.filter(~small).withColumn("_b", F.floor(((F.col(ROW) + 1) * buckets - 1) / F.col("_n"))).drop("_n")
    ends = settled(large.groupBy(*keys).agg(F.min(y).alias("_lo"), F.max(y).alias("_hi")))
    met = join_small(large, ends, keys, "inner", broadcast=(ends.count() if o.by else buckets) <= BROADCAST_ROWS)
    at_lo, at_hi = (F.when(F.col(y) == F.col(e), F.col(ROW)) for e in ("_lo", "_hi"))
    met = met.filter((F.col(y) == F.col("_lo")) | (F.col(y) == F.col("_hi"))).withColumns({"_rlo": at_lo, "_rhi": at_hi})
    first = met.groupBy(*keys).agg(*[f.alias(n) for e in ("lo", "hi") for f, n in ((F.min(f"_r{e}"), f"r{e}"), (F.min_by(x, f"_r{e}"), f"x{e}"), (F.min_by(y, f"_r{e}"), f"y{e}"))])
    picks = F.array(*[F.struct(F.col(f"r{e}").alias(ROW), F.col(f"x{e}").alias(x), F.col(f"y{e}").alias(y)) for e in ("lo", "hi")])
    picks = F.when(F.col("rlo") == F.col("rhi"), F.slice(picks, 1, 1)).otherwise(picks)
    out = first.select(*o.by, F.explode(picks).alias("p")).select(*o.by, "p.*")
    return out.unionByName(d.filter(small).select(*out.columns)) if o.by else out


# ---------------------------------------------------------------- triangle downsampling

ENTRY, CANDIDATE, MEAN, LAST = 0, 1, 2, 3


def _strict_chain(seg: np.ndarray, x: np.ndarray, y: np.ndarray, passes: int = 40) -> np.ndarray:
    """Positions of the vertices of each segment's upper hull; points come by (segment, x), one for each x.

    A point on or under the line of its present neighbours is no vertex, whichever points go with it, so whole
    arrays are thinned at once; flat and collinear stretches go in one pass.  What resists is finished point by point.
    """
    at = np.arange(len(x))
    for _ in range(passes):
        if len(at) < 3:
            return at
        a, b, c = at[:-2], at[1:-1], at[2:]
        under = (y[b] - y[a]) * (x[c] - x[a]) <= (y[c] - y[a]) * (x[b] - x[a])
        gone = under & (seg[a] == seg[b]) & (seg[b] == seg[c])
        if not gone.any():
            return at
        at = at[np.concatenate([[True], ~gone, [True]])]
    keep: list[int] = []
    for i in at.tolist():
        while len(keep) >= 2 and seg[keep[-2]] == seg[i]:
            a, b = keep[-2], keep[-1]
            if (y[b] - y[a]) * (x[i] - x[a]) > (y[i] - y[a]) * (x[b] - x[a]):
                break
            keep.pop()
        keep.append(i)
    return np.array(keep)


def _first_on_edges(seg: np.ndarray, x: np.ndarray, y: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each hull edge that holds other points, the one of the lowest row if it is lower than the edge's ends."""
    inner = np.ones(len(x), dtype=bool)
    inner[at] = False
    p = np.flatnonzero(inner)
    right = np.searchsorted(at, p)
    ok = (right > 0) & (right < len(at))
    p, right = p[ok], right[ok]
    a, c = at[right - 1], at[right]
    on = (seg[a] == seg[p]) & (seg[c] == seg[p]) & ((y[p] - y[a]) * (x[c] - x[a]) == (y[c] - y[a]) * (x[p] - x[a]))
    p, right = p[on], right[on]
    order = np.lexsort((row[p], right))
    p, right = p[order], right[order]
    p = p[np.diff(right, prepend=-1) != 0]
    edge = np.searchsorted(at, p)
    return p[(row[p] < row[at[edge - 1]]) & (row[p] < row[at[edge]])]


def hull_candidates(seg: np.ndarray, x: np.ndarray, y: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Positions that can hold the largest triangle of their segment, ties going to the lowest row.

    The area is the absolute value of a linear function of the point: it is largest at a hull vertex, or all
    along an edge, where the first row counts.  The points need no order; coincident ones give their first row.
    """
    order = np.lexsort((row, y, x, seg))
    s, u, v, r = seg[order], x[order], y[order], row[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (s[1:] != s[:-1]) | (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    order, s, u, v, r = order[new], s[new], u[new], v[new], r[new]
    if not len(order):
        return order
    edge = np.ones(len(order) + 1, dtype=bool)
    edge[1:-1] = (s[1:] != s[:-1]) | (u[1:] != u[:-1])
    low, high = np.flatnonzero(edge[:-1]), np.flatnonzero(edge[1:])  # of each x the lowest and the highest
    keep = []
    for side, sign in ((high, 1.0), (low, -1.0)):
        a, b, c, d = s[side], u[side], sign * v[side], r[side]
        at = _strict_chain(a, b, c)
        keep += [side[at], side[_first_on_edges(a, b, c, d, at)]]
    # a segment's leftmost and rightmost points form upright edges
    ends = np.ones(len(low), dtype=bool)
    ends[1:-1] = (s[low][1:-1] != s[low][:-2]) | (s[low][1:-1] != s[low][2:])
    size = high - low + 1
    tall = np.flatnonzero(ends & (size > 2))
    keep += [np.array([low[t] + int(np.argmin(r[low[t] : high[t] + 1])) for t in tall], dtype=np.int64)]
    return order[np.unique(np.concatenate(keep))]


def lttb(o: Ordered, x: str, y: str, target: int, variant: str = "reference") -> DataFrame:
    """Largest-triangle-three-buckets: (by.., pick, row_idx, x, y), `pick` numbering the output points.

    For a given previous pick the triangle area is the absolute value of a linear function of the
    candidate, so the winner lies on the candidates' convex hull.  One pass over the rows takes hulls and sums per
    row block and bucket; flat, collinear and unsorted stretches leave a few points like any others.  The
    pick-to-pick chain is cut into groups of buckets: each group maps every possible incoming pick to its
    last pick, the maps are composed in levels of bounded fan-in, and then each group is walked from the pick that
    really enters it.  No task sees all groups of a series, however many there are.  Only a bucket whose
    points all lie on a convex curve keeps them all.

    variant "reference" keeps buckets one place late, so the first bucket is never used and the last
    point appears twice; "standard" is the published algorithm.
    """
    s = with_series_size(o.select(F.col(x).alias("x"), F.col(y).alias("y")))
    d = s.df
    keys = list(o.by)
    asis = (F.col("_n") <= target) | F.lit(target < 3)
    untouched = d.filter(asis).select(*keys, F.col(ROW).cast("int").alias("pick"), ROW, "x", "y")
    if target < 3 or (not keys and o.n <= target):
        return untouched
    parts = stage(_hull_parts(s.with_df(d.filter(~asis)), target, 1 if variant == "reference" else 0))
    picks = _chained_picks(parts, keys, target)
    return picks.unionByName(untouched) if keys else picks


def _series_schema(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keys)


def _hull_parts(s: Ordered, target: int, shift: int) -> DataFrame:
    """(by.., _n, bucket, role, row_idx, x, y): hull points and sums of each bucket's rows in each row block,
    and the last row.  A sum's row column holds its count."""
    keys = list(s.by)
    width = (F.col("_n") - 2) / F.lit(float(target - 2))
    last = target - 3

    # bucket i owns rows [floor((i + shift) w) + 1, floor((i + 1 + shift) w) + 1); row 0 is bucket -1
    def start(i):
        return F.floor((i + shift) * width) + 1

    guess = F.floor((F.col(ROW) - 1) / width).cast("int") - shift
    near = F.array(guess - 1, guess, guess + 1)
    own = F.get(F.filter(near, lambda i: (F.col(ROW) >= start(i)) & (F.col(ROW) < start(i + 1))), F.lit(0))
    is_last = F.col(ROW) == F.col("_n") - 1
    # the last row is a candidate only of a last bucket that starts there
    usable = ~is_last | ((start(F.lit(last)) >= F.col("_n") - 1) & (F.col("bucket") == last))
    inner = s.df.withColumn("bucket", F.when(F.col(ROW) == 0, F.lit(-1)).otherwise(own))
    inner = inner.filter((F.col(ROW) == 0) | (F.col("bucket") >= 0) | is_last)
    inner = inner.withColumn("bucket", F.coalesce("bucket", F.lit(last + 1)))
    kind = F.when(is_last & usable, 3).when(is_last, 2).when(F.col("bucket") <= last, 1).otherwise(0)
    inner = inner.select(*keys, "_n", "bucket", ROW, "x", "y", kind.alias("kind"), home_block(s.block).alias(BLOCK))
    schema = f"{_series_schema(s.df, keys)}_n bigint, bucket int, role int, {ROW} bigint, x double, y double"
    return inner.groupBy(*keys, BLOCK).applyInPandas(lambda pdf: _block_parts(pdf, keys), schema)


def _with_keys(out: pd.DataFrame, pdf: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    for k in keys:
        out[k] = pdf[k].iloc[0]
    return out[[*keys, *[c for c in out.columns if c not in keys]]]


def _thinned(pdf: pd.DataFrame) -> pd.DataFrame:
    at = hull_candidates(pdf["bucket"].to_numpy(), pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf[ROW].to_numpy())
    return pdf.iloc[at]


def _block_parts(pdf: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    cand = _thinned(pdf[(pdf.kind == 1) | (pdf.kind == 3)])
    sums = pdf.groupby("bucket", as_index=False).agg(**{ROW: ("x", "size"), "x": ("x", "sum"), "y": ("y", "sum")})
    cols = ["bucket", ROW, "x", "y"]
    out = pd.concat([cand[cols].assign(role=CANDIDATE), sums[cols].assign(role=MEAN), pdf.loc[pdf.kind >= 2, cols].assign(role=LAST)], ignore_index=True)
    out["_n"] = pdf["_n"].iloc[0]
    return _with_keys(out[["_n", "bucket", "role", ROW, "x", "y"]], pdf, keys)


def _chained_picks(parts: DataFrame, keys: list[str], target: int) -> DataFrame:
    last, series = target - 3, _series_schema(parts, keys)
    # a group holds at least CHAIN_BUCKETS buckets, and more where buckets have few rows
    chain = F.greatest(F.lit(CHAIN_BUCKETS), F.ceil(F.lit(float(CHAIN_ROWS) * (target - 2)) / F.col("_n")))
    b = F.col("bucket")
    grp = lambda bucket: F.floor(bucket / chain).cast("bigint")

    def to(role: int, bucket, g):
        return F.struct(F.lit(role).alias("role"), bucket.alias("bucket"), g.alias("grp"))

    is_point = F.col("role") == CANDIDATE
    routes = F.array_compact(
        F.array(
            F.when(is_point & (b < 0), to(ENTRY, b, F.lit(0).cast("bigint"))),
            F.when(is_point & (b >= 0), to(CANDIDATE, b, grp(b))),
            F.when(is_point & (b >= 0) & (b < last) & (b % chain == chain - 1), to(ENTRY, b, grp(b) + 1)),
            # a bucket's mean is what the bucket before aims at
            F.when((F.col("role") == MEAN) & (b >= 1) & (b <= last + 1), to(MEAN, b - 1, grp(b - 1))),
        )
    )
    rows = parts.withColumn("_to", F.explode(routes)).select(*keys, "_to.grp", "_to.role", "_to.bucket", ROW, "x", "y")
    groups = last // CHAIN_BUCKETS + 1
    if groups > 1:
        maps = rows.groupBy(*keys, "grp").applyInPandas(lambda pdf: _group_map(pdf, keys), f"{series}grp bigint, frm bigint, {ROW} bigint")
        entries = _entries(stage(maps), keys, groups, series)
        rows = join_small(rows, entries, [*keys, "grp"], broadcast=False)
        rows = rows.filter((F.col("role") != ENTRY) | (F.col(ROW) == F.col("entry"))).drop("entry")
    point = f"{series}pick int, {ROW} bigint, x double, y double"
    picks = rows.groupBy(*keys, "grp").applyInPandas(lambda pdf: _group_picks(pdf, keys), point)
    ends = parts.filter((F.col("role") == LAST) | ((F.col("role") == CANDIDATE) & (b < 0)))
    ends = ends.select(*keys, F.when(b < 0, 0).otherwise(target - 1).alias("pick"), ROW, "x", "y")
    return picks.unionByName(ends)


def _entries(maps: DataFrame, keys: list[str], groups: int, series: str, fan: int | None = None) -> DataFrame:
    """(by.., grp, entry): the row of the pick that enters each group, from the maps of all groups.

    Maps of FAN neighbouring groups are composed first; what enters them is found one level up.
    """
    fan = fan or FAN
    schema = f"{series}grp bigint, entry bigint"
    if groups <= fan:
        start = maps.withColumn("entry", F.lit(0).cast("bigint"))
        return start.groupBy(*keys, F.lit(0).alias("_g")).applyInPandas(lambda pdf: _walk_groups(pdf, keys), schema)
    up = F.floor(F.col("grp") / fan).cast("bigint")
    joined = maps.groupBy(*keys, up.alias("_g")).applyInPandas(lambda pdf: _compose(pdf, keys, fan), f"{series}grp bigint, frm bigint, {ROW} bigint")
    above = _entries(stage(joined), keys, -(-groups // fan), series, fan).withColumnRenamed("grp", "_g")
    known = join_small(maps.withColumn("_g", up), above, [*keys, "_g"], broadcast=False)
    return known.groupBy(*keys, "_g").applyInPandas(lambda pdf: _walk_groups(pdf, keys), schema)


def _steps(pdf: pd.DataFrame) -> Iterator[tuple[int, dict[int, int]]]:
    for g, m in pdf.sort_values("grp").groupby("grp", sort=True):
        yield int(g), dict(zip(m["frm"], m[ROW], strict=True))


def _walk_groups(pdf: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    at, out = int(pdf["entry"].iloc[0]), []
    for g, m in _steps(pdf):
        out.append((g, at))
        at = m[at]
    return _with_keys(pd.DataFrame(out, columns=["grp", "entry"]), pdf, keys)


def _compose(pdf: pd.DataFrame, keys: list[str], fan: int) -> pd.DataFrame:
    whole, first = None, 0
    for g, m in _steps(pdf):
        first = g if whole is None else first
        whole = m if whole is None else {a: m[b] for a, b in whole.items()}
    out = pd.DataFrame({"grp": first // fan, "frm": list(whole), ROW: list(whole.values())})
    return _with_keys(out, pdf, keys)


def _follow(pdf: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bucket by bucket, for every distinct state the choice among the bucket's candidates: (bucket, choice of each
    state, rows, x, y of the candidates).  The chosen candidates are the states of the next bucket."""
    entry = pdf[pdf.role == ENTRY].sort_values(ROW)
    px, py = entry["x"].to_numpy(), entry["y"].to_numpy()
    sums = pdf[pdf.role == MEAN].groupby("bucket")[[ROW, "x", "y"]].sum()
    aim = {int(k): (sx / n, sy / n) for k, n, sx, sy in zip(sums.index, sums[ROW], sums["x"], sums["y"])}
    cand = _thinned(pdf[pdf.role == CANDIDATE]).sort_values(["bucket", ROW])
    bucket, qr, qx, qy = (cand[c].to_numpy() for c in ("bucket", ROW, "x", "y"))
    cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-2)), len(bucket))
    for lo, hi in zip(cuts, cuts[1:]):
        x, y = qx[lo:hi], qy[lo:hi]
        ax, ay = aim.get(int(bucket[lo]), (x[-1], y[-1]))
        choice, step = np.empty(len(px), dtype=np.int64), max(1, (1 << 21) // (hi - lo))
        for i in range(0, len(px), step):
            sx, sy = px[i : i + step, None], py[i : i + step, None]
            choice[i : i + step] = np.argmax(np.abs((sx - ax) * (y[None, :] - sy) - (sx - x[None, :]) * (ay - sy)), axis=1)
        yield int(bucket[lo]), choice, qr[lo:hi], x, y
        used = np.unique(choice)
        px, py = x[used], y[used]


def _group_map(pdf: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """For every possible entering pick the last pick of the group."""
    frm = np.sort(pdf.loc[pdf.role == ENTRY, ROW].to_numpy())
    state, at = np.arange(len(frm)), frm
    for _, choice, rows, _, _ in _follow(pdf):
        used, place = np.unique(choice, return_inverse=True)
        state, at = place[state], rows[used]
    return _with_keys(pd.DataFrame({"grp": pdf["grp"].iloc[0], "frm": frm, ROW: at[state]}), pdf, keys)


def _group_picks(pdf: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """The picks of a group from the one row that enters it."""
    out = [(bucket + 1, rows[c[0]], x[c[0]], y[c[0]]) for bucket, c, rows, x, y in _follow(pdf)]
    return _with_keys(pd.DataFrame(out, columns=["pick", ROW, "x", "y"]), pdf, keys)


def downsample(o: Ordered, x: str, y: str, budget: int, mode: str = "minmax") -> DataFrame:
    """minmax (default, also for unknown names), lttb or none, when a series exceeds the budget."""
    if mode == "none" or budget < 3:
        return o.select(x, y).df
    if mode == "lttb":
        return lttb(o, x, y, budget).withColumnsRenamed({"x": x, "y": y}).drop("pick")
    sized = with_series_size(o.select(x, y))
    fits = sized.df.filter(F.col("_n") <= budget).drop("_n")
    if not o.by:
        return fits if o.n <= budget else minmax_envelope(o, x, y, budget // 2)
    over = o.with_df(sized.df.filter(F.col("_n") > budget).drop("_n"))
    return fits.unionByName(minmax_envelope(over, x, y, budget // 2).select(*fits.columns))


def view_downsample(o: Ordered, x: str, y: str, low: float, high: float, budget: int, mode: str = "lttb") -> DataFrame:
    """The visible window with its continuity rows, reduced when above the budget."""
    seen = view_window(o.select(x, y), x, low, high)
    s = order_rows(seen.withColumnRenamed(ROW, "_old"), "_old", o.by, layout=o.layout)
    return downsample(s.with_df(s.df.drop("_old")), x, y, budget, mode)


# ---------------------------------------------------------------- resampling


def _segments(s: Ordered, points: int) -> DataFrame:
    """Each source row with its successor and the grid steps it may own."""

    def build(w):
        return {"x1": F.lead("x").over(w), "y1": F.lead("y").over(w), "m1": F.lead("m").over(w)}

    d = over_blocks(s, 0, 1, build)
    ends = s.df.groupBy(*s.by).agg(F.min("x").alias("_a"), F.max("x").alias("_z"))
    if s.by:
        d = join_sized(d, ends, s.by)
    else:
        d = d.withColumn("_e", facts(ends)).withColumn("_a", F.col("_e._a")).withColumn("_z", F.col("_e._z")).drop("_e")
    unit = F.nullif((F.col("_z") - F.col("_a")) / F.lit(float(points - 1)), F.lit(0.0))
    lo = F.greatest(F.ceil((F.col("x") - F.col("_a")) / unit) - 1, F.lit(0))
    hi = F.least(F.floor((F.col("x1") - F.col("_a")) / unit) + 1, F.lit(points - 1))
    d = d.filter("x1 is not null").withColumn("_lo", F.coalesce(lo, F.lit(0))).withColumn("_hi", F.coalesce(hi, F.lit(points - 1)))
    d = d.filter("_lo <= _hi").withColumn("k", F.explode(F.sequence("_lo", "_hi")))
    d = d.withColumn("gx", F.col("_a") + (F.col("_z") - F.col("_a")) * F.col("k") / F.lit(float(points - 1)))
    at_end = (F.col("gx") >= F.col("_z")) & (F.col("x1") == F.col("_z"))
    own = (F.col("x") < F.col("x1")) & (F.col("gx") >= F.col("x")) & ((F.col("gx") < F.col("x1")) | at_end)
    # all x equal: the first row stands for the whole grid
    return d.filter(own | ((F.col("_a") == F.col("_z")) & (F.col(ROW) == 0)))


def resample(o: Ordered, x: str, y: str, points: int = 500, method: str = "linear") -> DataFrame:
    """Values on `points` evenly spaced x over the finite points: (by.., k, x, y).

    Under two finite points (or a grid under two) the input comes back as it is.  The cubic form keeps
    the first row of repeated x.
    """
    if method not in ("linear", "nearest", "cubic"):
        raise ValueError(f"unknown resample method {method}")
    s = finite_series(o, x, y)
    raw = o.df.select(*o.by, F.col(ROW).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    if points < 2 or (not o.by and s.n < 2):
        return raw
    if method == "cubic":
        s = _distinct_x(s)
        s = s.with_df(_spline(s))
    else:
        s = s.with_df(s.df.withColumn("m", F.lit(0.0)))
    g = _segments(s, points)
    t = F.col("gx") - F.col("x")
    h = F.nullif(F.col("x1") - F.col("x"), F.lit(0.0))
    if method == "linear":
        value = F.col("y") + (F.col("y1") - F.col("y")) * t / h
    elif method == "nearest":
        value = F.when(F.abs(t) <= F.abs(F.col("x1") - F.col("gx")), F.col("y")).otherwise(F.col("y1"))
    else:
        a, b = (F.col("x1") - F.col("gx")) / h, t / h
        bend = ((a * a * a - a) * F.col("m") + (b * b * b - b) * F.col("m1")) * (h * h) / 6.0
        value = a * F.col("y") + b * F.col("y1") + bend
    out = g.select(*o.by, F.col("k").cast("bigint").alias("k"), F.col("gx").alias("x"), F.coalesce(value, F.col("y")).alias("y"))
    if not o.by:
        return out
    sizes = s.df.groupBy(*o.by).agg(F.count(F.lit(1)).alias("_m"))
    short = join_sized(raw, sizes, o.by).filter(F.coalesce("_m", F.lit(0)) < 2).drop("_m")
    return out.unionByName(short)


def _distinct_x(s: Ordered) -> Ordered:
    """Drop rows repeating the x before them, renumbering only when there are any."""
    d = over_blocks(s, 1, 0, lambda w: {"_same": F.coalesce(F.lag("x").over(w) == F.col("x"), F.lit(False))})
    if d.filter("_same").limit(1).count() == 0:
        return s
    d = d.filter("not _same").drop("_same").withColumnRenamed(ROW, "_old")
    r = order_rows(d, "_old", s.by, layout=s.layout)
    return r.with_df(r.df.drop("_old"))


def _spline(s: Ordered) -> DataFrame:
    """Natural-spline second derivatives per block.

    A knot's influence at least halves per row, so a 64-row halo on both sides reproduces the
    whole-series solution to double precision.
    """
    sized = with_series_size(s)
    keys = list(s.by)
    schema = "".join(f"`{c}` {s.df.schema[c].dataType.simpleString()}, " for c in keys)
    halo = with_halo(sized, SPLINE_HALO + 1, SPLINE_HALO + 1)
    size = max(s.block, SPLINE_HALO + 1)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ROW)
        m = _second_derivatives(pdf["x"].to_numpy(), pdf["y"].to_numpy())
        out = pdf[[*keys, ROW, "x", "y"]].assign(m=m)
        return out[out[ROW] // size == pdf[BLOCK]]

    return halo.groupBy(*keys, BLOCK).applyInPandas(solve, f"{schema}{ROW} bigint, x double, y double, m double")


def _second_derivatives(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Tridiagonal solve with zero ends, run side by side over overlapping chunks."""
    n = len(x)
    m = np.zeros(n)
    if n < 3:
        return m
    h = np.diff(x)
    rhs = 6.0 * np.diff(np.diff(y) / h)
    low, diag, up = h[:-1], 2.0 * (h[:-1] + h[1:]), h[1:]
    k = n - 2
    starts = np.arange(0, k, SPLINE_CHUNK)
    span = SPLINE_CHUNK + 2 * SPLINE_HALO
    at = starts[:, None] - SPLINE_HALO + np.arange(span)[None, :]
    ok = (at >= 0) & (at < k)
    safe = np.clip(at, 0, k - 1)
    lo, di, u, r = (np.where(ok, v[safe], f) for v, f in ((low, 0.0), (diag, 1.0), (up, 0.0), (rhs, 0.0)))
    c, d = np.zeros_like(r), np.zeros_like(r)
    for j in range(span):
        before_c, before_d = (c[:, j - 1], d[:, j - 1]) if j else (0.0, 0.0)
        den = di[:, j] - lo[:, j] * before_c
        c[:, j], d[:, j] = u[:, j] / den, (r[:, j] - lo[:, j] * before_d) / den
    for j in range(span - 2, -1, -1):
        d[:, j] -= c[:, j] * d[:, j + 1]
    m[1:-1] = d[:, SPLINE_HALO : SPLINE_HALO + SPLINE_CHUNK].reshape(-1)[:k]
    return m
