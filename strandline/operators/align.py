"""Matching series on x: nearest join with arithmetic, nearest points, timestamp repair."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions import fx
from strandline.plans.blocks import last_marked
from strandline.plans.layout import BUCKET, DEFAULT, ROW, Layout
from strandline.plans.ordering import Ordered, composite, facts, find_ranges, join_sized, join_small
from strandline.plans.staging import stage

# Fixed value: double machine epsilon, the smallest divisor magnitude that counts.
EPSILON = 2.220446049250313e-16
POINTS_PER_PASS = 64


def nearest_join(
    left: DataFrame,
    right: DataFrame,
    x: str,
    order: str,
    tolerance: float = float("inf"),
    by: Sequence[str] = (),
    layout: Layout = DEFAULT,
) -> DataFrame:
    """For each left row the right row with the nearest x within `tolerance`.

    Ties take the lower x.  Among right rows of equal x: the last by `order` when it lies below the
    left x, the first otherwise.  Where no right row is near enough a left row is left out, so nothing matched gives
    no rows; `order` may be of any type that sorts, the same on both sides.  Both sides are merged on one x line cut into ranges; each range
    scans forwards and backwards once and the nearest right rows of neighbouring ranges come from a
    table with one row per range, so no pair list is ever built, whatever the tolerance.

    Returns the left columns plus x2, row2, distance and the right columns prefixed `r_`.
    """
    by = tuple(by)
    lcols = [c for c in left.columns if c not in by]
    rcols = [c for c in right.columns if c not in by]
    xl, xr = fx.finite(left[x].cast("double")), fx.finite(right[x].cast("double"))
    l = left.select(
        *by, xl.alias("_x"), F.lit(0).alias("_side"), _order(left, order).alias("_o"),
        F.struct(*lcols).alias("_l"),
        F.lit(None).cast(_right_type(right, rcols, x, order)).alias("_r"),
    )
    point = F.struct(xr.alias("x"), _order(right, order).alias("o"), F.struct(*rcols).alias("v"))
    r = right.select(
        *by, xr.alias("_x"), F.lit(1).alias("_side"), _order(right, order).alias("_o"),
        F.lit(None).cast(l.schema["_l"].dataType).alias("_l"), point.alias("_r"),
    )
    line = l.unionByName(r).filter("_x is not null")
    key = (*by, "_x", "_side", "_o")
    ranges = find_ranges(line.select(*key), key, line.count(), layout)
    line = ranges.assign(line, composite(line, key))

    part = Window.partitionBy(*by, BUCKET)
    upto = (Window.unboundedPreceding, 0)
    fwd = part.orderBy("_x", "_side", "_o").rowsBetween(*upto)
    back = part.orderBy(F.desc("_x"), F.desc("_side"), F.desc("_o")).rowsBetween(*upto)
    d = line.withColumn("_lo", F.last("_r", ignorenulls=True).over(fwd))
    d = d.withColumn("_hi", F.last("_r", ignorenulls=True).over(back)).filter("_side = 0")
    if ranges.n > 1:
        ends = line.filter("_side = 1").groupBy(*by, BUCKET).agg(
            F.min_by("_r", F.struct("_x", "_o")).alias("_first"),
            F.max_by("_r", F.struct("_x", "_o")).alias("_last"),
        )
        d = _carry(d, ends, by, ranges.n)
        d = d.withColumn("_lo", F.coalesce("_lo", "_lo_c")).withColumn("_hi", F.coalesce("_hi", "_hi_c"))
    dl, dh = F.col("_x") - F.col("_lo.x"), F.col("_hi.x") - F.col("_x")
    low = F.col("_lo").isNotNull() & (F.col("_hi").isNull() | (dl <= dh))
    d = d.withColumn("_p", F.when(low, F.col("_lo")).otherwise(F.col("_hi")))
    d = d.withColumn("distance", F.abs(F.col("_p.x") - F.col("_x"))).filter(F.col("distance") <= tolerance)
    return d.select(
        *by, "_l.*", F.col("_p.x").alias("x2"), F.col("_p.o").alias("row2"), "distance",
        *[F.col(f"_p.v.{c}").alias(f"r_{c}") for c in rcols],
    )


def _order(df: DataFrame, name: str) -> Column:
    """The order column: whole numbers of any width as one type, everything else (text, times) as it is."""
    return F.col(name).cast("bigint") if isinstance(df.schema[name].dataType, T.IntegralType) else F.col(name)


def _right_type(right: DataFrame, rcols: Sequence[str], x: str, order: str):
    return right.select(
        F.struct(
            F.col(x).cast("double").alias("x"), _order(right, order).alias("o"), F.struct(*rcols).alias("v")
        ).alias("p")
    ).schema["p"].dataType


def _carry(d: DataFrame, ends: DataFrame, by: tuple[str, ...], n_ranges: int) -> DataFrame:
    """Nearest right row of the ranges before and after, per (series, range)."""
    if by:
        grid = d.select(*by, BUCKET).distinct()
    else:
        grid = d.sparkSession.range(n_ranges).select(F.col("id").cast("int").alias(BUCKET))
    grid = join_small(grid, ends, (*by, BUCKET), broadcast=False)
    seq = Window.partitionBy(*by).orderBy(BUCKET)
    rev = Window.partitionBy(*by).orderBy(F.desc(BUCKET))
    before = (Window.unboundedPreceding, -1)
    all_ends = grid.withColumn("_lo_c", F.last("_last", ignorenulls=True).over(seq.rowsBetween(*before)))
    all_ends = all_ends.withColumn("_hi_c", F.last("_first", ignorenulls=True).over(rev.rowsBetween(*before)))
    return join_small(d, all_ends.drop("_first", "_last"), (*by, BUCKET), broadcast=not by)


def combine(matched: DataFrame, y: str, op: str, name: str = "y") -> DataFrame:
    """add / subtract / multiply / divide of the left y and the matched right y."""
    a, b = fx.num(y), fx.num(f"r_{y}")
    ops = {
        "add": a + b,
        "subtract": a - b,
        "multiply": a * b,
        "divide": F.when(F.abs(b) >= EPSILON, F.try_divide(a, b)),
    }
    return matched.withColumn(name, fx.stored(ops[op]))


def match_stats(left: DataFrame, right: DataFrame, matched: DataFrame) -> DataFrame:
    """matched_count and total_possible = rows of the smaller side."""
    def rows(d: DataFrame) -> Column:
        return d.agg(F.count(F.lit(1)).alias("c")).scalar()

    return matched.agg(F.count(F.lit(1)).alias("matched_count")).select(
        "matched_count", F.least(rows(left), rows(right)).alias("total_possible")
    )


def nearest_points(df: DataFrame, x: str, y: str, row: str, points: Sequence[tuple[float, float]]) -> DataFrame:
    """Nearest finite (x, y) row to each asked point (lowest row of equals): (qx, qy, row, distance).

    One partial aggregate per asked point in a single pass; no point-by-row product.
    """
    vx, vy = fx.finite(F.col(x).cast("double")), fx.finite(F.col(y).cast("double"))
    d = df.select(vx.alias("_x"), vy.alias("_y"), F.col(row).alias("_row")).filter(
        "_x is not null and _y is not null"
    )
    out = None
    for at in range(0, len(points), POINTS_PER_PASS):
        some = points[at : at + POINTS_PER_PASS]
        best = d.agg(
            *[
                F.min(
                    F.struct(
                        F.sqrt((F.col("_x") - qx) * (F.col("_x") - qx) + (F.col("_y") - qy) * (F.col("_y") - qy)).alias("d"),
                        F.col("_row").alias("r"),
                    )
                ).alias(f"_b{i}")
                for i, (qx, qy) in enumerate(some)
            ]
        )
        items = [
            F.struct(
                F.lit(float(qx)).alias("qx"), F.lit(float(qy)).alias("qy"),
                F.col(f"_b{i}.r").alias("row"), F.col(f"_b{i}.d").alias("distance"),
            )
            for i, (qx, qy) in enumerate(some)
        ]
        part = best.select(F.explode(F.array(*items)).alias("p")).select("p.*").filter("row is not null")
        out = part if out is None else out.unionByName(part)
    return out


@dataclass(frozen=True)
class Cells:
    """A balanced tree of cuts across x and y; nodes have the numbers of a heap, leaves are the cells."""

    depth: int
    axis: np.ndarray
    cut: np.ndarray

    @classmethod
    def grow(cls, xy: np.ndarray, depth: int) -> Cells:
        """Cuts at the median of the wider side of each node's sampled points."""
        axis, cut = np.zeros(1 << depth, dtype=np.int64), np.zeros(1 << depth)
        held = {1: xy}
        for node in range(1, 1 << depth):
            own = held.pop(node)
            if len(own):
                axis[node] = int(np.argmax(np.ptp(own, axis=0)))
                cut[node] = np.median(own[:, axis[node]])
            right = own[:, axis[node]] > cut[node]
            held[2 * node], held[2 * node + 1] = own[~right], own[right]
        return cls(depth, axis, cut)

    def of(self, xy: np.ndarray) -> np.ndarray:
        node = np.ones(len(xy), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + (xy[np.arange(len(xy)), self.axis[node]] > self.cut[node])
        return node


@dataclass(frozen=True)
class Boxes:
    """Points in a balanced tree of boxes: halves of equal size along the wider side, down to leaves of about LEAF points.

    Leaves hold positions in ascending order; a last point that is repeated fills them up.
    """

    xy: np.ndarray
    leaves: np.ndarray
    bounds: list[tuple[np.ndarray, np.ndarray]]

    LEAF, QUERIES, PAIRS = 16, 1024, 1 << 15

    @classmethod
    def grow(cls, xy: np.ndarray) -> Boxes:
        depth = max(0, (len(xy) - 1) // cls.LEAF).bit_length()
        at = np.minimum(np.arange(-(-len(xy) >> depth) << depth), len(xy) - 1)[None, :]
        for _ in range(depth):
            side = np.ptp(xy[at], axis=1).argmax(axis=1)
            order = xy[at, side[:, None]].argsort(axis=1, kind="stable")
            at = np.take_along_axis(at, order, axis=1).reshape(2 * len(at), -1)
        at = np.sort(at, axis=1)
        bounds = [(xy[at].min(axis=1), xy[at].max(axis=1))]
        for _ in range(depth):
            low, high = bounds[0]
            bounds.insert(0, (np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])))
        return cls(xy, at, bounds)

    def _near(self, level: int, node: np.ndarray, ask: np.ndarray) -> np.ndarray:
        low, high = (b[node] for b in self.bounds[level])
        return (np.maximum(np.maximum(low - ask, ask - high), 0) ** 2).sum(axis=1)

    def nearest(self, ask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distance and position of the nearest point to each row of `ask`, the first of equals."""
        found = [self._some(ask[lo : lo + self.QUERIES]) for lo in range(0, len(ask), self.QUERIES)]
        return tuple(np.concatenate(part) for part in zip(*found))

    def _some(self, ask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        node = np.zeros(len(ask), dtype=np.int64)
        for level in range(1, len(self.bounds)):
            left, right = self._near(level, 2 * node, ask), self._near(level, 2 * node + 1, ask)
            node = 2 * node + (right < left)
        best, first = self._least(node, ask)
        # every leaf whose box is no farther than that; a hair more, for rounding
        limit = best * best * (1 + 1e-9)
        q, node = np.arange(len(ask)), np.zeros(len(ask), dtype=np.int64)
        for level in range(1, len(self.bounds)):
            q, node = np.repeat(q, 2), (2 * node[:, None] + np.arange(2)).ravel()
            keep = self._near(level, node, ask[q]) <= limit[q]
            q, node = q[keep], node[keep]
        for lo in range(0, len(q), self.PAIRS):
            who = q[lo : lo + self.PAIRS]
            d, at = self._least(node[lo : lo + self.PAIRS], ask[who])
            order = np.lexsort((at, d, who))
            top = order[np.flatnonzero(np.diff(who[order], prepend=-1))]
            w, d, at = who[top], d[top], at[top]
            better = (d < best[w]) | ((d == best[w]) & (at < first[w]))
            best[w[better]], first[w[better]] = d[better], at[better]
        return best, first

    def _least(self, leaf: np.ndarray, ask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.leaves[leaf]
        away = self.xy[at] - ask[:, None, :]
        d = np.sqrt(away[:, :, 0] * away[:, :, 0] + away[:, :, 1] * away[:, :, 1])
        k, i = d.argmin(axis=1), np.arange(len(d))
        return d[i, k], at[i, k]


CELL_ROWS, MAX_CELLS, CELL_SAMPLE = 16_384, 4096, 16
TILE_POINTS, TILE_QUERIES = 65_536, 65_536


def nearest_rows(
    df: DataFrame, x: str, y: str, row: str, queries: DataFrame, qx: str = "qx", qy: str = "qy", cell_rows: int = CELL_ROWS,
    tile_points: int = TILE_POINTS, tile_queries: int = TILE_QUERIES,
) -> DataFrame:
    """The nearest finite (x, y) row to every row of `queries` (lowest row of equals): its columns, then row and distance.

    Points are dealt to cells of about `cell_rows`, cut at medians of a bounded sample; their true bounds, at most
    MAX_CELLS boxes, go to the tasks.  A query is sent to the cells whose box is no farther than the farthest corner of
    another one, so the nearest point is always among them.  Cells meet their queries in tiles of bounded size, and a
    query only looks at the points of a tile in boxes that may hold its nearest one (`Boxes`).
    Queries with a missing or infinite coordinate, and all queries if there is no point, have no row.
    """
    vx, vy = fx.finite(F.col(x).cast("double")), fx.finite(F.col(y).cast("double"))
    p = df.select(vx.alias("_x"), vy.alias("_y"), F.col(row).cast("bigint").alias("_row")).filter("_x is not null and _y is not null")
    p = stage(p.groupBy("_x", "_y").agg(F.min("_row").alias("_row")))
    n = p.count()
    depth = max(0, min(MAX_CELLS, -(-n // cell_rows)) - 1).bit_length()
    share = min(1.0, CELL_SAMPLE * (1 << depth) / max(n, 1))
    some = p if share >= 1.0 else p.filter(F.xxhash64("_row") < F.lit(int(-(2**63) + share * (2**64 - 1))))
    sample = some.select("_x", "_y").toPandas().to_numpy(dtype=float)
    cells = Cells.grow(sample.reshape(-1, 2), depth)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(cell=cells.of(pdf[["_x", "_y"]].to_numpy()))

    placed = stage(p.mapInPandas(deal, "_x double, _y double, _row bigint, cell bigint"))
    bounds = placed.groupBy("cell").agg(F.min("_x"), F.min("_y"), F.max("_x"), F.max("_y"), F.count(F.lit(1))).collect()
    boxes = np.array([tuple(b)[:5] for b in bounds], dtype=float).reshape(-1, 5)
    asked = stage(queries.withColumn("_q", F.monotonically_increasing_id()))
    a, b = fx.finite(F.col(qx).cast("double")), fx.finite(F.col(qy).cast("double"))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf) if len(boxes) else 0, 512):
                part = pdf.iloc[lo : lo + 512]
                at = part[["_a", "_b"]].to_numpy()[:, None, :]
                low, high = boxes[None, :, 1:3], boxes[None, :, 3:5]
                near = (np.maximum(np.maximum(low - at, at - high), 0) ** 2).sum(axis=2)
                far = (np.maximum(np.abs(at - low), np.abs(at - high)) ** 2).sum(axis=2)
                # a hair wider than exact bounds, for rounding
                q, c = np.nonzero(near <= far.min(axis=1, keepdims=True) * (1 + 1e-9))
                yield pd.DataFrame({"_q": part["_q"].to_numpy()[q], "_a": part["_a"].to_numpy()[q], "_b": part["_b"].to_numpy()[q], "cell": boxes[c, 0].astype(np.int64)})

    sent = asked.select("_q", a.alias("_a"), b.alias("_b")).filter("_a is not null and _b is not null")
    sent = stage(sent.mapInPandas(send, "_q bigint, _a double, _b double, cell bigint"))
    crowd = {r["cell"]: r["n"] for r in sent.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    tiles = [(int(r["cell"]), -(-int(r[5]) // tile_points), -(-crowd[r["cell"]] // tile_queries)) for r in bounds if r["cell"] in crowd]
    plan = F.broadcast(df.sparkSession.createDataFrame(tiles, "cell bigint, _ps int, _qs int"))
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    none = lambda t: F.lit(None).cast(t)
    points = placed.join(plan, "cell").select("cell", F.pmod(F.xxhash64("_row"), F.col("_ps")).cast("int").alias("i"), all_of("_qs").alias("j"), none("bigint").alias("_q"), F.col("_x").alias("u"), F.col("_y").alias("v"), "_row")
    wanted = sent.join(plan, "cell").select("cell", all_of("_ps").alias("i"), F.pmod(F.xxhash64("_q"), F.col("_qs")).cast("int").alias("j"), "_q", F.col("_a").alias("u"), F.col("_b").alias("v"), none("bigint").alias("_row"))

    def closest(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf[pdf["_q"].isna()].sort_values("_row")  # the first of equals has the lowest row
        ask = pdf[pdf["_q"].notna()]
        if at.empty or ask.empty:
            return pd.DataFrame({"_q": [], "d": [], "r": []})
        d, k = Boxes.grow(at[["u", "v"]].to_numpy()).nearest(ask[["u", "v"]].to_numpy())
        return pd.DataFrame({"_q": ask["_q"].to_numpy().astype("int64"), "d": d, "r": at["_row"].to_numpy().astype("int64")[k]})

    found = points.unionByName(wanted).groupBy("cell", "i", "j").applyInPandas(closest, "_q bigint, d double, r bigint")
    found = found.groupBy("_q").agg(F.min(F.struct("d", "r")).alias("m"))
    out = asked.join(found, "_q", "left")
    return out.select(*queries.columns, F.col("m.r").alias("row"), F.col("m.d").alias("distance"))


def repair_timestamps(o: Ordered, x: str, error_max: float, step: float, name: str) -> DataFrame:
    """Replace values below error_max + 1 by counting `step`s from the nearest trusted row.

    Leading errors count back from the first trusted value, later ones on from the last; with no
    trusted value at all, back from the threshold.
    """
    limit = float(error_max) + 1.0
    v = F.col(x).cast("double")
    bad = F.coalesce(v < limit, F.lit(False))
    good = F.when(~bad, F.struct(F.col(ROW).alias("row"), v.alias("x")))
    firsts = o.df.groupBy(*o.by).agg(F.min(good).alias("_first"), F.count(F.lit(1)).alias("_n"))
    d = last_marked(o, good, "_last")
    if o.by:
        d = join_sized(d, firsts, o.by)
        first, n = F.col("_first"), F.col("_n")
    else:
        d = d.withColumn("_f", facts(firsts))
        first, n = F.col("_f._first"), F.col("_f._n")
    lead = F.when(first.isNotNull(), first["x"] - F.lit(float(step)) * (first["row"] - F.col(ROW))).otherwise(
        F.lit(limit) - F.lit(float(step)) * (n - F.col(ROW))
    )
    later = F.col("_last.x") + F.lit(float(step)) * (F.col(ROW) - F.col("_last.row"))
    fixed = F.when(~bad, v).when(F.col("_last").isNotNull(), later).otherwise(lead)
    return d.withColumn(name, fixed).drop("_first", "_n", "_f", "_last")
