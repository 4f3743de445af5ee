"""Exact order statistics of many columns and row segments together, by refining bits.

A double's bits, turned so that they sort like its value, are counted 16 at a time: one scan counts the leading
bits of all columns and segments, later ones only look at values that share the leading bits of a wanted rank.
A scan shuffles counts, never values, and at most 65,536 of them for a (segment, column, pick); it is over as
soon as the wanted values are alone in their bins, mostly after two or three.  The driver holds one row for each
(segment, column, pick), so segments must be few by their meaning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 16
TOP = np.uint64(1 << 63)
COUNTS = "seg int, col int, pick int, rank bigint, bin int, count bigint, low bigint, high bigint"
FLUSH = 1 << 17

Transform = Callable[[np.ndarray, np.ndarray, int], np.ndarray]


def sortable_bits(v: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the values; both zeros are one."""
    b = np.ascontiguousarray(v + 0.0).view(np.uint64)
    return np.where(b & TOP, ~b, b | TOP)


def values_of(bits: np.ndarray) -> np.ndarray:
    return np.where(bits & TOP, bits & ~TOP, ~bits).view(np.float64)


@dataclass
class Aim:
    """What is known of one wanted value: its leading bits and its rank among the values that share them."""

    bits: int
    rank: int
    value: float | None = None


def _signed(bits: np.ndarray) -> np.ndarray:
    return (bits ^ TOP).view(np.int64)


Counts = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _summed(code: np.ndarray, count: np.ndarray | None, low: np.ndarray, high: np.ndarray) -> Counts:
    """One entry a code: how many, the smallest and the largest key."""
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    n = np.diff(first, append=len(code)) if count is None else np.add.reduceat(count[order], first)
    return code[first], n, np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)


def _counter(width: int, whole: int | None, done: int, aims: dict | None, transform: Transform | None):
    """Counts one round over a partition of (s, c0, c1, ...), held as plain arrays by (segment, column, pick, bin)."""
    picks = 1 + max((p for by_pick in (aims or {}).values() for p in by_pick), default=0)
    ranks = {((s * width + c) * picks + p): r for c, by_pick in (aims or {}).items() for p, by_seg in by_pick.items() for s, (_, r) in by_seg.items()}
    known = {}
    for c, by_pick in (aims or {}).items():
        for p, by_seg in by_pick.items():
            bits, wanted = np.zeros(max(by_seg) + 2, dtype=np.uint64), np.zeros(max(by_seg) + 2, dtype=bool)
            for s, (b, _) in by_seg.items():
                bits[s], wanted[s] = b, True
            known.setdefault(c, []).append((p, bits, wanted))

    def counted(keys: np.ndarray, segs: np.ndarray, c: int, pick: int) -> Counts:
        bins = ((keys >> np.uint64(64 - BITS - done)) & np.uint64((1 << BITS) - 1)).astype(np.int64)
        return _summed((((segs.astype(np.int64) * width + c) * picks + pick) << BITS) | bins, None, keys, keys)

    def rounds(keys: np.ndarray, segs: np.ndarray, c: int) -> Iterator[Counts]:
        if aims is None:
            yield counted(keys, segs, c, 0)
            return
        for pick, bits, wanted in known.get(c, []):
            at = np.minimum(segs, len(bits) - 1)
            same = wanted[at] & ((keys >> np.uint64(64 - done)) == bits[at])
            if same.any():
                yield counted(keys[same], segs[same], c, pick)

    def merged(held: list[Counts]) -> Counts:
        return _summed(*(np.concatenate(part) for part in zip(*held))) if len(held) > 1 else held[0]

    def frame(counts: Counts) -> pd.DataFrame:
        code, count, low, high = counts
        group = code >> BITS
        col, pick = group // picks % width, group % picks
        if aims is None:
            pick, rank = np.full(len(code), -1), np.full(len(code), -1)
        else:
            ids, at = np.unique(group, return_inverse=True)
            rank = np.array([ranks[g] for g in ids.tolist()], dtype=np.int64)[at]
        made = {"seg": group // (picks * width), "col": col, "pick": pick, "rank": rank, "bin": code & ((1 << BITS) - 1)}
        return pd.DataFrame({**made, "count": count, "low": _signed(low), "high": _signed(high)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in batches:
            s = pdf["s"].to_numpy()
            for c in range(width):
                v = pdf[f"c{c}"].to_numpy(dtype=np.float64)
                for segs in [s] if whole is None else [s, np.full(len(s), whole, dtype=s.dtype)]:
                    ok = np.isfinite(v) & (segs >= 0)
                    w, g = v[ok], segs[ok]
                    if transform is not None:
                        w = transform(w, g, c)
                        ok = np.isfinite(w)
                        w, g = w[ok], g[ok]
                    for part in rounds(sortable_bits(w), g, c) if len(w) else ():
                        held.append(part)
                        size += len(part[0])
            if size > FLUSH:
                held = [merged(held)]
                size = len(held[0][0])
                if 2 * size > FLUSH:
                    yield frame(held.pop())
                    size = 0
        if held:
            yield frame(merged(held))

    return run


def select(
    df: DataFrame, cols: Sequence[Column], picks: dict[str, Callable[[Column], Column]], segment: Column | None = None,
    whole: int | None = None, transform: Transform | None = None,
) -> dict[tuple[int, int], dict]:
    """{(segment, position of the column): {"n": values, pick: value, ...}} over the finite values.

    `segment` numbers few row groups from 0 (null leaves a row out); `whole` also gives all rows together under
    that number.  `transform(values, segments, column)` is applied first, in the tasks.  Groups without values are
    missing.  `picks` name 0-based ranks by the number of values (see `plans/ranks.py`).
    """
    seg = F.lit(0) if segment is None else F.coalesce(segment.cast("int"), F.lit(-1))
    rows = df.select(seg.cast("int").alias("s"), *[c.cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    names, out, open_aims = list(picks), {}, None
    keys = ["seg", "col", "pick"]
    for done in range(0, 64, BITS):
        aims = None
        if open_aims is not None:
            aims = {}
            for (s, c, p), a in open_aims.items():
                aims.setdefault(c, {}).setdefault(p, {})[s] = (a.bits, a.rank)
        counts = rows.mapInPandas(_counter(len(cols), whole, done, aims, transform), COUNTS)
        counts = counts.groupBy(*keys, "rank", "bin").agg(F.sum("count").alias("count"), F.min("low").alias("low"), F.max("high").alias("high"))
        w = Window.partitionBy(*keys)
        upto = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("n", F.sum("count").over(w)).withColumn("_upto", F.sum("count").over(upto))
        if aims is None:
            ranks = F.array(*[F.struct(F.lit(i).alias("p"), f(F.col("n")).cast("bigint").alias("r")) for i, f in enumerate(picks.values())])
        else:
            ranks = F.array(F.struct(F.col("pick").alias("p"), F.col("rank").alias("r")))
        before = F.col("_upto") - F.col("count")
        hit = counts.select("seg", "col", "bin", "n", "low", "high", before.alias("before"), "_upto", F.explode(ranks).alias("k")).filter("k.r >= before and k.r < _upto")
        found, open_aims, earlier = hit.collect(), {}, open_aims or {}
        for r in found:
            at = (r.seg, r.col, r.k.p)
            if aims is None:
                out.setdefault((r.seg, r.col), {"n": r.n})
            bits = (earlier[at].bits if at in earlier else 0) << BITS | r.bin
            if r.low == r.high or done == 64 - BITS:
                key = np.array([r.low], dtype=np.int64).view(np.uint64) ^ TOP
                out[r.seg, r.col][names[r.k.p]] = float(values_of(key)[0])
            else:
                open_aims[at] = Aim(bits, r.k.r - r.before)
        if not open_aims:
            break
    return out


def medians_and_deviations(df: DataFrame, cols: Sequence[Column], rank: Callable[[Column], Column], segment: Column | None = None, whole: int | None = None) -> dict[tuple[int, int], dict]:
    """{(segment, column): {"n", "median", "mad"}}: the value at `rank` and then that of the distances from it."""
    mid = select(df, cols, {"median": rank}, segment, whole)
    if not mid:
        return {}
    size = max(s for s, _ in mid) + 1
    centre = np.full((size, len(cols)), np.nan)
    for (s, c), m in mid.items():
        centre[s, c] = m["median"]
    away = select(df, cols, {"mad": rank}, segment, whole, lambda v, segs, c: np.abs(v - centre[segs, c]))
    return {k: {**m, "mad": away[k]["mad"]} for k, m in mid.items() if k in away}
