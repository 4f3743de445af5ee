"""Hard-negative mining with Four-Russians inner products.

Components become integers, and an integer inner product is a sum over groups of eight dimensions and over
bit planes: the eight bits of a candidate's group in one plane are a byte, and the byte picks one of the 256
subset sums of the anchor's eight components, computed once for each anchor.  Planes are added from the highest
down, with one shift between them; the highest is the sign plane of two's complement and counts negatively.

Anchors meet all rows in a grid of (anchor block, row block) tasks.  Block sizes are bounded, and a task
returns at most a few rows for each of its anchors, so no task holds the table and nothing is broadcast.
A first pass finds each anchor's best positives, a second one the negatives in the window of each positive.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.plans.staging import stage

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95
ROW_BLOCK, ANCHOR_BLOCK = 65_536, 16_384
TILE, CHUNK = 256, 512
GROUP = 8


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, x as double; null for a null vector or one with a null or non-finite component.

    Values beyond 64 bits are clamped.
    """
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return F.when(finite, F.transform(v, lambda e: F.floor(F.lit(float(scale)) * e)))


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): the sum of the components whose bits are set, for every byte."""
    n, d = anchors.shape
    out = np.zeros((d // GROUP, 256, n), dtype=anchors.dtype)
    for g in range(d // GROUP):
        for j in range(GROUP):
            out[g, 1 << j : 2 << j] = out[g, : 1 << j] + anchors[:, g * GROUP + j]
    return out


def bit_planes(rows: np.ndarray) -> np.ndarray:
    """(planes, groups, rows) bytes of the two's complement numbers, the sign plane first."""
    top = int(max(rows.max(initial=0), -(rows.min(initial=0) + 1)))
    planes = top.bit_length() + 1
    bits = [((rows >> b) & 1).astype(np.uint8) for b in range(planes - 1, -1, -1)]
    return np.stack([np.packbits(b, axis=1, bitorder="little").T for b in bits])


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows, anchors) inner products from the tables and the rows' bytes."""
    out = np.zeros((planes.shape[2], tables.shape[2]), dtype=tables.dtype)
    part = np.empty_like(out)
    for k, plane in enumerate(planes):
        if k:
            out <<= 1
        for g, index in enumerate(plane):
            np.take(tables[g], index, axis=0, out=part, mode="clip")
            if k:
                out += part
            else:
                out -= part  # the sign plane
    return out


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows of integers, padded with zeros to whole groups; shorter vectors end in zeros."""
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _width(*frames: pd.DataFrame) -> int:
    longest = max((len(v) for f in frames for v in f["q"]), default=0)
    return max(GROUP, -(-longest // GROUP) * GROUP)


def _kind(anchors: np.ndarray, rows: np.ndarray):
    """int32 where no sum of products can leave it, else 64 bits (sums are taken modulo 2^64)."""
    peak = lambda m: int(max(m.max(initial=0), -int(m.min(initial=0))))
    return np.int32 if peak(anchors) * (peak(rows) + 1) * 2 * anchors.shape[1] < 2**31 else np.int64


def _blocks(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The anchors and the rows of a task; rows by ascending id, null ids last, so that earlier wins a tie."""
    anchors = pdf[pdf["is_anchor"]].reset_index(drop=True)
    return anchors, pdf[~pdf["is_anchor"]].sort_values("id", na_position="last").reset_index(drop=True)


class Best:
    """The best rows so far of each anchor of a tile: (anchor, score, place of the row), places ascending in time."""

    def __init__(self, anchors: int, keep: int):
        self.keep = keep
        self.anchor = np.zeros(0, dtype=np.int64)
        self.score = np.zeros(0, dtype=np.int64)
        self.place = np.zeros(0, dtype=np.int64)
        self.bar = np.full(anchors, np.iinfo(np.int64).min)  # a later row must score above it
        self.full = np.zeros(anchors, dtype=bool)

    def add(self, s: np.ndarray, allowed: np.ndarray, places: np.ndarray) -> None:
        hit = allowed & ((s > self.bar) | ~self.full)
        r, a = np.nonzero(hit)
        if not len(r):
            return
        anchor = np.concatenate([self.anchor, a])
        score = np.concatenate([self.score, s[r, a].astype(np.int64)])
        place = np.concatenate([self.place, places[r]])
        order = np.lexsort((place, ~score, anchor))  # ~ turns the order around without overflow
        anchor, score, place = anchor[order], score[order], place[order]
        first = np.flatnonzero(np.diff(anchor, prepend=-1))
        nth = np.arange(len(anchor)) - np.repeat(first, np.diff(np.append(first, len(anchor))))
        kept = nth < self.keep
        last = nth == self.keep - 1
        self.bar[anchor[last]], self.full[anchor[last]] = score[last], True
        self.anchor, self.score, self.place = anchor[kept], score[kept], place[kept]


OUT = "auid long, k int, score long, id long"


def _emit(best: Best, anchors: pd.DataFrame, k: int, ids: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"auid": anchors["uid"].to_numpy()[best.anchor], "k": np.int32(k), "score": best.score, "id": ids[best.place]})


def _positives(pdf: pd.DataFrame, keep: int) -> pd.DataFrame:
    """The best rows of an anchor's own label, itself left out, among the rows of one block."""
    anchors, rows = _blocks(pdf)
    width, out = _width(anchors, rows), []
    ids = rows["id"].astype("Int64").to_numpy(dtype=object, na_value=None)
    for label, own in anchors.groupby("label"):
        at = np.flatnonzero(rows["label"].to_numpy() == label)
        a_all, c_all = _matrix(own["q"], width), _matrix(rows["q"].iloc[at], width)
        kind, uid = _kind(a_all, c_all), rows["uid"].to_numpy()[at]
        planes = bit_planes(c_all)
        for lo in range(0, len(own), TILE):
            tile = own.iloc[lo : lo + TILE]
            tables, best = subset_sums(a_all[lo : lo + TILE].astype(kind)), Best(len(tile), keep)
            for c in range(0, len(at), CHUNK):
                s = scores(tables, planes[:, :, c : c + CHUNK])
                best.add(s, uid[c : c + CHUNK, None] != tile["uid"].to_numpy()[None, :], at[c : c + CHUNK])
            out.append(_emit(best, tile, 0, ids))
    return pd.concat(out) if out else pd.DataFrame(columns=["auid", "k", "score", "id"])


def _negatives(pdf: pd.DataFrame, keep: int, low: int, high: int) -> pd.DataFrame:
    """The best rows of other labels in the window of each of an anchor's positives, among the rows of one block."""
    anchors, rows = _blocks(pdf)
    width, out = _width(anchors, rows), []
    ids, label = rows["id"].astype("Int64").to_numpy(dtype=object, na_value=None), rows["label"].to_numpy()
    a_all, c_all = _matrix(anchors["q"], width), _matrix(rows["q"], width)
    kind, planes = _kind(a_all, c_all), bit_planes(c_all)
    for lo in range(0, len(anchors), TILE):
        tile = anchors.iloc[lo : lo + TILE]
        tables, own = subset_sums(a_all[lo : lo + TILE].astype(kind)), tile["label"].to_numpy()
        count = max((len(p) for p in tile["positives"]), default=0)
        # the smallest and largest score of each window; an empty one where there is no such positive
        floor, ceiling = np.full((count, len(tile)), 1), np.full((count, len(tile)), 0)
        for i, p in enumerate(tile["positives"]):
            for k, s in enumerate(p):
                floor[k, i], ceiling[k, i] = -(-int(s) * low // 100), int(s) * high // 100
        best = [Best(len(tile), keep) for _ in range(count)]
        for c in range(0, len(rows), CHUNK):
            s = scores(tables, planes[:, :, c : c + CHUNK])
            other, places = label[c : c + CHUNK, None] != own[None, :], np.arange(c, min(len(rows), c + CHUNK))
            for k in range(count):
                best[k].add(s, other & (s >= floor[k]) & (s <= ceiling[k]), places)
        out += [_emit(b, tile, k, ids) for k, b in enumerate(best)]
    return pd.concat(out) if out else pd.DataFrame(columns=["auid", "k", "score", "id"])


def _top(found: DataFrame, keep: int) -> DataFrame:
    """Ranked from 1 within each (anchor, k), at most `keep`; equal scores by smaller id, null ids last."""
    w = Window.partitionBy("auid", "k").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)


def mine(
    vectors: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str | Column = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE,
    row_block: int = ROW_BLOCK, anchor_block: int = ANCHOR_BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `anchors` picks the anchor rows.  Each is paired with its `positives` best rows of the same label, and each
    pair gets the `negatives` best rows of other labels with low % <= negative / positive score <= high %.
    Scores are exact integer inner products of the components floor(scale * x).

    Rows without a label or vector, or with a null or non-finite component, take no part.  Vectors of other
    lengths are compared as if ended by zeros; an empty one scores 0.  Each of repeated rows is a row of its
    own.  Null keys come last among equal scores.  A positive score of 0 or less leaves at most the score 0.
    An empty table gives no rows; columns with other names are ignored.
    """
    mark = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(F.col(key).cast("long").alias("id"), mark.cast("long").alias("label"), quantised(F.col(vector), scale).alias("q"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    rows = stage(rows.filter("label is not null and q is not null").withColumn("uid", F.monotonically_increasing_id()))
    n, m = rows.agg(F.count(F.lit(1)), F.count_if("anchor")).collect()[0]
    # at least 64 blocks of work on small tables, blocks of a bounded size on large ones
    row_parts = max(1, -(-n // max(min(row_block, 2048), min(row_block, n // 64))))
    anchor_parts = max(1, -(-m // anchor_block))
    place = lambda parts: F.pmod(F.xxhash64("uid"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    nothing = F.array().cast("array<long>")
    base = ["uid", "id", "label", "q"]
    spread = rows.select(*base, nothing.alias("positives"), F.lit(False).alias("is_anchor"), place(row_parts).alias("rb"), every(anchor_parts).alias("ab"))

    def grid(anchor_rows: DataFrame, task) -> DataFrame:
        met = anchor_rows.select(*base, "positives", F.lit(True).alias("is_anchor"), every(row_parts).alias("rb"), place(anchor_parts).alias("ab"))
        return met.unionByName(spread).groupBy("ab", "rb").applyInPandas(task, OUT)

    chosen = rows.filter("anchor")
    near = stage(_top(grid(chosen.withColumn("positives", nothing), lambda pdf: _positives(pdf, positives)), positives))
    windows = near.groupBy("auid").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("w"))
    windows = windows.select(F.col("auid").alias("uid"), F.col("w.score").alias("positives"))
    found = _top(grid(chosen.join(windows, "uid"), lambda pdf: _negatives(pdf, negatives, low, high)), negatives)
    pairs = near.select("auid", (F.col("rank") - 1).alias("k"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = chosen.select(F.col("uid").alias("auid"), F.col("id").alias("anchor_id"))
    out = found.select("auid", "k", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["auid", "k"]).join(named, "auid")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
