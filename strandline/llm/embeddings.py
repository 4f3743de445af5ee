"""Near-duplicate vectors with a forest of random-projection trees.

Each tree splits the vectors again and again by their projection on a random direction, at the sparsest place near
the median of a bounded sample; vectors close to a boundary go to both sides, at every level.  A group of near
copies that every cut would go through is not split.  Vectors are compared within leaves only, in
blocks of double-precision products; a pair that shares several leaves is counted in the first of them.  The
work in a leaf is cut into tiles of two blocks, so no task holds a large leaf, and a tile returns counts and a
spanning set of links instead of pairs.  Equal vectors are one row from the start.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import components
from strandline.plans.staging import stage

COSINE = 0.95
TREES = 10
LEAF = 300
SAMPLE = 20_000
SPILL = 0.02
WINDOW = 0.06
CROWDED = 0.5
BLOCK = 1024
TILES = 4
MAX_BLOCK = 1 << 14
TREE = 48  # bits of a leaf's number below that of its tree
SEED = 11


@dataclass
class Forest:
    """For each tree a direction for each level, and for each level the nodes that are split, in order, and their thresholds.

    Nodes have the numbers of a heap: 1 is the root, 2 i and 2 i + 1 are the halves of i.  Only nodes that exist are
    kept, at most one for each sampled vector and level, however many levels the rows ask for.
    """

    directions: np.ndarray  # (trees, levels, dimensions)
    thresholds: list[list[tuple[np.ndarray, np.ndarray]]]

    def leaves(self, x: np.ndarray, spill: float = SPILL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vector, tree, leaf), a row for every leaf that a vector is in: one within `spill` of a boundary goes to both sides."""
        out = []
        for t, axes in enumerate(self.directions):
            proj = x @ axes.T
            who, node = np.arange(len(x)), np.ones(len(x), dtype=np.int64)
            for level, (split, cuts) in enumerate(self.thresholds[t]):
                if not len(split):
                    break
                at = np.minimum(np.searchsorted(split, node), len(split) - 1)
                cut = np.where(split[at] == node, cuts[at], np.nan)
                gap = proj[who, level] - cut
                both = np.abs(gap) < spill
                right = (gap > 0).astype(np.int64)
                other = 2 * node[both] + 1 - right[both]
                node = np.where(np.isnan(cut), node, 2 * node + right)
                who, node = np.concatenate([who, who[both]]), np.concatenate([node, other])
            out.append((who, np.full(len(who), t, dtype=np.int64), node))
        who, tree, node = (np.concatenate(c) for c in zip(*out, strict=True))
        return who, tree, node


def _cut(v: np.ndarray, window: float, crowded: float) -> float:
    """Where to split sorted projections: the sparsest place near the median, or farther out; NaN if everywhere more
    than the share `crowded` of them lies within `window` of it, as in a group of near copies.
    """
    n = len(v)
    for part in (0.35, 0.125):
        k = np.arange(int(part * n), max(int(part * n) + 1, int((1 - part) * n)))
        k = k[k + 1 < n]
        c = (v[k] + v[k + 1]) / 2
        within = np.searchsorted(v, c + window) - np.searchsorted(v, c - window)
        if len(k) and within.min() <= crowded * n:
            best = np.flatnonzero(within == within.min())
            return float(c[best[np.abs(k[best] - n / 2).argmin()]])
    return np.nan


def grow(sample: np.ndarray, rows: int, trees: int = TREES, leaf: int = LEAF, seed: int = SEED, window: float = WINDOW, crowded: float = CROWDED) -> Forest:
    """Trees whose leaves hold about `leaf` of `rows` vectors, or more where no cut spares a dense group.

    A node that has no more than one sampled vector is not split.
    """
    rng = np.random.default_rng(seed)
    levels = max(0, int(np.ceil(np.log2(max(1, rows) / leaf))))
    levels += levels // 2  # uneven cuts
    directions = rng.normal(size=(trees, levels, sample.shape[1]))
    directions /= np.maximum(np.linalg.norm(directions, axis=2, keepdims=True), 1e-12)
    enough = max(1.0, leaf * len(sample) / max(1, rows))
    thresholds = []
    for axes in directions:
        proj, node, cuts = sample @ axes.T, np.ones(len(sample), dtype=np.int64), []
        for level in range(levels):
            here = np.flatnonzero(node >= 1 << level)
            order = here[np.lexsort((proj[here, level], node[here]))]
            edges = np.flatnonzero(np.diff(node[order], prepend=0, append=0))
            split, cut = [], []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                c = _cut(proj[order[lo:hi], level], window, crowded) if hi - lo > enough else np.nan
                if not np.isnan(c):
                    split.append(node[order[lo]])
                    cut.append(c)
                    some = order[lo:hi]
                    node[some] = 2 * node[some] + (proj[some, level] > c)
            cuts.append((np.array(split, dtype=np.int64), np.array(cut)))
        thresholds.append(cuts)
    return Forest(directions, thresholds)


def _matrix(arrays: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in arrays]) if len(arrays) else np.zeros((0, 1))


def _before(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of rows of padded leaf lists: whether they have a leaf in common."""
    met = np.zeros(len(a), dtype=bool)
    for c in range(a.shape[1]):
        met |= ((a[:, c, None] == b) & (a[:, c, None] >= 0)).any(axis=1)
    return met


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same for every list of `a` and every list of `b`, as a matrix."""
    codes, met = np.intersect1d(a[a >= 0], b[b >= 0]), np.zeros((len(a), len(b)), dtype=bool)

    def held(lists: np.ndarray, part: np.ndarray) -> np.ndarray:
        k = np.minimum(np.searchsorted(part, lists), len(part) - 1)
        row, col = np.nonzero(part[k] == lists)
        out = np.zeros((len(lists), len(part)), dtype=np.float32)
        out[row, k[row, col]] = 1
        return out

    for lo in range(0, len(codes), 512):
        met |= held(a, codes[lo : lo + 512]) @ held(b, codes[lo : lo + 512]).T > 0
    return met


def _padded(lists: Sequence[np.ndarray], code: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct lists of leaves before `code`, padded with -1, and which of them each row has."""
    width = max(1, max(len(s) for s in lists))
    held = np.full((len(lists), width), -1, dtype=np.int64)
    for k, s in enumerate(lists):
        s = np.sort(np.asarray(s, dtype=np.int64))
        s = s[s < code]
        held[k, : len(s)] = s
    held = held[:, : max(1, int((held >= 0).sum(axis=1).max()))]
    distinct, which = np.unique(held, axis=0, return_inverse=True)
    return distinct, which.ravel()


def _tile(pdf: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links of one tile: rows (vid, links, to), counts of linked vectors and one link for each row that has any.

    A pair counts in the first leaf that it shares.  Vectors of a dense group mostly have the same leaves, so pairs of
    leaf lists are compared instead of pairs of vectors where they are fewer.
    """
    pdf = pdf.sort_values("vid", ignore_index=True)
    code, i, j = (int(pdf[c].iloc[0]) for c in ("code", "i", "j"))
    x, vid, m = _matrix(pdf["unit"]), pdf["vid"].to_numpy(), pdf["m"].to_numpy()
    lists, which = _padded(pdf["leaves"].tolist(), code)
    left = np.flatnonzero(pdf["block"].to_numpy() == i)
    right = left if i == j else np.flatnonzero(pdf["block"].to_numpy() == j)
    links, to = np.zeros(len(pdf), dtype=np.int64), [[] for _ in range(2)]
    label = np.arange(len(pdf))
    kinds_right, kind_right = np.unique(which[right], return_inverse=True)
    xr = np.ascontiguousarray(x[right].T)
    for lo in range(0, len(left), 256):
        rows = left[lo : lo + 256]
        kinds, kind = np.unique(which[rows], return_inverse=True)
        few = 16 * len(kinds) * len(kinds_right) <= len(rows) * len(right)
        old = _common(lists[kinds], lists[kinds_right]) if few else None
        if few and old.all():
            continue
        hit = x[rows] @ xr >= cosine
        if i == j:
            hit &= rows[:, None] < right
        if few or 50 * np.count_nonzero(hit) > hit.size:
            old = _common(lists[kinds], lists[kinds_right]) if old is None else old
            hit &= ~old[kind[:, None], kind_right]
        else:
            a, b = np.nonzero(hit)
            for k in range(0, len(a), 65536):
                p, q = a[k : k + 65536], b[k : k + 65536]
                hit[p, q] = ~_before(lists[which[rows[p]]], lists[which[right[q]]])
        if not hit.any():
            continue
        links[rows] += hit @ m[right]
        links[right] += m[rows] @ hit
        for r in np.flatnonzero(hit.any(axis=1)):
            ends = right[hit[r]]
            own = label[rows[r]]
            ends = ends[label[ends] != own]
            if len(ends):
                met, first = np.unique(label[ends], return_index=True)
                label[np.isin(label, met)] = own
                to[0] += [vid[rows[r]]] * len(met)
                to[1] += vid[ends[first]].tolist()
    some = np.flatnonzero(links)
    counts = pd.DataFrame({"a": vid[some], "b": vid[some], "links": links[some]})
    return pd.concat([counts, pd.DataFrame({"a": to[0], "b": to[1], "links": np.zeros(len(to[0]), dtype=np.int64)})], ignore_index=True).astype("int64")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """Per vector: key, n_links (other vectors linked to it), component_id (smallest key it reaches), kept.

    Null vectors, empty and zero vectors and vectors with null or non-finite components link with nothing, nor do
    vectors of different lengths with each other.  Each of repeated rows is a vector of its own; a null key names a
    component only if it has no other.  An empty table gives no rows.  Other columns are ignored.  The trees of each length
    are grown on at most `sample` vectors; every vector is indexed.
    """
    v = F.col(vector)
    rows = vectors.select(F.col(key), v.cast("array<double>").alias("v"))
    v = F.col("v")
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, e: s + e * e))
    top = F.aggregate(v, F.lit(0.0), lambda s, e: F.greatest(s, F.abs(e)))
    # scaled by the largest component first, so that squares neither vanish nor overflow
    rows = rows.withColumn("v", F.when(F.coalesce(finite & (F.size(v) > 0), F.lit(False)), v))
    rows = rows.withColumn("v", F.when(top > 0, F.transform(v, lambda e: e / top)))
    rows = rows.withColumn("v", F.transform(v, lambda e: e / norm))
    rows = rows.withColumn("hash", F.when(v.isNotNull(), F.unhex(F.md5(F.to_json(F.struct("v")).cast("binary")))))
    rows = stage(rows)
    lengths = [r["d"] for r in rows.filter("v is not null").groupBy(F.size("v").alias("d")).count().orderBy("d").collect()]
    alone = rows.filter("v is null").select(key, F.lit(0).cast("long").alias("n_links"), F.col(key).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    parts = [_linked(rows.filter(F.size("v") == d), key, d, cosine, trees, leaf, sample, seed) for d in lengths]
    return reduce(DataFrame.unionByName, parts, alone.withColumn("kept", F.col(key).isNotNull()))


def _linked(rows: DataFrame, key: str, length: int, cosine: float, trees: int, leaf: int, sample: int, seed: int) -> DataFrame:
    """The unit vectors of one length with their links."""
    distinct = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("m"), F.min(key).alias("low"), F.first("v").alias("unit"))
    distinct = stage(distinct.withColumn("vid", F.monotonically_increasing_id()))
    n = distinct.count()
    picked = distinct.filter(F.pmod(F.xxhash64("hash"), F.lit(1 << 30)) < int(min(1.0, 1.05 * sample / max(1, n)) * (1 << 30)) + 1).select("unit").limit(sample).toPandas()
    forest = grow(_matrix(picked["unit"]) if len(picked) else np.zeros((1, length)), n, trees, leaf, seed)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 1000):
                part = pdf.iloc[lo : lo + 1000]
                who, tree, node = forest.leaves(_matrix(part["unit"]))
                yield pd.DataFrame({"vid": part["vid"].to_numpy()[who], "code": (tree << TREE) | node})

    placed = stage(distinct.select("vid", "unit").mapInPandas(index, "vid long, code long"))
    # a leaf of a dense group may be large: its blocks grow with it up to what a task can hold
    sizes = placed.groupBy("code").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    block = F.least(F.greatest(F.ceil(F.col("size") / TILES), F.lit(BLOCK)), F.greatest(F.lit(MAX_BLOCK), F.lit(BLOCK)))
    sizes = stage(sizes.withColumn("blocks", F.ceil(F.col("size") / block).cast("int")))
    home = placed.join(sizes, "code").withColumn("block", F.pmod(F.xxhash64("vid"), F.col("blocks")).cast("int"))
    tiles = home.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("vid", "code", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    sets = placed.groupBy("vid").agg(F.collect_list("code").alias("leaves"))
    full = stage(distinct.select("vid", "unit", "m").join(sets, "vid"))
    found = tiles.join(full, "vid").groupBy("code", "i", "j").applyInPandas(lambda pdf: _tile(pdf, cosine), "a long, b long, links long")
    found = stage(found)
    counts = found.groupBy(F.col("a").alias("vid")).agg(F.sum("links").alias("links"))
    names = components(found.filter("a <> b").select("a", "b")).withColumnRenamed("node", "vid")
    known = distinct.select("hash", "vid", "m", "low").join(names, "vid", "left").withColumn("component", F.coalesce("component", "vid"))
    least = known.groupBy("component").agg(F.min("low").alias("component_id"))
    known = stage(known.join(least, "component").join(counts, "vid", "left").select("hash", "component_id", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    out = rows.select(key, "hash").join(known, "hash", "left")
    component = F.coalesce(F.col("component_id"), F.col(key)).cast("long")
    return out.select(key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col(key) == component, F.lit(False)).alias("kept"))
