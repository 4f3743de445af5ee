"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A benchmark item of m bytes may occur with up to k edits.  Such an occurrence shares at least
m - q + 1 - k q of the item's q-grams, all on diagonals at most k apart.  So the filter counts shared q-grams of
a document and an item in overlapping bands of diagonals (a band is 2 k + 1 wide, the next begins k + 1 later, so that any
k + 1 neighbouring diagonals lie in one band); bands that reach the bound give regions, and a banded alignment of the
item against each region verifies it.  Texts are compared in lower case with runs of white space as one space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import whole_text

Q = 8
EDIT_RATE = 0.1
SLICE = 1 << 20
SPACE = re.compile(r"\s+")
MIX = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> bytes:
    return SPACE.sub(" ", (text or "").lower()).strip().encode()


def budget(m: int, q: int = Q, rate: float = EDIT_RATE) -> int:
    """Edits allowed in an item of m bytes: the rate, but no more than leave one q-gram to count (short items fewer)."""
    return max(0, min(int(rate * m), m // q - 1))


def grams(b: np.ndarray, q: int) -> np.ndarray:
    """The q-gram at every position as a number (q up to 8)."""
    n = max(0, len(b) - q + 1)
    code = np.zeros(n, dtype=np.uint64)
    for j in range(q):
        code <<= np.uint64(8)
        code |= b[j : j + n].astype(np.uint64)
    return code


def distance_within(item: bytes, region: bytes, k: int, lo: int, hi: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best occurrence of `item` in `region` with at most k edits whose diagonals are lo to hi.

    Columns of the band are updated together; starts are carried along.  Of equally good ends the first counts.
    """
    m, n = len(item), len(region)
    at = region.find(item)
    if at >= 0:
        return 0, at, at + m
    far = m + n + 1
    x = np.frombuffer(region, dtype=np.uint8)
    width = hi - lo + 1
    # cell d of row i is column i + lo + d of the region (number of region bytes used)
    col = lo + np.arange(width)
    cost = np.where((col >= 0) & (col <= n), 0, far)
    start = col.copy()
    steps = np.arange(width)
    for i in range(1, m + 1):
        col = i + lo + steps
        used = (col >= 1) & (col <= n)
        same = np.zeros(width, dtype=bool)
        same[used] = x[col[used] - 1] == item[i - 1]
        diag = np.where(used, cost + ~same, far)
        up_cost = np.concatenate((cost[1:], [far])) + 1  # the item's byte left out
        up_start = np.concatenate((start[1:], [0]))
        up_cost = np.where((col >= 0) & (col <= n), up_cost, far)
        take = up_cost < diag
        best, begin = np.where(take, up_cost, diag), np.where(take, up_start, start)
        # a region's byte left over: the least of earlier cells plus the distance to them
        level = best - steps
        least = np.minimum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == least, steps, 0))
        cost, start = np.minimum(least + steps, far), begin[source]
        cost = np.where((col >= 0) & (col <= n), cost, far)
        if cost.min() > k:
            return None
    end = int(cost.argmin())
    return (int(cost[end]), int(start[end]), int(m + lo + end)) if cost[end] <= k else None


@dataclass
class Benchmark:
    """All items' q-grams, sorted, with the item and the place of each."""

    ids: list
    texts: list[bytes]
    edits: np.ndarray
    bound: np.ndarray
    code: np.ndarray
    item: np.ndarray
    place: np.ndarray
    first: np.ndarray  # of each distinct gram its first row
    distinct: np.ndarray
    maybe: np.ndarray  # a bit for each hash that a gram has
    tiny: list[int]
    q: int
    kind: str = "long"  # type of the ids

    @classmethod
    def of(cls, ids: Sequence, texts: Sequence[str | None], q: int = Q, rate: float = EDIT_RATE, kind: str = "long") -> Benchmark:
        bodies = [normal(t) for t in texts]
        keep = [i for i, b in enumerate(bodies) if b]  # an empty item occurs nowhere
        ids, bodies = [ids[i] for i in keep], [bodies[i] for i in keep]
        codes = [grams(np.frombuffer(b, dtype=np.uint8), q) for b in bodies]
        code = np.concatenate([*codes, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        place = np.concatenate([*(np.arange(len(c)) for c in codes), np.zeros(0, np.int64)])
        order = np.argsort(code, kind="stable")
        code, item, place = code[order], item[order], place[order]
        distinct, first = np.unique(code, return_index=True)
        maybe = np.zeros(1 << 20, dtype=bool)
        maybe[(distinct * MIX) >> np.uint64(44)] = True
        edits = np.array([budget(len(b), q, rate) for b in bodies], dtype=np.int64)
        bound = np.array([len(b) - q + 1 - k * q for b, k in zip(bodies, edits, strict=True)], dtype=np.int64)
        tiny = [i for i, b in enumerate(bodies) if len(b) < q]
        return cls(ids, bodies, edits, bound, code, item, place, np.append(first, len(code)), distinct, maybe, tiny, q, kind)

    def regions(self, body: bytes) -> list[tuple[int, int, int]]:
        """(item, first and last diagonal) of the bands that reach their item's bound."""
        pairs = []
        for lo in range(0, max(1, len(body) - self.q + 1), SLICE):
            b = np.frombuffer(body, dtype=np.uint8)[lo : lo + SLICE + self.q - 1]
            code = grams(b, self.q)
            at = np.flatnonzero(self.maybe[(code * MIX) >> np.uint64(44)])
            if not len(at) or not len(self.distinct):
                continue
            row = np.minimum(np.searchsorted(self.distinct, code[at]), len(self.distinct) - 1)
            true = self.distinct[row] == code[at]
            at, row = at[true], row[true]
            many = self.first[row + 1] - self.first[row]
            source = np.repeat(self.first[row], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            pairs.append(np.stack([self.item[source], lo + np.repeat(at, many) - self.place[source], self.place[source]]))
        if not pairs:
            return []
        item, diagonal, place = np.concatenate(pairs, axis=1)
        if not len(item):
            return []
        k = self.edits[item]
        band = np.floor_divide(diagonal, k + 1)
        # a diagonal lies in the band that begins at its own multiple of k + 1 and in the one before
        item, band, place = np.concatenate([item, item]), np.concatenate([band, band - 1]), np.concatenate([place, place])
        order = np.lexsort((place, band, item))
        item, band, place = item[order], band[order], place[order]
        new_band = np.concatenate(([True], (item[1:] != item[:-1]) | (band[1:] != band[:-1])))
        # a place of the item counts once in a band, however often its gram occurs there
        once = new_band | np.concatenate(([True], place[1:] != place[:-1]))
        edge = np.flatnonzero(new_band)
        count = np.add.reduceat(once.astype(np.int64), edge)
        hit = edge[count >= self.bound[item[edge]]]
        return [(int(i), int(b * (self.edits[i] + 1)), int((b + 2) * (self.edits[i] + 1) - 1)) for i, b in zip(item[hit], band[hit], strict=True)]

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) of verified occurrences in the normalised text, one for each item and end."""
        body = normal(text)
        found = {}
        for i in self.tiny:
            at = body.find(self.texts[i])
            while at >= 0:
                found[i, at + len(self.texts[i])] = (i, at, at + len(self.texts[i]), 0)
                at = body.find(self.texts[i], at + 1)
        for i, lo, hi in self.regions(body):
            item, k = self.texts[i], int(self.edits[i])
            a, b = max(0, lo - k), min(len(body), hi + k + len(item))
            if a >= b:
                continue
            got = distance_within(item, body[a:b], k, lo - k - a, hi + k - a)
            if got:
                e, s, t = got
                old = found.get((i, a + t))
                if old is None or e < old[3]:
                    found[i, a + t] = (i, a + s, a + t, e)
        return sorted(found.values())


def load_benchmark(items: DataFrame, key: str = "item_id", text: str = "text", most_bytes: int = 8 << 20, **options) -> list[Benchmark]:
    """The index of a benchmark table, in as many shards of about `most_bytes` of text as its size asks for.

    Every task gets a copy of the shard it searches, and the documents are searched once for each shard.  Items without an
    id are searched like the others and reported with a null id.
    """
    kind = items.schema[key].dataType.simpleString()
    rows = items.select(F.col(key).alias("k"), whole_text(text).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t").cast("long"))).collect()[0][0] or 0
    shards = max(1, -(-size // most_bytes))
    out = []
    for i in range(shards):
        part = rows if shards == 1 else rows.filter(F.pmod(F.xxhash64("t"), F.lit(shards)) == i)
        got = sorted(((r.k, r.t) for r in part.collect()), key=lambda r: (r[0] is None, 0 if r[0] is None else r[0], r[1]))
        out.append(Benchmark.of([r[0] for r in got], [r[1] for r in got], kind=kind, **options))
    return out


FOUND = ("item_id", "match_start", "match_end", "edits")


def contaminated(docs: DataFrame, bench: Sequence[Benchmark], keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """One row for every kept row and occurrence: item_id, match_start, match_end (bytes of the normalised text), edits.

    Null and empty texts and items match nothing; the id of an item may be null or of any type.  Repeated rows and
    repeated items each give rows of their own.  Of equally good alignments in a band the first end counts.  An empty
    table on either side gives no rows.  Columns that are not kept are ignored; a kept one with the name of a result
    gets `doc_` before it.
    """
    return reduce(DataFrame.unionByName, [_contaminated(docs, b, keep, text) for b in bench])


def _contaminated(docs: DataFrame, bench: Benchmark, keep: Sequence[str], text: str) -> DataFrame:
    names = [f"doc_{c}" if c in FOUND else c for c in keep]
    body = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(text).alias("_body")).filter(F.col("_body").isNotNull())

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(j, bench.ids[i], s, e, d) for j, t in enumerate(pdf.pop("_body")) for i, s, e, d in bench.matches(t)]
            at = np.array([r[0] for r in rows], dtype=np.int64)
            out = pdf.iloc[at].reset_index(drop=True)
            yield out.assign(**{c: pd.Series([r[n] for r in rows], dtype=object if n == 1 else "int64") for n, c in enumerate(FOUND, 1)})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in body.drop("_body").schema)
    found = body.mapInPandas(apply, f"{schema}, item_id {bench.kind}, match_start long, match_end long, edits int")
    return found.toDF(*names, *FOUND)


def clean(docs: DataFrame, bench: Sequence[Benchmark], text: str = "text") -> DataFrame:
    """The documents, whole and with all their columns, in which no item occurs; null and empty texts stay."""
    columns = docs.columns
    for b in bench:
        docs = docs.mapInPandas(_without(b, text), docs.schema)
    return docs.select(*columns)


def _without(bench: Benchmark, text: str):
    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[not bench.matches(t) for t in pdf[text]]]

    return apply
