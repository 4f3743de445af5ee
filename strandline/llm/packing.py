"""Packing tokenized documents into sequences of fixed capacity, large documents first.

A document is its token ids and an end id; only documents longer than the capacity are cut, and only
their first piece may be shorter than the capacity.  Pieces of more than a third of the capacity are
matched greedily, two to a sequence at most; smaller pieces go to the gap that fits them best.  What is
packed is the histogram of piece lengths, which has at most `capacity` rows whatever the corpus: the
plan says how many sequences have which lengths, and Spark gives the pieces of a length, numbered without
gaps, to the places that the plan has for that length.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import numbered, staged_with_uid, whole_text

CAPACITY = 2048
END_ID = 0
SPECIAL = "<|endoftext|>"


class Encoder:
    """The ids of the byte-level vocabulary; one per Python worker."""

    _held: dict = {}

    def __init__(self, vocabulary: str, ranks: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        with open(ranks, "rb") as lines:
            pairs = [line.split() for line in lines]
        self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
        self.full = Tokenizer.from_file(vocabulary)

    @classmethod
    def of(cls, vocabulary: str, ranks: str) -> Encoder:
        key = vocabulary, ranks
        if key not in cls._held:
            cls._held[key] = cls(vocabulary, ranks)
        return cls._held[key]

    def ids(self, text: str) -> np.ndarray:
        """The same vocabulary in its faster form; a text with the special token's string goes to the full tokenizer."""
        if SPECIAL in text:
            return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(self.fast.encode_ordinary(text), dtype="<u4")


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


class Bins:
    """Open sequences by gap: for each gap, groups of (filled, count) with equal contents."""

    def __init__(self):
        self.by_gap: dict[int, list] = {}
        self.gaps: list[int] = []

    def add(self, gap: int, filled: tuple, count: int) -> None:
        if gap not in self.by_gap:
            self.by_gap[gap] = []
            insort(self.gaps, gap)
        self.by_gap[gap].append((filled, count))

    def tightest(self, size: int):
        """Takes out the group with the smallest gap of at least `size`: (gap, filled, count)."""
        i = bisect_left(self.gaps, size)
        if i == len(self.gaps):
            return None
        gap = self.gaps[i]
        filled, count = self.by_gap[gap].pop()
        if not self.by_gap[gap]:
            del self.by_gap[gap], self.gaps[i]
        return gap, filled, count


def plan_sequences(histogram: dict[int, int], capacity: int) -> list[tuple[tuple, int]]:
    """[(contents, count)]: contents are (length, how many) in order, count is the number of such sequences."""
    left = {size: n for size, n in histogram.items() if n}
    large = sorted(s for s in left if 3 * s > capacity)
    bins = Bins()
    while large:
        top = large[-1]
        fit = bisect_right(large, capacity - top) - 1
        mate = large[fit] if fit >= 0 else None
        if mate == top and left[top] == 1:
            mate = large[fit - 1] if fit > 0 else None
        if mate is None:
            bins.add(capacity - top, ((top, 1),), left.pop(top))
            large.pop()
            continue
        n = left[top] // 2 if mate == top else min(left[top], left[mate])
        bins.add(capacity - top - mate, ((top, 2),) if mate == top else ((top, 1), (mate, 1)), n)
        for size in (top, mate):
            left[size] -= n
        for size in {top, mate}:
            if not left[size]:
                del left[size]
                large.remove(size)
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[size]
        while n:
            gap, filled, count = bins.tightest(size) or (capacity, (), n)
            each = min(gap // size, n)
            used = min(count, n // each)
            bins.add(gap - each * size, (*filled, (size, each)), used)
            if filled and count > used:
                bins.add(gap, filled, count - used)
            n -= used * each
    return [group for gap in bins.gaps for group in bins.by_gap[gap]]


def places(plan: list[tuple[tuple, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, lo, hi, first sequence, offset, how many a sequence): where the pieces numbered lo to hi - 1 of a length go."""
    rows, taken, sequence = [], {}, 0
    for contents, count in plan:
        offset = 0
        for size, each in contents:
            lo = taken.get(size, 0)
            taken[size] = lo + each * count
            rows.append((size, lo, taken[size], sequence, offset, each))
            offset += size * each
        sequence += count
    return rows


def pieces(docs: DataFrame, vocabulary: str, ranks: str, capacity: int = CAPACITY, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of every document: key, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder.of(vocabulary, ranks)
        end = np.array([end_id], dtype="<u4")
        for pdf in batches:
            rows = []
            for i, t in enumerate(pdf["_text"]):
                ids = np.concatenate([encoder.ids(t), end])
                raw = memoryview(ids).cast("B")
                rows += [(i, j, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])) for j, (s, n) in enumerate(pieces_of(len(ids), capacity))]
            at = np.array(rows, dtype=np.int64).reshape(-1, 5)
            yield pd.DataFrame({key: pdf[key].to_numpy()[at[:, 0]], "piece": at[:, 1].astype(np.int32), "start": at[:, 2], "length": at[:, 3], "ids_crc32": at[:, 4]})

    body = docs.select(key, whole_text(text).alias("_text"))
    kind = docs.schema[key].dataType.simpleString()
    return body.mapInPandas(cut, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, vocabulary: str, ranks: str, capacity: int = CAPACITY, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end id alone.  Repeated rows are packed each for itself.  An empty table
    gives no rows.  Other columns are ignored.  Pieces as long as the capacity need no plan: each is a
    sequence of its own, numbered by its row id after the planned ones.
    """
    spark = docs.sparkSession
    cut = staged_with_uid(pieces(docs, vocabulary, ranks, capacity, end_id, key, text))
    full, part = cut.filter(F.col("length") == capacity), cut.filter(F.col("length") < capacity)
    histogram = {r["length"]: r["count"] for r in part.groupBy("length").count().collect()}
    plan = plan_sequences(histogram, capacity)
    schema = "length long, _lo long, _hi long, _first long, _offset long, _each long"
    where = F.broadcast(spark.createDataFrame(places(plan), schema))  # a few rows for each length below the capacity
    ranked = numbered(part, "length", "_rank")
    i = F.col("_rank") - F.col("_lo")
    placed = ranked.join(where, "length").filter("_rank >= _lo and _rank < _hi")
    placed = placed.withColumn("sequence_id", F.col("_first") + (i / F.col("_each")).cast("long")).withColumn("offset", F.col("_offset") + i % F.col("_each") * F.col("length"))
    planned = sum(n for _, n in plan)
    alone = full.withColumn("sequence_id", F.col("_uid") + planned).withColumn("offset", F.lit(0).cast("long"))
    columns = [key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return placed.select(*columns).unionByName(alone.select(*columns))
