"""Near copies by several fingerprints, verified on whole texts: for pairs down to a similarity of 0.8, which one fingerprint
and three bits mostly miss."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import components, id_text, positional, text_key, whole_text
from strandline.llm.simhash import CAPITALS, DISTANCE, SEED, SLICE, SPACE, links
from strandline.plans.staging import stage


def _shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """The hashes of all shingles in arrays of bounded size; nothing for a text without words."""
    body = SPACE.sub(b" ", (text or "").encode().translate(CAPITALS)).strip(b" ")
    if not body:
        return
    cuts = np.flatnonzero(np.frombuffer(body, dtype=np.uint8) == 32)
    starts = np.concatenate(([0], cuts + 1)).tolist()
    ends = np.concatenate((cuts, [len(body)])).tolist()
    n = max(1, len(starts) - words + 1)
    step = min(words, len(starts)) - 1
    h = xxhash.xxh64_intdigest
    for lo in range(0, n, SLICE):  # bounded memory for a very long text
        hi = min(n, lo + SLICE)
        yield np.array([h(body[a:b], SEED) for a, b in zip(starts[lo:hi], ends[lo + step : hi + step], strict=True)], dtype="<u8")


def _majority(hashes: Iterator[np.ndarray], mixes: Sequence[int]) -> list[int]:
    """For each multiplier the word whose bits more than half of the mixed hashes have."""
    set_bits, n = np.zeros((len(mixes), 64), dtype=np.int64), 0
    for part in hashes:
        n += len(part)
        for i, m in enumerate(mixes):
            x = part
            if m != 1:
                x = x * np.uint64(m)
                x = (x ^ (x >> np.uint64(29))) * np.uint64(m)
                x = x ^ (x >> np.uint64(32))
            set_bits[i] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * set_bits > n, axis=1, bitorder="little").view("<u8")[:, 0].tolist() if n else [0] * len(mixes)


def _chosen(docs: DataFrame, best: DataFrame, marked: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of the chosen (key, text) pairs, one of equal ones."""
    rows = marked.groupBy("_k", "_t").agg(F.count(F.lit(1)).alias("n"))
    kept = stage(best.distinct().join(rows, ["_k", "_t"]))
    named_docs = docs.withColumns({"_k": id_text(key), "_t": text_key(text)})
    once = named_docs.join(kept.filter("n = 1").select("_k", "_t"), ["_k", "_t"], "left_semi")
    more = kept.filter("n > 1").select("_k", "_t")
    if not more.isEmpty():
        once = once.unionByName(named_docs.join(more, ["_k", "_t"], "left_semi").dropDuplicates(["_k", "_t"]))
    return once.select(*docs.columns)


def jaccard(a: str, b: str, words: int) -> float:
    """Of the sets of shingles (a shorter text is one shingle); 1 for two texts without words."""
    x, y = (np.unique(np.concatenate([*_shingle_hashes(t, words), np.zeros(0, dtype="<u8")])) for t in (a, b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


MIXES = (1, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # the hash itself, and two independent remixes of it


def one_of_each_profile(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 2, distance: int = DISTANCE, mixes: Sequence[int] = MIXES, shared: int = 5, similarity: float = 0.8) -> DataFrame:
    """As `one_of_each`, by several independent fingerprints of each text: texts are linked where any of them differs in at
    most `distance` bits and the sets of `shared`-word shingles of the whole texts have a Jaccard similarity of `similarity`.

    Two texts of a given similarity have the same chance with each fingerprint, so more of them find more near copies
    at the same exact search.  Texts with equal fingerprints throughout are one node; an edge joins nodes
    that share or link a fingerprint.
    """
    columns = docs.columns
    docs, name = positional(docs)
    key, text = name[key], name[text]
    body = docs.select(id_text(key).alias("_k"), F.col(key).alias("_id"), text_key(text).alias("_t"), whole_text(text).alias("_text"))
    names = [f"f{i}" for i in range(len(mixes))]

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf.pop("_text")
            found = np.array([_majority(_shingle_hashes(t, words), mixes) for t in texts], dtype=np.uint64).reshape(len(texts), -1).astype(np.int64)
            yield pdf.assign(**{n: found[:, i] for i, n in enumerate(names)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in body.drop("_text").schema)
    marked = stage(body.mapInPandas(apply, f"{schema}, " + ", ".join(f"{n} long" for n in names)))
    nodes = stage(marked.select(*names).distinct().withColumn("node", F.monotonically_increasing_id()))
    edges = []
    for n in names:
        held = nodes.groupBy(F.col(n).alias("fp")).agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("c"))
        edges.append(nodes.join(held.filter("c > 1"), F.col(n) == F.col("fp")).filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")))
        pairs = stage(links(held.select("fp"), distance))
        ends = held.select("fp", "first")
        pairs = pairs.join(ends.toDF("a", "na"), "a").join(ends.toDF("b", "nb"), "b")
        edges.append(pairs.select(F.col("na").alias("a"), F.col("nb").alias("b")))
    edges = stage(reduce(DataFrame.unionByName, edges).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    speaks = marked.join(nodes, names).join(ends, "node").groupBy("node").agg(F.min(F.struct("_k", "_t")).alias("r")).select("node", "r._k", "r._t")
    texts = docs.select(id_text(key).alias("_k"), text_key(text).alias("_t"), whole_text(text).alias("_text")).join(speaks, ["_k", "_t"])
    texts = stage(texts.select("node", "_text").dropDuplicates(["node"]))
    met = edges.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            alike = [jaccard(x, y, shared) >= similarity for x, y in zip(pdf["ta"], pdf["tb"], strict=True)]
            yield pdf.loc[alike, ["a", "b"]]

    named = components(stage(met.mapInPandas(verify, "a long, b long")))
    named = nodes.join(named, "node", "left").withColumn("component", F.coalesce("component", "node")).drop("node")
    best = marked.join(named, names).groupBy("component").agg(F.min(F.struct("_id", "_k", "_t")).alias("b")).select("b._k", "b._t")
    return _chosen(docs, best, marked, key, text).toDF(*columns)
