"""Language-model scores by deleted interpolation.

The probability of a word mixes maximum-likelihood estimates of every order, from the longest context down to
the uniform one: P_k = w * c(context, word) / c(context) + (1 - w) * P_(k-1), with a weight w for each order and
each bucket of context frequency (powers of two).  A part of the training documents, picked by the hash of their
text so that exact copies stay together, is deleted from the counts while expectation-maximisation learns the
weights on it; the scores then use the counts of all training documents.

Counting never shuffles a row for each token.  Documents are read once into chunks of a few megabytes, and a chunk
asks for each of its distinct n-grams once, as packed sorted 64-bit hashes; so a frequent word costs one entry a
chunk, however often it stands there.  Each hash range adds up what the chunks bring and answers every chunk with
the counts of the n-grams it asked for, in its order.  A chunk with its answers knows all counts of its documents.
What is gathered (counts, deleted events) grows with the corpus and stays distributed; the driver sees totals and weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.plans.staging import stage

ORDER = 2
DELETED = 8  # one training document in so many is deleted from the counts to learn the weights
ROUNDS = 12
CHUNK_BYTES, PART_BYTES, SLICE = 8 << 20, 16 << 20, 1 << 20
START, END = b"\n\n", b"\n"  # no word holds white space
SPACE = re.compile(rb"[\x20\x09-\x0D]")
BUCKETS = 65
LEAST, MOST = 1e-6, 1 - 1e-6


def pack(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes; sorted ones as differences."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def _mix(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """One hash for a context's hash followed by a word's."""
    x = context * np.uint64(0x9E3779B97F4A7C15) + word
    for factor in (0xD6E8FEB86659FD93, 0xD6E8FEB86659FD93):
        x ^= x >> np.uint64(32)
        x = x * np.uint64(factor)
    return x ^ (x >> np.uint64(32))


class Vocabulary(dict):
    """Words numbered in the order they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def words_of(text: bytes, size: int = SLICE) -> Iterator[list[bytes]]:
    """The words of a text, A-Z in lower case, in lists of about `size` bytes."""
    at = 0
    while len(text) - at > size:
        space = SPACE.search(text, at + size)
        if space is None:
            break
        yield text[at : space.start()].lower().split()
        at = space.start()
    yield text[at:].lower().split()


@dataclass
class Chunk:
    """Pieces of documents as word numbers; `lead` words before a piece are only its context."""

    tokens: list[np.ndarray] = field(default_factory=list)
    words: Vocabulary = field(default_factory=lambda: Vocabulary({START: 0, END: 1}))
    uid: list[int] = field(default_factory=list)
    ids: list = field(default_factory=list)
    train: list[bool] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    lead: list[int] = field(default_factory=list)
    bytes: int = 0

    def add(self, uid, key, train: bool, words: list[bytes], lead: int, last: bool, size: int) -> None:
        ids = np.fromiter(map(self.words.__getitem__, words), dtype=np.int32, count=len(words))
        if last:
            ids = np.append(ids, np.int32(1))
        self.tokens.append(ids)
        for to, v in ((self.uid, uid), (self.ids, key), (self.train, train), (self.sizes, len(ids)), (self.lead, lead)):
            to.append(v)
        self.bytes += size


def grams(tokens: np.ndarray, vocabulary: np.ndarray, sizes: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the n-grams that end at each token, for n = 1 .. order, and where pieces begin."""
    first = np.cumsum(sizes) - sizes
    word = vocabulary[tokens]
    out, before = [word], np.full(1, vocabulary[0])
    for _ in range(order - 1):
        context = np.roll(out[-1], 1)
        context[first] = before
        out.append(_mix(context, word))
        before = _mix(before, vocabulary[:1])
    return out, first


def hashes_of(words: Vocabulary) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def _counted(sizes: np.ndarray, lead: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which tokens belong to the piece itself."""
    return np.arange(int(sizes.sum())) - np.repeat(first, sizes) >= np.repeat(lead, sizes)


COLUMNS = ["ord", "part", "chunk", "deleted", "a", "b", "uid", "ids", "train", "sizes", "lead", "n", "m"]


def _row(**values) -> dict:
    return {c: values.get(c) for c in COLUMNS}


def _asks(chunk: Chunk, number: int, deleted: bool, order: int, parts: int) -> Iterator[dict]:
    """The chunk itself (ord 0), and for each order and hash range its distinct n-grams with their training counts."""
    tokens, sizes, lead = np.concatenate(chunk.tokens), np.array(chunk.sizes), np.array(chunk.lead)
    vocabulary = hashes_of(chunk.words)
    found, first = grams(tokens, vocabulary, sizes, order)
    weight = np.repeat(np.array(chunk.train), sizes) & _counted(sizes, lead, first)
    docs = int((np.array(chunk.train) & (lead == 0)).sum())
    yield _row(ord=0, part=number, chunk=number, deleted=deleted, a=pack(tokens), b=pack(vocabulary), uid=chunk.uid, ids=chunk.ids, train=chunk.train, sizes=chunk.sizes, lead=chunk.lead, n=int(weight.sum()), m=docs)
    limits = np.array([-(-(i << 64) // parts) for i in range(1, parts)], dtype=np.uint64)
    for k, g in enumerate(found, 1):
        keys, place = np.unique(g, return_inverse=True)
        count = np.bincount(place, weights=weight, minlength=len(keys)).astype(np.int64)
        cuts = np.concatenate([[0], np.searchsorted(keys, limits), [len(keys)]])
        for p in range(parts):
            lo, hi = cuts[p], cuts[p + 1]
            if hi > lo:
                yield _row(ord=k, part=p, chunk=number, deleted=deleted, a=pack_sorted(keys[lo:hi]), b=pack(count[lo:hi]))


def _answers(pdf: pd.DataFrame) -> pd.DataFrame:
    """Chunks as they are; for the asks of one hash range the counts of all training documents (a) and, for a
    deleted chunk, of those that are not deleted (b), and one row with the numbers of distinct n-grams."""
    order = int(pdf["ord"].iloc[0])
    if order == 0:
        return pdf
    keys = [unpack_sorted(a) for a in pdf["a"]]
    counts = [unpack(b, np.int64) for b in pdf["b"]]
    sizes = np.array([len(k) for k in keys])
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    gone = np.repeat(pdf["deleted"].to_numpy(dtype=bool), sizes)
    count = np.concatenate(counts)
    total = np.bincount(place, weights=count, minlength=len(distinct)).astype(np.int64)
    kept = np.bincount(place, weights=np.where(gone, 0, count), minlength=len(distinct)).astype(np.int64)
    out, at = [], 0
    for chunk, deleted, size in zip(pdf["chunk"], pdf["deleted"], sizes, strict=True):
        mine = place[at : at + size]
        at += size
        out.append(_row(ord=order, part=pdf["part"].iloc[0], chunk=chunk, deleted=deleted, a=pack(total[mine]), b=pack(kept[mine]) if deleted else None))
    out.append(_row(ord=order, part=pdf["part"].iloc[0], chunk=-1, deleted=False, n=int((total > 0).sum()), m=int((kept > 0).sum())))
    return pd.DataFrame(out, columns=COLUMNS)


def _counts(pdf: pd.DataFrame, order: int, column: str, docs: int):
    """A chunk with its answers: the chunk row, which tokens count, and for each order the counts of the
    n-grams that end at each token and of their contexts (`docs` where a document begins)."""
    chunk = pdf[pdf["ord"] == 0].iloc[0]
    sizes = np.array(chunk["sizes"])
    found, first = grams(unpack(chunk["a"], np.int32), unpack(chunk["b"], np.uint64), sizes, order)
    own = _counted(sizes, np.array(chunk["lead"]), first)
    count, context = [], [None]
    for k, g in enumerate(found, 1):
        answers = pdf[pdf["ord"] == k].sort_values("part")[column]
        _, place = np.unique(g, return_inverse=True)
        count.append(np.concatenate([unpack(a, np.int64) for a in answers])[place])
        before = np.roll(count[-1], 1)
        before[first] = docs
        context.append(before)
    return chunk, own, count, context[:-1]


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2 of its count)."""
    return np.frexp(context.astype(np.float64))[1]


def _estimates(count: list[np.ndarray], context: list, total: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Maximum-likelihood estimates of each order (0 in an unseen context) and the buckets of orders above 1."""
    ml = [count[0] / max(total, 1)]
    ml += [np.divide(c, x, out=np.zeros(len(c)), where=x > 0) for c, x in zip(count[1:], context[1:], strict=True)]
    return ml, [bucket(x) for x in context[1:]]


@dataclass(frozen=True)
class Model:
    """Weights by order and bucket, and the totals of the training documents."""

    weights: np.ndarray  # (order, BUCKETS); the single bucket of order 1 is 0
    tokens: int
    distinct: int
    docs: int

    def log10(self, count: list[np.ndarray], context: list) -> np.ndarray:
        ml, buckets = _estimates(count, context, self.tokens)
        w = self.weights[0, 0] if self.tokens else 0.0
        p = w * ml[0] + (1 - w) / (self.distinct + 1)
        for k, b in enumerate(buckets, 1):
            w = self.weights[k, b]
            p = w * ml[k] + (1 - w) * p
        return np.log10(p)


def starting_weights(order: int) -> np.ndarray:
    w = np.full((order, BUCKETS), 0.5)
    w[1:, 0] = 0.0  # an unseen context says nothing
    return w


def learn(events: DataFrame, order: int, distinct: int, rounds: int = ROUNDS) -> np.ndarray:
    """Expectation-maximisation over the deleted events (f1 .. fn estimates, b2 .. bn buckets, n occurrences).

    A round is one aggregation by buckets; buckets without events take the weight of the next lower one.
    """
    weights = starting_weights(order)
    keys = [f"b{k}" for k in range(2, order + 1)]
    for _ in range(rounds):
        table = lambda k: F.array(*[F.lit(float(x)) for x in weights[k - 1]])
        w = {k: F.get(table(k), F.col(f"b{k}")) if k > 1 else F.lit(float(weights[0, 0])) for k in range(1, order + 1)}
        rest, share = F.lit(1.0), {}
        for k in range(order, 0, -1):
            share[k] = rest * w[k] * F.col(f"f{k}")
            rest = rest * (1 - w[k])
        share[0] = rest / float(distinct + 1)
        e = events.select(*keys, "n", *[share[k].alias(f"s{k}") for k in range(order + 1)])
        mix = sum((F.col(f"s{k}") for k in range(1, order + 1)), F.col("s0"))
        sums = e.groupBy(*keys).agg(*[F.sum(F.col("n") * F.col(f"s{k}") / mix).alias(f"r{k}") for k in range(order + 1)]).collect()
        got, seen = np.zeros((order, BUCKETS)), np.zeros((order, BUCKETS))
        for r in sums:
            if r["r0"] is None:
                continue
            for k in range(1, order + 1):
                b = r[f"b{k}"] if k > 1 else 0
                got[k - 1, b] += r[f"r{k}"]
                seen[k - 1, b] += sum(r[f"r{j}"] for j in range(k + 1))
        new = starting_weights(order)
        for k in range(order):
            for b in range(1 if k else 0, BUCKETS if k else 1):
                if seen[k, b] > 0:
                    new[k, b] = min(MOST, max(LEAST, got[k, b] / seen[k, b]))
                elif b > 1:
                    new[k, b] = new[k, b - 1]
        moved, weights = np.abs(new - weights).max(), new
        if moved < 1e-4:
            break
    return weights


def score(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", order: int = ORDER, chunk_bytes: int = CHUNK_BYTES, part_bytes: int = PART_BYTES, slice_bytes: int = SLICE, rounds: int = ROUNDS) -> DataFrame:
    """Per document: key, held_out (not `train`), n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words between white space, A-Z in lower case, and one end.  `base_score` is the additive
    unigram baseline, `score` the log10 probability of the tokens under the interpolated model of `order`.  Words
    never seen share the mass of one unknown word.

    A null text is empty (one token), a null `train` means held out, a null key is kept; each of repeated rows
    is a document.  A document longer than a chunk is cut into pieces that keep their context.  Without training
    documents every probability is 1.  An empty table gives no rows.  Columns with other names are ignored.
    N-grams are told apart by 64-bit hashes.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).cast("string").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).collect()[0][0] or 0
    parts = max(1, -(-size // part_bytes))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = TaskContext.get().partitionId() << 36
        made = docs_seen = 0
        open_chunks = {False: Chunk(), True: Chunk()}

        def close(deleted: bool) -> pd.DataFrame:
            nonlocal made
            out = pd.DataFrame(list(_asks(open_chunks[deleted], base + made, deleted, order, parts)), columns=COLUMNS)
            made += 1
            open_chunks[deleted] = Chunk()
            return out

        for pdf in batches:
            for doc, body, use in zip(pdf["id"], pdf["text"], pdf["train"], strict=True):
                deleted = bool(use) and xxhash.xxh64_intdigest(body, 11) % DELETED == 0
                tail: list[bytes] = []
                lead = 0
                for words, last in with_last(words_of(body, slice_bytes)):
                    if not words and not last:
                        continue
                    open_chunks[deleted].add(base + docs_seen, doc, bool(use), tail + words, lead, last, min(len(body), slice_bytes))
                    tail = (tail + words)[-(order - 1) :] if order > 1 else []
                    lead = len(tail)
                    if open_chunks[deleted].bytes >= chunk_bytes:
                        yield close(deleted)
                docs_seen += 1
        for deleted in (False, True):
            if open_chunks[deleted].tokens:
                yield close(deleted)

    schema = "ord int, part long, chunk long, deleted boolean, a binary, b binary, uid array<long>, ids array<string>, train array<boolean>, sizes array<long>, lead array<int>, n long, m long"
    known = stage(rows.mapInPandas(read, schema).groupBy("ord", "part").applyInPandas(_answers, schema))
    is_chunk, is_sum = F.col("ord") == 0, (F.col("ord") == 1) & (F.col("chunk") == -1)
    whole = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    kept = is_chunk & ~F.col("deleted")
    t = known.agg(whole("n", is_chunk).alias("tokens"), whole("m", is_chunk).alias("docs"), whole("n", kept).alias("kept"), whole("m", kept).alias("kept_docs"), whole("n", is_sum).alias("words"), whole("m", is_sum).alias("kept_words")).collect()[0]

    def events(pdf: pd.DataFrame) -> pd.DataFrame:
        _, own, count, context = _counts(pdf, order, "b", t.kept_docs)
        seen = pd.DataFrame({f"c{k}": c[own] for k, c in enumerate(count)} | {f"x{k}": x[own] for k, x in enumerate(context) if k})
        seen = seen.groupby(list(seen.columns), sort=False).size().reset_index(name="n")
        ml, buckets = _estimates([seen[f"c{k}"].to_numpy() for k in range(order)], [None, *[seen[f"x{k}"].to_numpy() for k in range(1, order)]], t.kept)
        return pd.DataFrame({f"f{k}": f for k, f in enumerate(ml, 1)} | {f"b{k}": b for k, b in enumerate(buckets, 2)} | {"n": seen["n"]})

    names = "".join(f"f{k} double, " for k in range(1, order + 1)) + "".join(f"b{k} int, " for k in range(2, order + 1)) + "n long"
    met = stage(known.filter("deleted and chunk <> -1").groupBy("chunk").applyInPandas(events, names))
    model = Model(learn(met, order, t.kept_words, rounds), t.tokens, t.words, t.docs)

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        chunk, own, count, context = _counts(pdf, order, "a", model.docs)
        first = np.cumsum(chunk["sizes"]) - np.array(chunk["sizes"])
        add = lambda v: np.add.reduceat(np.where(own, v, 0), first)
        base = np.log10((count[0] + 0.5) / (model.tokens + 0.5 * (model.distinct + 1)))
        return pd.DataFrame({"uid": chunk["uid"], "id": chunk["ids"], "held_out": ~np.array(chunk["train"], dtype=bool), "n_tokens": add(1), "n_known": add(count[0] > 0), "base_score": add(base), "score": add(model.log10(count, context))})

    pieces = known.filter("chunk <> -1").groupBy("chunk").applyInPandas(apply, "uid long, id string, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    out = pieces.groupBy("uid").agg(F.first("id").cast(kind).alias(key), F.first("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return out.select(key, "held_out", "n_tokens", "n_known", F.lit(t.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def with_last(items: Iterator) -> Iterator[tuple]:
    """Each item and whether it is the last."""
    held = next(items)
    for item in items:
        yield held, False
        held = item
    yield held, True
