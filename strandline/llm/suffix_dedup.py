"""Exact-substring removal by a depth-limited radix sort of suffixes.

Every string of `threshold` bytes that starts at two or more places, in one text or in several, is removed at all
of them.  The suffixes at those places are ordered only through `threshold` bytes: groups that stay
together over the whole depth are exactly the repeated strings.  Three things keep the sort small:

* Runs.  Neighbouring suffixes are sorted as one run while they share their digits.  A run belongs to an
  anchor: the smallest of the (threshold - width + 1)-byte grams in a string of `threshold` bytes, for
  `width` grams.  Equal strings have equal grams and so the same anchor at the same offset, so runs
  correspond; about two anchors are found in `width` bytes.
* Passes.  The first digit of a run is its anchor gram; runs alone in their group leave.  The next pass
  compares a whole neighbourhood: what is equal there is repeated as a whole and leaves too.  What remains, mostly
  ends of repeated passages, is split into shorter runs, each with a longer digit, down to single suffixes.
* Counts.  A group is a row with a count, summed before the shuffle; its members are never brought together, and equal
  neighbourhoods go on as one row with their number.

Repeated strings of words take the same passes with words as symbols: all lengths and places are then in words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import positional, text_key, whole_text
from strandline.plans.staging import stage, staged_scope

THRESHOLD = 400
RADICES = (4, 8, 8)
WORD_RADICES = (5, 8)
SEGMENT = 1 << 17
POSITION = np.uint64((1 << 24) - 1)
MIX = np.uint64(0x9E3779B97F4A7C15)
HEAD = 8
WORD_HEAD = 3
TOKEN = 8
SLICE_BYTES = 8 << 20
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class Shape:
    """threshold = gram + width - 1, with a width that the radices divide into single suffixes.

    All are numbers of symbols of `unit` bytes: bytes (1) or the tokens of words (TOKEN).  Of equal smallest grams
    within `near` symbols of a string's start the last counts.
    """

    def __init__(self, threshold: int, radices: Sequence[int], unit: int = 1):
        self.threshold, self.radices, self.unit = threshold, tuple(radices), unit
        self.width = int(np.prod(self.radices))
        self.gram = threshold - self.width + 1
        self.near = max(1, self.width // 8)
        if self.gram < (HEAD if unit == 1 else WORD_HEAD):
            raise ValueError("the radices leave no room for an anchor gram")

    def heads(self, body: bytes, lo: int, hi: int) -> np.ndarray:
        """64 bits for each symbol of body[lo:hi] with enough after it: its HEAD bytes, or WORD_HEAD words mixed."""
        if self.unit == 1:
            b = np.frombuffer(body, dtype=np.uint8, count=hi - lo, offset=lo).astype(np.uint64)
            b = b[:-1] | (b[1:] << np.uint64(8))
            b = b[:-2] | (b[2:] << np.uint64(16))
            return b[:-4] | (b[4:] << np.uint64(32))
        w = np.frombuffer(body, dtype=np.uint64, count=hi - lo, offset=lo * TOKEN)
        return (w[:-2] * MIX + w[1:-1]) * MIX + w[2:]


def _smallest(v: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every `w` neighbours, from running minima ahead and behind in blocks of `w`."""
    m = len(v)
    blocks = np.full(-(-m // w) * w, ~np.uint64(0))
    blocks[:m] = v
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: m - w + 1], ahead[w - 1 : m])


def anchors(body: bytes, lengths: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the smallest gram of every string of `threshold` symbols, and how far before them the strings start
    (least and most).  `body` holds texts of the given lengths one after the other; no string crosses from one to the next.

    Of equal ones the first; but the last if the first is within `near` symbols of the string's start, as in a
    stretch of repeated words that began before: else the anchors of such stretches would slide along with the string.
    """
    t, w = shape.threshold, shape.width
    n = int(lengths.sum())
    long = lengths >= t
    opens = (np.cumsum(lengths) - lengths)[long]
    within = np.zeros(n + 1, dtype=np.int8)  # 1 where a string of one text starts
    within[opens] += 1
    within[opens + lengths[long] - t + 1] -= 1
    within = np.cumsum(within, dtype=np.int8).view(bool)
    runs = []  # (anchor, first string, last string)
    for lo in range(0, n - t + 1, SEGMENT):
        hi = min(n, lo + SEGMENT + t - 1)
        starts = np.flatnonzero(within[lo : hi - t + 1])
        if not len(starts):
            continue
        m = hi - lo - shape.gram + 1
        v = shape.heads(body, lo, hi)[:m] * MIX
        v ^= v >> np.uint64(29)
        v *= MIX
        v &= ~POSITION
        at = np.arange(m, dtype=np.uint64)
        first = (_smallest(v | at, w) & POSITION).astype(np.int64)[starts]
        last = (POSITION - (_smallest(v | (POSITION - at), w) & POSITION)).astype(np.int64)[starts]
        chosen = np.where(first - starts < shape.near, last, first)
        cut = np.flatnonzero(chosen[1:] != chosen[:-1]) + 1
        begin, end = starts[np.concatenate(([0], cut))], starts[np.concatenate((cut, [len(chosen)])) - 1]
        runs.append(lo + np.stack([chosen[np.concatenate(([0], cut))], begin, end]))
    if not runs:
        return (np.zeros(0, np.int64),) * 3
    x, begin, end = np.concatenate(runs, axis=1)
    at, inverse = np.unique(x, return_inverse=True)
    low, high = at.copy(), at - n
    np.minimum.at(low, inverse, x - end)
    np.maximum.at(high, inverse, x - begin)
    return at, low, high


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def _slices(batches: Iterator[pd.DataFrame], text: str = "_text") -> Iterator[pd.DataFrame]:
    """The rows in frames of about SLICE_BYTES characters of text, so that what is made of them stays small too."""
    for pdf in batches:
        ends = np.cumsum(pdf[text].str.len().to_numpy(dtype=np.int64)) // SLICE_BYTES
        for _, part in pdf.groupby(ends, sort=False):
            yield part.reset_index(drop=True)


def _first_digits(docs: DataFrame, text: str, shape: Shape, view: Callable[[str], bytes], least: int) -> DataFrame:
    """A row for every anchor: text key, position, gram hash, hash and reach of its neighbourhood.

    `view` gives the string to sort of a text; texts under `least` bytes have none of the threshold's length.
    """
    t, g, u = shape.threshold, shape.gram, shape.unit
    body = docs.select(text_key(text).alias("tkey"), whole_text(text).alias("_text")).filter(F.octet_length("_text") >= least)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_64_intdigest
        for pdf in _slices(batches):
            bodies = [view(x) for x in pdf["_text"]]
            lengths = np.array([len(b) // u for b in bodies], dtype=np.int64)
            joined = b"".join(bodies)
            del bodies
            at, low, left = anchors(joined, lengths, shape)
            right = t - low
            begins = np.cumsum(lengths) - lengths
            doc = np.searchsorted(begins, at, side="right") - 1
            gram = [digest(joined[x : x + g * u]) for x in (at * u).tolist()]
            hood = [digest(joined[a:b]) for a, b in zip(((at - left) * u).tolist(), ((at + right) * u).tolist(), strict=True)]
            yield pd.DataFrame({
                "tkey": pdf["tkey"].to_numpy()[doc], "pos": at - begins[doc], "h": _signed(gram), "s": _signed(hood),
                "l": left.astype(np.int32), "r": right.astype(np.int32),
            })

    return body.mapInPandas(apply, "tkey binary, pos long, h long, s long, l int, r int")


def _neighbourhoods(docs: DataFrame, wanted: DataFrame, text: str, view: Callable[[str], bytes], unit: int) -> DataFrame:
    """The symbols around each wanted anchor, once for each (tkey, pos)."""
    lists = stage(wanted.groupBy("tkey").agg(F.collect_list(F.struct("pos", "h", "l", "r", "m")).alias("at")))
    body = docs.select(text_key(text).alias("tkey"), whole_text(text).alias("_text"))

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _slices(batches):
            rows = []
            for key, text, at in zip(pdf["tkey"], pdf["_text"], pdf["at"], strict=True):
                body = view(text)
                rows += [(key, a["pos"], a["h"], a["l"], a["r"], a["m"], body[(a["pos"] - a["l"]) * unit : (a["pos"] + a["r"]) * unit]) for a in at]
            yield pd.DataFrame(rows, columns=["tkey", "pos", "h", "l", "r", "m", "hood"])

    cut = body.join(lists, "tkey").mapInPandas(apply, "tkey binary, pos long, h long, l int, r int, m long, hood binary")
    return cut.dropDuplicates(["tkey", "pos"])


def _digits(hoods: DataFrame, parent: int, size: int, threshold: int, unit: int) -> DataFrame:
    """Splits open runs of `parent` suffixes (all of them if there is no column `open`) into runs of `size`.

    `core` hashes the symbols that all suffixes of a run share, `span` those that any of them has; lo and hi
    bound the offsets that lie in the text.
    """
    columns = hoods.columns

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_64_intdigest
        for pdf in batches:
            rows, core, span = [], [], []
            opened = pdf["open"] if "open" in columns else [None] * len(pdf)
            for i, (x, r, hood, runs) in enumerate(zip(pdf["l"], pdf["r"], pdf["hood"], opened, strict=True)):
                least = threshold - r  # offsets of the suffixes: least to x
                for start in [0] if runs is None else runs:
                    for lo in range(start, start + parent, size):
                        hi = lo + size - 1
                        a, b = max(lo, least), min(hi, x)
                        if a <= b:
                            rows.append((i, lo, a, b))
                            core.append(digest(hood[(x - lo) * unit : (x + threshold - hi) * unit]))
                            span.append(digest(hood[(x - b) * unit : (x + threshold - a) * unit]))
            at = np.array(rows, dtype=np.int32).reshape(-1, 4)
            from_row = at[:, 0]
            yield pd.DataFrame({
                "tkey": pdf["tkey"].to_numpy()[from_row], "pos": pdf["pos"].to_numpy()[from_row], "h": pdf["h"].to_numpy()[from_row],
                "m": pdf["m"].to_numpy()[from_row], "run": at[:, 1], "lo": at[:, 2], "hi": at[:, 3], "core": _signed(core), "span": _signed(span),
            })

    return hoods.mapInPandas(apply, "tkey binary, pos long, h long, m long, run int, lo int, hi int, core long, span long")


def repeats(docs: DataFrame, threshold: int = THRESHOLD, radices: Sequence[int] = RADICES, text: str = "text") -> DataFrame:
    """(tkey, spans): for each distinct text with repeated strings, spans (a, b) that together cover them."""
    with staged_scope(docs.sparkSession):
        return _repeats(docs, Shape(threshold, radices), text, str.encode, threshold)


def _repeats(docs: DataFrame, shape: Shape, text: str, view: Callable[[str], bytes], least: int) -> DataFrame:
    t, u = shape.threshold, shape.unit
    first = stage(_first_digits(docs, text, shape, view, least))
    grams = stage(first.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"))
    second = stage(first.join(grams, "h", "left_semi"))
    keys = ["h", "s", "l", "r"]
    groups = stage(second.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("tkey", "pos")).alias("at")))
    whole = stage(groups.filter("m > 1").select(*keys))
    done = [second.join(whole, keys, "left_semi").select("tkey", (F.col("pos") - F.col("l")).alias("a"), (F.col("pos") + F.col("r")).alias("b"))]
    open_grams = stage(groups.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("least")).filter("n > 1 and least = 1").select("h"))
    wanted = groups.join(open_grams, "h", "left_semi").select("at.tkey", "at.pos", "h", "l", "r", "m")
    hoods = stage(_neighbourhoods(docs, wanted, text, view, u))
    parent, rows = shape.width, hoods
    for radix in shape.radices:
        size = parent // radix
        runs = stage(_digits(rows, parent, size, t, u))
        together = ["h", "run", "lo", "hi", "span"]
        alike = stage(runs.groupBy(*together).agg(F.sum("m").alias("n")).filter("n > 1").select(*together, F.lit(True).alias("same")))
        runs = stage(runs.join(alike, together, "left"))
        settled = runs.filter("m = 1 and same")
        done.append(settled.select("tkey", (F.col("pos") - F.col("hi")).alias("a"), (F.col("pos") - F.col("lo") + t).alias("b")))
        if size > 1:
            cores = ["h", "run", "core"]
            unsettled = F.max(F.when(F.col("same") | (F.col("m") > 1), 0).otherwise(1))
            some = stage(runs.groupBy(*cores).agg(F.sum("m").alias("n"), unsettled.alias("u")).filter("n > 1 and u = 1").select(*cores))
            # runs that have their answer go on as partners of the others
            left = runs.join(some, cores, "left_semi")
            lists = stage(left.groupBy("tkey", "pos").agg(F.collect_set("run").alias("open")))
            rows = hoods.join(lists, ["tkey", "pos"])
        parent = size
    spans = reduce(DataFrame.unionByName, done)
    return stage(spans.groupBy("tkey").agg(F.collect_set(F.struct("a", "b")).alias("spans")), outer=True)


def word_tokens(text: str) -> bytes:
    """A token of 8 bytes for every word, its hash."""
    words = text.encode().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words)).tobytes()


def word_repeats(docs: DataFrame, words: int, radices: Sequence[int] = WORD_RADICES, text: str = "text") -> DataFrame:
    """(tkey, places): for each distinct text with repeated strings of `words` words, spans (a, b) of words that cover them.

    Words are told apart by 64-bit hashes; what separates them is not compared.
    """
    with staged_scope(docs.sparkSession):
        return _repeats(docs, Shape(words, radices, TOKEN), text, word_tokens, 2 * words - 1).withColumnRenamed("spans", "places")


def merged(spans: Sequence) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, keep: Sequence[str] = ("doc_id",), threshold: int = THRESHOLD, radices: Sequence[int] = RADICES, text: str = "text", with_text: bool = False, words: int | None = None, counted: int | None = None, word_radices: Sequence[int] = WORD_RADICES) -> DataFrame:
    """The kept columns with n_bytes, n_removed, n_spans, kept_sha256 of every text and, if asked for, `kept_text`.

    A null text counts as empty.  Copies are removed at every place, the first included; repeated rows are copies of
    each other.  In `kept_text` characters that a removed span cut in two are left out.  An empty table
    gives no rows.  Columns that are not kept are ignored, so their names cannot clash.
    With `words`, strings of so many words that start at two or more places go too, however few bytes they have.
    With `counted`, such strings are reported and stay: n_words_repeated words are in them, in n_word_spans maximal runs.
    """
    found = repeats(docs, threshold, radices, text)
    body = docs.select(*keep, text_key(text).alias("_tkey"), whole_text(text).alias("_text"))
    joined = body.join(found.withColumnRenamed("tkey", "_tkey"), "_tkey", "left").withColumnRenamed("spans", "_spans")
    for name, size in (("_places", words), ("_counted", counted)):
        if size:
            joined = joined.join(word_repeats(docs, size, word_radices, text).toDF("_tkey", name), "_tkey", "left")
    joined = joined.select(*keep, "_text", "_spans", *(["_places"] if words else []), *(["_counted"] if counted else []))

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _slices(batches):
            texts, spans = pdf.pop("_text"), pdf.pop("_spans")
            places = pdf.pop("_places") if words else [None] * len(texts)
            passages = [merged(s) if s is not None else [] for s in pdf.pop("_counted")] if counted else []
            rows = []
            for t, s, w in zip(texts, spans, places, strict=True):
                body = t.encode()
                s = [] if s is None else list(s)
                if w is not None and len(w):
                    at = [x.span() for x in WORD.finditer(body)]
                    s += [{"a": at[p["a"]][0], "b": at[p["b"] - 1][1]} for p in w]
                cut = merged(s)
                if cut:
                    edges = [0, *(e for span in cut for e in span), len(body)]
                    kept = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                else:
                    kept = body
                rows.append((len(body), len(body) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None))
            n_bytes, n_removed, n_spans, sha, kept = zip(*rows, strict=True) if rows else ((),) * 5
            out = pdf.assign(n_bytes=np.array(n_bytes, dtype=np.int64), n_removed=np.array(n_removed, dtype=np.int64), n_spans=np.array(n_spans, dtype=np.int64), kept_sha256=list(sha))
            if counted:
                out["n_words_repeated"] = np.array([sum(b - a for a, b in p) for p in passages], dtype=np.int64)
                out["n_word_spans"] = np.array([len(p) for p in passages], dtype=np.int64)
            yield out.assign(kept_text=list(kept)) if with_text else out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return joined.mapInPandas(apply, f"{schema}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", n_words_repeated long, n_word_spans long" * bool(counted) + ", kept_text string" * with_text)


def without_repeats(docs: DataFrame, threshold: int = THRESHOLD, radices: Sequence[int] = RADICES, text: str = "text", size: str | None = None, words: int | None = None) -> DataFrame:
    """The documents with all their columns and only what is left of their texts; a null text stays null.

    `size` names a column of character counts to bring up to date.  Every document stays, if need be with an empty text.
    """
    columns = docs.columns
    docs, name = positional(docs)
    text, size = name[text], name.get(size)
    others = [c for c in docs.columns if c != text]
    marked = docs.withColumn("_null", F.col(text).isNull())
    out = remove_repeats(marked, [*others, "_null"], threshold, radices, text, with_text=True, words=words)
    out = out.withColumn(text, F.when(~F.col("_null"), F.col("kept_text")))
    if size is not None:
        out = out.withColumn(size, F.length(text).cast(docs.schema[size].dataType))
    return out.select(*docs.columns).toDF(*columns)
