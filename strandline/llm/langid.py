"""Language identification with a byte convolutional network.

A text is UTF-8 bytes cut into windows of fixed length.  Filters of several widths slide over each
window, each filter keeps its maximum, and a softmax layer turns the maxima into language probabilities;
the log probabilities of a text's windows are averaged.  The network is trained in numpy on windows of a
bounded sample of labelled texts and travels to the tasks with the function that applies it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
SAMPLE = 6000
CHUNK = 2048

# ASCII capitals as small letters, digits as one digit
BYTES = np.arange(256)
BYTES[65:91] += 32
BYTES[48:58] = 48
BYTES = BYTES.astype(np.uint8)


@dataclass
class ByteNet:
    """Filters by width, shape (width, 256, FILTERS), then softmax weights over all filters' maxima."""

    langs: list[str]
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def maxima(self, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(windows, all filters) maxima, and for each width the positions they come from."""
        best, at = [], []
        for w in self.filters:
            n = windows.shape[1] - len(w) + 1
            r = w[0][windows[:, :n]]
            for j in range(1, len(w)):
                r += w[j][windows[:, j : j + n]]
            p = r.argmax(axis=1)
            best.append(np.take_along_axis(r, p[:, None, :], 1)[:, 0])
            at.append(p)
        return np.concatenate(best, 1), at

    def fast_maxima(self, windows: np.ndarray) -> np.ndarray:
        """The same maxima without positions; neighbouring bytes share one table look-up."""
        pairs = windows[:, :-1].astype(np.uint16) * np.uint16(256) + windows[:, 1:]
        out = []
        for w in self.filters:
            n = windows.shape[1] - len(w) + 1
            r = self.table(w, 0)[pairs[:, :n]]
            for j in range(2, len(w), 2):
                r += self.table(w, j)[pairs[:, j : j + n]] if j + 1 < len(w) else w[j][windows[:, j : j + n]]
            out.append(r.max(axis=1))
        return np.concatenate(out, 1)

    def table(self, w: np.ndarray, j: int) -> np.ndarray:
        if not hasattr(self, "_tables"):
            self._tables = {}
        if (len(w), j) not in self._tables:
            self._tables[len(w), j] = (w[j][:, None, :] + w[j + 1][None, :, :]).reshape(65536, -1)
        return self._tables[len(w), j]

    def log_softmax(self, maxima: np.ndarray) -> np.ndarray:
        z = np.maximum(maxima + self.bias, 0) @ self.out + self.out_bias
        z = z - z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_tables"}


def windows_of(texts: Sequence[bytes], length: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Every byte of every text in windows of `length`, and the text of each window.

    The last window of a longer text ends with the text; a shorter text is padded with zeros.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    counts = np.maximum(1, -(-sizes // length))
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.cumsum(counts) - counts
    starts = (np.arange(len(owner)) - np.repeat(first, counts)) * length
    starts = np.minimum(starts, np.maximum(0, sizes[owner] - length))
    joined = np.frombuffer(b"".join(texts) + bytes(length), dtype=np.uint8)
    offset = np.cumsum(sizes) - sizes
    at = (offset[owner] + starts)[:, None] + np.arange(length)
    win = BYTES[joined[at]]
    short = np.flatnonzero(sizes[owner] < length)
    if len(short):
        win[short] = np.where(np.arange(length) < sizes[owner[short], None], win[short], 0)
    return win, owner


def train(windows: np.ndarray, langs: Sequence[str], epochs: int = 6, rate: float = 0.01, seed: int = 7, widths=WIDTHS, filters: int = FILTERS) -> ByteNet:
    """Adam on the cross entropy; only the positions of the maxima carry gradients."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    y = np.searchsorted(names, np.asarray(langs))
    total = filters * len(widths)
    net = ByteNet(
        names,
        [rng.normal(0, 0.3, (w, 256, filters)).astype(np.float32) for w in widths],
        np.zeros(total, np.float32),
        rng.normal(0, 0.3, (total, len(names))).astype(np.float32),
        np.zeros(len(names), np.float32),
    )
    params = [*net.filters, net.bias, net.out, net.out_bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), 64):
            pick = order[lo : lo + 64]
            win = windows[pick]
            top, at = net.maxima(win)
            hidden = np.maximum(top + net.bias, 0)
            z = hidden @ net.out + net.out_bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            p /= len(pick)
            back = (p @ net.out.T) * (hidden > 0)
            grads = [np.zeros_like(w) for w in net.filters]
            for i, (g, pos) in enumerate(zip(grads, at, strict=True)):
                part = back[:, i * filters : (i + 1) * filters]
                for j in range(len(g)):
                    np.add.at(g[j], (np.take_along_axis(win, pos + j, 1), np.arange(filters)[None, :]), part)
            grads += [back.sum(0), hidden.T @ p, p.sum(0)]
            step += 1
            for q, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def predict(net: ByteNet, texts: Sequence[bytes], length: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The most likely language of each text and its probability."""
    total = np.zeros((len(texts), len(net.langs)))
    lo = 0
    while lo < len(texts):  # a few thousand windows at a time, whatever the texts' sizes
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= CHUNK * length):
            size += len(texts[hi])
            hi += 1
        win, owner = windows_of(texts[lo:hi], length)
        sums = np.zeros((hi - lo, len(net.langs)))
        for k in range(0, len(win), CHUNK):
            np.add.at(sums, owner[k : k + CHUNK], net.log_softmax(net.fast_maxima(win[k : k + CHUNK])))
        total[lo:hi] = sums / np.bincount(owner, minlength=hi - lo)[:, None]
        lo = hi
    p = np.exp(total - total.max(1, keepdims=True)) if len(texts) else total
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1) if len(texts) else np.zeros(0, int)
    return best, p[np.arange(len(texts)), best]


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE, length: int = WINDOW, **training) -> ByteNet | None:
    """Trains on at most `sample` texts with a language: a sample without replacement in which every language has
    the same expected share, one random window of each text.  Only those windows come to the driver.  Without any there is no network (None).
    """
    known = labelled.filter(F.col(lang).isNotNull() & F.coalesce(F.col(text), F.lit("")).rlike(r"\p{L}")).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["lang"]: r["n"] for r in sizes.collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, float(n))])[F.col("lang")]
    u = (F.pmod(F.xxhash64("text", "lang"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    at = (F.pmod(F.xxhash64(F.lit(1), "text"), F.lit(1 << 30)) / float(1 << 30) * F.greatest(F.lit(1), F.length("text") - length + 1)).cast("int") + 1
    picked = known.select("lang", F.substring("text", at, F.lit(length)).alias("part"), (-F.log(u) * share).alias("key"))
    # keys are exponential with a mean of n, so about this limit leaves a little more than the sample
    low, high = 0.0, 1e3 * max(counts.values())
    for _ in range(80):
        limit = (low + high) / 2
        low, high = (low, limit) if sum(n * -math.expm1(-limit / n) for n in counts.values()) > 1.2 * sample else (limit, high)
    rows = picked.filter(F.col("key") <= high).orderBy("key", "part").limit(sample).collect()
    windows, _ = windows_of([r.part.encode()[:length] for r in rows], length)
    return train(windows, [r["lang"] for r in rows], **training)


def identify(docs: DataFrame, net: ByteNet | None, keep: Sequence[str | Column] = ("doc_id",), text: str = "text", length: int = WINDOW) -> DataFrame:
    """The kept columns with `lang_pred` and `score` (0 to 1) of every whole text.

    A null text or one without a letter is `und` with score 0, and so is every text if there is no network.  Repeated rows get equal answers; an empty
    table gives no rows; other columns are left out, so their names cannot clash.
    """
    body = docs.select(*keep, F.when(F.col(text).rlike(r"\p{L}"), F.col(text)).alias("_text"))
    kept = body.drop("_text").schema

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf.pop("_text")
            has = texts.notna().to_numpy() & (net is not None)
            lang, score = np.full(len(pdf), UNKNOWN, dtype=object), np.zeros(len(pdf))
            if has.any():
                best, score[has] = predict(net, [t.encode() for t in texts[has]], length)
                lang[has] = np.array(net.langs, dtype=object)[best]
            yield pdf.assign(lang_pred=lang, score=score)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return body.mapInPandas(apply, f"{schema}, lang_pred string, score double")
