"""Toxicity by weak supervision.

Voters say whether a text looks toxic: word lists, patterns, and word-part lists mined from the labelled
sample.  A generative label model estimates how often each voter speaks for either class and how far voters repeat
each other within a class, and turns the votes into posterior labels.  A linear classifier on word parts learns
those posteriors; it alone scores whole texts, in batches of numpy code.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import id_text, whole_text
from strandline.plans.staging import stage

SAMPLE = 6000
BITS = 20
GRAMS = (5, 7)
PAD = b" " * max(GRAMS)
CANDIDATES = 8192
FEATURES = 1024
MINED_VOTERS = 10
MINED_PARTS = 150
BATCH_BYTES = 1 << 19

# Common abusive words, one voter for each line.
LEXICONS = {
    "insult": ["idiot", "moron", "stupid", "dumb", "fool", "imbecile", "clown", "loser", "jerk", "coward"],
    "contempt": ["trash", "garbage", "scum", "filth", "vermin", "worthless", "pathetic", "disgusting", "useless", "vile"],
    "hate": ["hate", "despise", "loathe", "detest"],
    "threat": ["kill", "die", "hurt", "destroy", "beat", "shoot"],
    "profanity": ["damn", "hell", "crap", "bastard", "bitch", "shit", "fuck"],
    "german": ["idiot", "dumm", "abschaum", "dreck", "arschloch", "versager", "erbärmlich", "wertlos"],
    "french": ["idiot", "imbécile", "connard", "ordure", "merde", "pathétique", "minable", "raclure"],
    "spanish": ["idiota", "imbécil", "basura", "escoria", "mierda", "patético", "inútil", "estúpido"],
}
PATTERNS = {
    "you are": re.compile(r"\byou(?: are|'re)? (?:\w+ ){0,2}(?:idiot|moron|loser|clown|scum|trash)"),
    "repeated insult": re.compile(r"\b(\w{4,})[!,. ]+\1[!,. ]+\1\b"),
    "exclamations": re.compile(r"!!"),
    "masked letters": re.compile(r"\b\w+[*@$]\w+\b"),
}
WORD_VOTERS = {k: re.compile(r"\b(?:" + "|".join(map(re.escape, v)) + r")\b") for k, v in LEXICONS.items()}
VOTERS = [*WORD_VOTERS.values(), *PATTERNS.values()]
SPACES = bytes(32 if c < 128 and not chr(c).isalpha() else c for c in range(256))


def votes(text: str) -> list[int]:
    """1 for every fixed voter that speaks, else 0."""
    low = text.lower()
    return [int(v.search(low) is not None) for v in VOTERS]


def parts(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, word part) of every place: parts are strings of 5 and 7 bytes of the lower-cased text, hashed to
    20 bits; what is not a letter is a space."""
    bodies = [t.lower().encode().translate(SPACES) for t in texts]
    joined = PAD + PAD.join(bodies) + PAD
    b = np.frombuffer(joined, dtype=np.uint8).astype(np.uint64)
    ends = np.cumsum([len(x) + len(PAD) for x in bodies])
    n = int(ends[-1]) if len(ends) else 0  # every part that begins here ends in the padding at the latest
    owner = np.repeat(np.arange(len(texts)), np.diff(np.concatenate(([0], ends))))
    code, found = np.zeros(n, dtype=np.uint64), []
    for j in range(max(GRAMS)):
        code = (code << np.uint64(8)) | b[j : j + n]
        if j + 1 in GRAMS:
            found.append(((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32))
    return np.tile(owner, len(GRAMS)), np.concatenate(found)


def sliced(texts: Sequence[str], most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with a bounded number of characters together (or one longer text)."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > most:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


@dataclass
class LabelModel:
    chances: np.ndarray  # (class, voter): how often a voter speaks
    correlations: np.ndarray
    weights: np.ndarray
    annotator: float

    def posterior(self, spoken: np.ndarray, given: np.ndarray) -> np.ndarray:
        """A silent voter abstains; the given labels are those of one more voter, right with chance `annotator`."""
        on = (np.log(self.chances[1]) - np.log(self.chances[0])) * self.weights
        z = np.log(self.annotator / (1 - self.annotator)) * (2 * given - 1) + spoken.astype(float) @ on
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def label_model(spoken: np.ndarray, given: np.ndarray, annotator: float = 0.98, rounds: int = 10) -> LabelModel:
    """Expectation maximisation over both classes alike, from the given labels.

    A voter's weight falls with its correlations to others within the classes, so that voters that repeat each
    other count about once.  The annotator's chance is estimated too, between 0.95 and 0.99.
    """
    x, p = spoken.astype(float), 0.05 + 0.9 * given
    model = None
    for _ in range(rounds):
        both = np.stack([1 - p, p])
        chances = (both @ x + 0.5) / (both.sum(1, keepdims=True) + 1)
        inside = np.zeros((x.shape[1],) * 2)
        for c in range(2):
            r = (x - chances[c]) * np.sqrt(both[c])[:, None]
            inside += r.T @ r
        scale = np.sqrt(np.maximum(np.diag(inside), 1e-9))
        rho = inside / scale[:, None] / scale
        np.fill_diagonal(rho, 0)
        model = LabelModel(chances, rho, 1 / (1 + np.maximum(np.abs(rho) - 0.05, 0).sum(1)), annotator)
        p = model.posterior(spoken, given)
        annotator = float(np.clip(np.where(given == 1, p, 1 - p).mean(), 0.95, 0.99))
    return model


@dataclass
class Classifier:
    slot: np.ndarray  # part -> feature, -1 if none
    weights: np.ndarray
    bias: float

    def scores(self, texts: Sequence[str]) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        for lo, hi in sliced(texts):
            owner, part = parts(texts[lo:hi])
            f = self.slot[part]
            hit = np.flatnonzero(f >= 0)
            pair = np.unique(owner[hit].astype(np.int64) * len(self.weights) + f[hit])
            z[lo:hi] += np.bincount(pair // len(self.weights), self.weights[pair % len(self.weights)], hi - lo)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


KNOWS_NOTHING = Classifier(np.full(1 << BITS, -1, dtype=np.int32), np.zeros(1), -30.0)


def _chi2(counts: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far parts and classes depend on each other, and whether a part speaks for class 1."""
    total = classes.sum()
    seen = counts.sum(0)
    expected = seen * (classes[1] / total)
    chi = (counts[1] - expected) ** 2 / np.maximum(seen * (classes[1] / total) * (classes[0] / total), 1e-9) / np.maximum(1 - seen / total, 1e-9)
    return chi, counts[1] > expected


def train(spoken: np.ndarray, docs: Sequence[np.ndarray], labels: np.ndarray, candidates: np.ndarray, share: float, steps: int = 400) -> tuple[Classifier, LabelModel]:
    """From the fixed votes, the candidate parts of each sampled text (places in `candidates`) and the labels of the sample;
    `share` of the population is toxic."""
    y = labels.astype(float)
    size = len(candidates)

    def by_class(p):
        out = np.zeros((2, size))
        for own, q in zip(docs, p.tolist(), strict=True):
            out[0, own] += 1 - q
            out[1, own] += q
        return out

    def listed(of: np.ndarray, width: int) -> np.ndarray:
        """Which of the chosen parts (those with a number in `of`) each text has."""
        out = np.zeros((len(docs), width), dtype=bool)
        for row, own in zip(out, docs, strict=True):
            f = of[own]
            row[f[f >= 0]] = True
        return out

    chi, toxic = _chi2(by_class(y), np.array([(1 - y).sum(), y.sum()]))
    seen = by_class(y)
    ratio = (seen[1] + 0.5) / (y.sum() + 1) / ((seen[0] + 0.5) / ((1 - y).sum() + 1))
    strong = toxic & (chi > 15) & (ratio > 20)
    best = np.argsort(-np.where(strong, chi, 0), kind="stable")[: min(MINED_PARTS, int(strong.sum()))]
    voter = np.full(size, -1)
    voter[best] = np.arange(len(best)) % MINED_VOTERS
    mined = listed(voter, MINED_VOTERS)
    spoken = np.concatenate([spoken.astype(bool), mined], 1)
    lists = np.r_[0 : len(WORD_VOTERS), len(VOTERS) : spoken.shape[1]]
    silence = ~spoken[:, lists].any(axis=1, keepdims=True)  # the one voter for the clean class: no list has a word of the text
    spoken = np.concatenate([spoken, silence], 1)
    model = label_model(spoken, y)
    p = model.posterior(spoken, y)
    chi, _ = _chi2(by_class(p), np.array([(1 - p).sum(), p.sum()]))
    chosen = np.argsort(-chi, kind="stable")[:FEATURES]
    feature = np.full(size, -1, dtype=np.int32)
    feature[chosen] = np.arange(len(chosen))
    slot = np.full(1 << BITS, -1, dtype=np.int32)
    slot[candidates[chosen]] = np.arange(len(chosen))
    x = listed(feature, len(chosen)).astype(np.float32)
    # the sample is balanced, the population is not
    weight = np.where(p >= 0.5, share / max(y.mean(), 1e-6), (1 - share) / max(1 - y.mean(), 1e-6)).astype(np.float32)
    weight /= weight.sum()
    w, bias = np.zeros(len(chosen), np.float32), float(np.log(share / (1 - share)))
    goal = p.astype(np.float32)  # one width of numbers throughout: a mixed product would copy x in every step
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        err = (1 / (1 + np.exp(-(x @ w + np.float32(bias)))) - goal) * weight
        g, gb = err @ x + np.float32(1e-4) * w, float(err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, c = 1 - 0.9**t, 1 - 0.999**t
        w -= (0.05 * (m / a) / (np.sqrt(v / c) + 1e-8)).astype(np.float32)
        bias -= 0.05 * (mb / a) / (np.sqrt(vb / c) + 1e-8)
    return Classifier(slot, w.astype(float), bias), model


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> tuple[Classifier, LabelModel | None]:
    """Learns from at most `sample` labelled rows whose key is `allowed`, half of them toxic where there are enough.

    The sample is drawn by a hash of the key among all labelled rows; its keys are broadcast.  Spark counts the word parts
    by class; the driver gets the CANDIDATES most telling ones, then each sampled text's votes and candidates.  Without labelled texts of both classes
    nothing is learned and every text scores next to 0.
    """
    known = labels.filter(allowed & F.col(label).isNotNull()).select(key, F.col(label).cast("int").alias("_y"))
    counts = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return KNOWS_NOTHING, None
    u = F.pmod(F.xxhash64(id_text(key)), F.lit(1 << 40)) / float(1 << 40)
    half = sample / 2
    limit = F.when(F.col("_y") == 1, half / counts[1]).otherwise(max(half, sample - counts[1]) / counts[0])
    picked = F.broadcast(known.filter(u < limit).dropDuplicates([key]).limit(2 * sample))
    body = docs.select(key, whole_text(text).alias("_text")).join(picked, key).select("_text", "_y")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each part the sampled texts of either class that have it; as part -1 the texts themselves."""
        seen, texts = np.zeros((2, 1 << BITS), dtype=np.int32), [0, 0]
        for pdf in batches:
            for t, y in zip(pdf["_text"], pdf["_y"], strict=True):
                seen[int(y == 1), np.unique(parts([t])[1])] += 1
                texts[int(y == 1)] += 1
        some = np.flatnonzero(seen.any(axis=0))
        yield pd.DataFrame({"part": np.append(some, -1).astype(np.int32), "n0": np.append(seen[0, some], texts[0]).astype(np.int64), "n1": np.append(seen[1, some], texts[1]).astype(np.int64)})

    tally = stage(body.mapInPandas(count, "part int, n0 long, n1 long").groupBy("part").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    totals = tally.filter("part = -1").collect()
    if not totals or not totals[0]["n0"] or not totals[0]["n1"]:
        return KNOWS_NOTHING, None
    t0, t1 = float(totals[0]["n0"]), float(totals[0]["n1"])
    gap = F.col("n1") / t1 - F.col("n0") / t0
    both = (F.col("n0") + F.col("n1")) / (t0 + t1)
    usable = tally.filter("part >= 0 and n0 + n1 >= 5").withColumn("chi", gap * gap / (both * (1.0 - both) + 1e-9))
    best = usable.orderBy(F.desc("chi"), "part").limit(CANDIDATES).select("part").collect()
    candidates = np.array(sorted(r["part"] for r in best), dtype=np.int32)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = np.full(1 << BITS, -1, dtype=np.int32)
        place[candidates] = np.arange(len(candidates))
        for pdf in batches:
            own = [np.unique(place[parts([t])[1]]) for t in pdf["_text"]]
            yield pd.DataFrame({"y": pdf["_y"], "spoken": [bytes(votes(t)) for t in pdf["_text"]], "parts": [o[o >= 0].astype("<i2").tobytes() for o in own]})

    rows = sorted((r.y, bytes(r.spoken), bytes(r.parts)) for r in body.mapInPandas(look, "y int, spoken binary, parts binary").limit(2 * sample).collect())
    spoken = np.stack([np.frombuffer(r[1], dtype=np.uint8) for r in rows])
    return train(spoken, [np.frombuffer(r[2], dtype="<i2") for r in rows], np.array([r[0] for r in rows]), candidates, counts[1] / (counts[0] + counts[1]))


def score(docs: DataFrame, model: Classifier, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns with `score` (0 to 1) and `predicted` (1 from 0.5 on) of every whole text.

    Null and empty texts score the classifier's bias.  Repeated rows get equal scores; an empty table gives no rows.
    Columns that are not kept are ignored, so their names cannot clash.
    """
    body = docs.select(*keep, whole_text(text).alias("_scored"))

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = model.scores(pdf.pop("_scored").tolist())
            yield pdf.assign(score=s, predicted=(s >= 0.5).astype(np.int32))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return body.mapInPandas(apply, f"{schema}, score double, predicted int")


def reject(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """The documents, whole and with all their columns, that score below 0.5; null and empty texts are scored like any other."""

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[model.scores(pdf[text].fillna("").tolist()) < 0.5]

    return docs.mapInPandas(apply, docs.schema)
