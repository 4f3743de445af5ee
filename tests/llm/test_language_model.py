"""Deleted interpolation against plain counting and plain expectation-maximisation."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from strandline.llm import language_model as lm

SCHEMA = "doc_id long, text string, score double, n long, chunk string"


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())) + [None]


def brute(rows, train, order, rounds=lm.ROUNDS):
    docs = [(i, tokens(t), train(i), (t or "").encode()) for i, t in rows]
    deleted = [u and xxhash.xxh64_intdigest(b, 11) % lm.DELETED == 0 for _, _, u, b in docs]

    def counts(keep):
        n, ctx = [Counter() for _ in range(order)], [Counter() for _ in range(order)]
        for (_, w, u, _), gone in zip(docs, deleted):
            if not u or (gone and not keep):
                continue
            padded = ["<"] * (order - 1) + w
            for p in range(order - 1, len(padded)):
                for k in range(order):
                    n[k][tuple(padded[p - k : p + 1])] += 1
                    ctx[k][tuple(padded[p - k : p])] += 1
        return n, ctx

    def estimate(n, ctx, padded, p):
        f, b = [], []
        for k in range(order):
            c = ctx[k][tuple(padded[p - k : p])]
            f.append(n[k][tuple(padded[p - k : p + 1])] / c if c else 0.0)
            b.append((c.bit_length() if k else 0))
        return f, b

    def shares(f, b, w, words):
        rest, out = 1.0, [0.0] * (order + 1)
        for k in reversed(range(order)):
            x = w[k][b[k]]
            out[k + 1], rest = rest * x * f[k], rest * (1 - x)
        out[0] = rest / (words + 1)
        return out

    n, ctx = counts(False)
    w = [[0.5] * 65 for _ in range(order)]
    for k in range(1, order):
        w[k][0] = 0.0
    for _ in range(rounds):
        got, seen = Counter(), Counter()
        for (_, t, _, _), gone in zip(docs, deleted):
            padded = ["<"] * (order - 1) + t
            for p in range(order - 1, len(padded)) if gone else ():
                f, b = estimate(n, ctx, padded, p)
                s = shares(f, b, w, len(n[0]))
                for k in range(order):
                    got[k, b[k]] += s[k + 1] / sum(s)
                    seen[k, b[k]] += sum(s[: k + 2]) / sum(s)
        new = [[0.5] * 65 for _ in range(order)]
        for k in range(order):
            if k:
                new[k][0] = 0.0
            for j in range(1 if k else 0, 65 if k else 1):
                if seen[k, j] > 0:
                    new[k][j] = min(lm.MOST, max(lm.LEAST, got[k, j] / seen[k, j]))
                elif j > 1:
                    new[k][j] = new[k][j - 1]
        moved, w = max(abs(x - y) for a, c in zip(w, new) for x, y in zip(a, c)), new
        if moved < 1e-4:
            break
    n, ctx = counts(True)
    total, words, out = sum(n[0].values()), len(n[0]), []
    if not total:
        w[0][0] = 0.0
    for i, t, u, _ in docs:
        padded, s = ["<"] * (order - 1) + t, 0.0
        for p in range(order - 1, len(padded)):
            s += math.log10(sum(shares(*estimate(n, ctx, padded, p), w, words)))
        base = sum(math.log10((n[0][(x,)] + 0.5) / (total + 0.5 * (words + 1))) for x in t)
        out.append((i, not u, len(t), sum(n[0][(x,)] > 0 for x in t), total, base, s))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    word = [("Wörd" if i % 7 == 0 else "w") + str(i) for i in range(60)]
    out = []
    for i in range(240):
        at, text = rng.randrange(60), []
        for _ in range(rng.randrange(40)):
            at = (at * 7 + 1) % 60 if rng.random() < 0.6 else min(59, int(rng.expovariate(0.1)))
            text.append(word[at] if rng.random() < 0.97 else f"new{rng.randrange(10**6)}")
        out.append((i, rng.choice([" ", "\n", "\t ", "\x0b"]).join(text)))
    out += [(300, None), (301, ""), (302, " \n "), (303, "A\x1cB a b É é"), (304, " ".join(rng.choice(word) for _ in range(5000))), (2**60 + 1, "w1 w2")]
    return [*out, out[3], out[3], (None, "w1 w8 w57"), (None, None)]


def ours(df, order, **sizes):
    train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 != 1
    return lm.score(df, train, order=order, **sizes)


def close(got, want):
    key = lambda r: str(r[:4])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("order,chunk,part,cut", [(1, 8 << 20, 16 << 20, 1 << 20), (2, 700, 900, 50), (3, 900, 4000, 64)])
def test_scores_match_plain_counting(spark, rows, order, chunk, part, cut):
    df = spark.createDataFrame([(i, t, 0.5, 1, "x") for i, t in rows], SCHEMA).repartition(3)
    train = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1
    close(ours(df, order, chunk_bytes=chunk, part_bytes=part, slice_bytes=cut).collect(), brute(rows, train, order))


def test_interpolation_beats_the_baseline_on_held_out_text(spark, rows):
    df = spark.createDataFrame([(i, t, 0.5, 1, "x") for i, t in rows], SCHEMA)
    s = ours(df, 2).filter("held_out").agg(F.sum("score"), F.sum("base_score")).collect()[0]
    assert s[0] > 0.8 * s[1]


def test_nothing_to_learn_from(spark, rows):
    df = spark.createDataFrame([(i, t, 0.5, 1, "x") for i, t in rows[:5]], SCHEMA)
    close(lm.score(df, F.lit(False)).collect(), brute(rows[:5], lambda i: False, 2))
    assert ours(df.limit(0), 2).count() == 0
