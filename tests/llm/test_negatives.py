"""Hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, uid string, q double, rank int"


def brute(rows, positives=5, count=3, low=50, high=95):
    good = [(i, l, [math.floor(256 * x) for x in v]) for i, v, l in rows if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda s, i: (-s, i is None, i or 0)
    out = []
    for n, (i, l, a) in enumerate(good):
        if i is None or i % 50:
            continue
        s = [(sum(x * y for x, y in zip(a, b)), j, m) for k, (j, m, b) in enumerate(good) if k != n]
        for p, j, _ in sorted((x for x in s if x[2] == l), key=lambda x: order(x[0], x[1]))[:positives]:
            fit = sorted(((q, k) for q, k, m in s if m != l and low * p <= 100 * q <= high * p), key=lambda x: order(*x))[:count]
            out += [(i, j, r + 1, k, p, q) for r, (q, k) in enumerate(fit)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    centre = [[rng.gauss(0, 0.2) for _ in range(13)] for _ in range(6)]
    out = [(i, [c + rng.gauss(0, 0.12) for c in centre[rng.randrange(6)]], rng.randrange(4)) for i in range(420)]
    out += [(900 + i, [round(x * 4) / 4 for x in out[i][1]], i % 3) for i in range(60)]  # ties
    out += [out[50], out[50], out[51], out[100]]  # repeated rows, anchors among them
    out += [(1000, [], 1), (1050, [3.0, -7.5], 2), (1100, [1e4] * 40, 3), (None, out[7][1], 2), (None, out[7][1], 2)]
    out += [(1150, None, 1), (1200, [0.1, None], 1), (1250, [0.1, float("nan")], 2), (1300, [float("inf")], 1), (1350, [0.5] * 13, None)]
    return out


@pytest.mark.parametrize("row_block,anchor_block", [(65536, 16384), (100, 4)])
def test_negatives_match_brute_force(spark, rows, row_block, anchor_block):
    df = spark.createDataFrame([(i, v, l, "x", 0.5, 1) for i, v, l in rows], SCHEMA)
    got = negatives.mine(df, F.col("vec_id") % 50 == 0, row_block=row_block, anchor_block=anchor_block)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_nothing_to_mine(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert negatives.mine(empty, F.col("vec_id") % 50 == 0).count() == 0
    one = spark.createDataFrame([(50, [0.5], 1, "x", 0.5, 1)], SCHEMA)
    assert negatives.mine(one, F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("peak", [3, 300, 2**31, 2**40])
def test_lookups_give_exact_inner_products(peak):
    rng = np.random.default_rng(peak)
    a, c = rng.integers(-peak, peak, (9, 24)), rng.integers(-peak, peak, (50, 24))
    c[0], c[1] = -peak, peak - 1
    kind = negatives._kind(a, c)
    got = negatives.scores(negatives.subset_sums(a.astype(kind)), negatives.bit_planes(c))
    with np.errstate(over="ignore"):
        assert np.array_equal(got.astype(np.int64), c @ a.T)
