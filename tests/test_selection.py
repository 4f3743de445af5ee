"""Rank selection by bit refinement against sorting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.plans import selection
from strandline.plans.ranks import lower_median_rank, nearest_rank, upper_median_rank

SHAPES = {
    "normal": lambda rng, n: rng.normal(size=n),
    "ties": lambda rng, n: rng.integers(-2, 3, n) * 0.5,
    "signed zeros": lambda rng, n: np.where(rng.random(n) < 0.5, 0.0, -0.0),
    "huge and tiny": lambda rng, n: rng.normal(size=n) * 10.0 ** rng.integers(-300, 300, n),
    "close": lambda rng, n: 1.0 + rng.integers(0, 1000, n) * 2.0**-52,
    "gaps": lambda rng, n: np.where(rng.random(n) < 0.2, np.nan, np.where(rng.random(n) < 0.1, np.inf, rng.normal(size=n))),
}


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(1)
    return {k: f(rng, 1500) for k, f in SHAPES.items()}


@pytest.fixture(scope="module")
def df(spark, values):
    rows = [(i, i * 7 // 1500 if i % 11 else None, *[None if i % 97 == 0 else float(v[i]) for v in values.values()]) for i in range(1500)]
    return spark.createDataFrame(rows, "i int, s int, " + ", ".join(f"`{k}` double" for k in values)).repartition(5)


def kept(values, s):
    i = np.arange(1500)
    group = np.where(i % 11, i * 7 // 1500, -1)
    mine = (i % 97 != 0) & ((group == s) if s < 7 else True)
    out = {k: v[mine & np.isfinite(v)] for k, v in values.items()}
    return out


def test_ranks_of_all_columns_and_segments(values, df):
    cols = [F.col(f"`{k}`") for k in values]
    picks = {"lo": lower_median_rank, "hi": upper_median_rank, "p9": nearest_rank(0.9)}
    got = selection.select(df, cols, picks, F.col("s"), 7)
    for s in range(8):
        for c, (_, v) in enumerate(kept(values, s).items()):
            o = np.sort(v)
            n = len(o)
            assert got[s, c] == {"n": n, "lo": o[(n - 1) // 2], "hi": o[n // 2], "p9": o[int(np.floor((n - 1) * 0.9 + 0.5))]}


def test_medians_and_deviations(values, df):
    cols = [F.col(f"`{k}`") for k in values]
    got = selection.medians_and_deviations(df, cols, upper_median_rank, F.col("s"), 7)
    for s in range(8):
        for c, v in enumerate(kept(values, s).values()):
            m = np.sort(v)[len(v) // 2]
            away = np.sort(np.abs(v - m))
            assert got[s, c] == {"n": len(v), "median": m, "mad": away[len(v) // 2]}


def test_nothing_to_rank(df):
    assert selection.select(df.limit(0), [F.col("`ties`")], {"m": upper_median_rank}) == {}
    assert selection.select(df, [F.lit(None).cast("double")], {"m": upper_median_rank}) == {}


def test_only_counts_are_shuffled(df):
    bits = selection.sortable_bits(np.array([-np.inf, -1.5, -0.0, 0.0, 5e-324, 2.0]))
    assert (np.diff(bits.astype(object)) >= 0).all() and bits[2] == bits[3]
    assert selection.values_of(bits).tolist() == [-np.inf, -1.5, 0.0, 0.0, 5e-324, 2.0]


def test_counting_holds_little_however_long_the_input():
    import tracemalloc

    import pandas as pd

    rng = np.random.default_rng(9)

    def batches(n):
        for i in range(n):
            yield pd.DataFrame({"s": np.full(10_000, i % 3, dtype="int32"), **{f"c{c}": rng.integers(1, 2**62, 10_000).view(np.float64) for c in range(9)}})

    tracemalloc.start()
    counted = sum(out["count"].sum() for out in selection._counter(9, 41, 0, None, None)(batches(12)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counted <= 2 * 9 * 120_000 and counted > 2 * 9 * 110_000
    assert peak < 64e6
