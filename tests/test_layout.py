"""Results do not depend on how rows are cut into ranges, blocks and partitions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline import Layout, order_rows
from strandline.operators import align, reduce, spectral, stats, windows
from strandline.plans.blocks import group_runs, longest_runs, running_total
from strandline.plans.layout import ROW
from strandline.plans.ordering import with_series_size
from strandline.plans.ranks import nearest_rank, pick_ranks, upper_median_rank
from tests.conftest import SMALL, WHOLE

N = 1200


def noisy(seed=7):
    r = random.Random(seed)
    out, y, t = [], 0.0, 0.0
    for i in range(N):
        t += r.choice([1.0, 1.0, 1.0, 2.5, 0.25])
        y += r.gauss(0, 1)
        out.append((i, "a" if r.random() < 0.8 else "b", t, None if r.random() < 0.05 else y, float(r.randint(0, 3)), r.choice([0, 0, 0, 1])))
    return out


@pytest.fixture(scope="module")
def data(spark):
    rows = noisy()
    df = spark.createDataFrame(rows, "i int, g string, t double, y double, u double, flag int").repartition(7).cache()
    return rows, df


def table(df, *cols):
    return sorted(tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())


def both(df, fn, cols, by=()):
    got = [table(fn(order_rows(df, "i", by, layout=lay)), *cols) for lay in (WHOLE, SMALL)]
    assert got[0] == got[1]
    return got[0]


def test_row_index_dense(data):
    _, df = data
    got = both(df, lambda o: o.df, ["i", ROW])
    assert [r[1] for r in got] == list(range(N))


def test_row_index_per_series(data):
    rows, df = data
    got = both(df, lambda o: o.df, ["g", "i", ROW], ("g",))
    for g in "ab":
        assert [r[2] for r in got if r[0] == g] == list(range(sum(r[1] == g for r in rows)))


def test_row_index_splits_dominant_leading_key(spark):
    df = spark.range(2000).select(F.lit(1).alias("day"), F.col("id").alias("seq"))
    o = order_rows(df, ["day", "seq"], layout=SMALL)
    assert o.df.filter(F.col(ROW) != F.col("seq")).count() == 0
    assert o.df.groupBy(F.spark_partition_id()).count().count() > 1


def test_duplicate_key_raises(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "k int, v string")
    with pytest.raises(Exception, match="not unique"):
        order_rows(df, "k").df.collect()


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "k int, x double, y double")
    one = spark.createDataFrame([(1, 0.0, 5.0)], "k int, x double, y double")
    for df, n in ((empty, 0), (one, 1)):
        o = order_rows(df, "k", layout=SMALL)
        assert o.df.count() == n
        assert windows.rolling(o, "mean", "y", 3, "m").count() == n
        assert [r.a for r in windows.integral(o, "x", "y", "a").collect()] == [0.0] * n
        assert [r.d for r in windows.derivative(o, "x", "y", "d").collect()] == [0.0] * n
        assert reduce.minmax_envelope(o, "x", "y", 5).count() == n
        assert reduce.resample(o, "x", "y", 9).count() == n
        assert spectral.psd(o, "y").count() == 0


@pytest.mark.parametrize("stat", ["mean", "std", "min", "max"])
@pytest.mark.parametrize("w", [2, 64])
def test_rolling(data, stat, w):
    rows, df = data
    got = both(df, lambda o: windows.rolling(o, stat, "y", w, "r"), ["i", "r"])
    fn = {"mean": np.mean, "std": np.std, "min": np.min, "max": np.max}[stat]
    for i in (0, 1, 5, 63, 64, 500, N - 1):
        v = [r[3] for r in rows[max(0, i - w + 1) : i + 1] if r[3] is not None]
        assert got[i][1] == pytest.approx(fn(v), abs=1e-8) if v else got[i][1] is None


@pytest.mark.parametrize("stat", ["mean", "std", "min", "max", "corr"])
def test_rolling_wide_equals_direct(data, stat, monkeypatch):
    _, df = data
    o = order_rows(df, "i", layout=SMALL)
    for w in (3, 90):
        monkeypatch.setattr(windows, "DIRECT_WINDOW", 10_000)
        direct = table(windows.rolling(o, stat, "y", w, "r", "u"), "i", "r")
        monkeypatch.setattr(windows, "DIRECT_WINDOW", 1)
        wide = table(windows.rolling(o, stat, "y", w, "r", "u"), "i", "r")
        for a, b in zip(direct, wide):
            assert (a[1] is None) == (b[1] is None) and (a[1] is None or a[1] == pytest.approx(b[1], abs=1e-7))


def test_transforms_per_series(data):
    _, df = data
    both(df, lambda o: windows.moving_average(o, "u", 5, "r"), ["i", "r"], ("g",))
    both(df, lambda o: windows.derivative(o, "t", "u", "r"), ["i", "r"], ("g",))
    both(df, lambda o: windows.integral(o, "t", "u", "r"), ["i", "r"], ("g",))


def test_integral_stops_at_missing(data):
    rows, df = data
    got = both(df, lambda o: windows.integral(o, "t", "y", "r"), ["i", "r"])
    first = next(i for i, r in enumerate(rows) if r[3] is None)
    assert all(r[1] is None for r in got[max(first, 1) :]) and all(r[1] is not None for r in got[:first])


def test_running_total(data):
    rows, df = data
    got = both(df, lambda o: running_total(o, F.col("u"), "s"), ["i", "s"])
    assert [r[1] for r in got] == list(np.cumsum([r[4] for r in rows]))


def test_longest_runs(data):
    rows, df = data
    got = both(df, lambda o: longest_runs(o, ["flag", "y"]), ["column", "longest_run"])
    best = cur = 0
    for i, r in enumerate(rows):
        cur = cur + 1 if i and rows[i - 1][5] == r[5] else 1
        best = max(best, cur)
    assert dict(got)["flag"] == best


def test_longest_run_over_many_blocks(spark):
    df = spark.range(1000).select("id", F.when(F.col("id").between(30, 710), 1.5).otherwise(F.col("id").cast("double")).alias("v"), F.lit(3.0).alias("c"))
    df = df.withColumn("n", F.when(F.col("id") >= 900, None).otherwise(F.col("id")))
    for lay in (SMALL, WHOLE):
        got = dict(longest_runs(order_rows(df, "id", layout=lay), ["v", "c", "n"]).collect())
        assert got == {"v": 681, "c": 1000, "n": 100}


def test_group_runs(spark):
    r = random.Random(3)
    rows = sorted(r.sample(range(1000), 300))
    df = spark.createDataFrame([(x, "c") for x in rows], f"{ROW} bigint, c string")
    want, start, prev, n = [], rows[0], rows[0], 0
    for x in rows:
        if x > prev + 3:
            want.append((start, prev, n))
            start, n = x, 0
        prev, n = x, n + 1
    want.append((start, prev, n))
    for block in (8, 64, 4096):
        assert sorted(tuple(x) for x in group_runs(df, ["c"], block).select("start", "end", "count").collect()) == want


def test_ranks_with_dominant_value(spark):
    r = random.Random(5)
    rows = [("a" if r.random() < 0.7 else "b", 0.0 if r.random() < 0.4 else round(r.gauss(0, 10), 2)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double")
    for lay in (SMALL, WHOLE):
        got = pick_ranks(df, "v", {"m": upper_median_rank, "p": nearest_rank(0.9), "z": nearest_rank(0.0)}, ("g",), layout=lay)
        for row in got.collect():
            v = sorted(x for g, x in rows if g == row.g)
            assert (row.n, row.m, row.z) == (len(v), v[len(v) // 2], v[0])
            assert row.p == v[math.floor((len(v) - 1) * 0.9 + 0.5)]


def test_median_mad_layouts(data):
    rows, df = data
    got = [stats.median_mad(df, "y", ["g"], layout=lay).orderBy("g").collect() for lay in (SMALL, WHOLE)]
    assert got[0] == got[1]
    for r in got[0]:
        v = sorted(x[3] for x in rows if x[1] == r.g and x[3] is not None)
        med = v[len(v) // 2]
        assert r.median == med and r.mad == sorted(abs(x - med) for x in v)[len(v) // 2]


@pytest.mark.parametrize("tol", [0.0, 1.5, 40.0, float("inf")])
def test_nearest_join_brute_force(spark, tol):
    r = random.Random(11)
    left = [(i, float(r.randint(0, 400)) / 2) for i in range(300)]
    right = [(i, float(r.randint(50, 300)) / 2, float(i)) for i in range(200)]
    l = spark.createDataFrame(left, "k bigint, x double")
    rt = spark.createDataFrame(right, "k bigint, x double, y double")
    want = {}
    srt = sorted(right, key=lambda p: p[1])
    for k, x in left:
        pos = sum(p[1] < x for p in srt)
        best = None
        for c in (pos - 1, pos):
            if 0 <= c < len(srt) and (best is None or abs(srt[c][1] - x) < best[0]):
                best = (abs(srt[c][1] - x), srt[c][0])
        if best[0] <= tol:
            want[k] = best[1]
    for lay in (Layout(rows_per_bucket=40), WHOLE):
        got = align.nearest_join(l, rt, "x", "k", tol, layout=lay)
        assert {a.k: a.row2 for a in got.select("k", "row2").collect()} == want


def test_nearest_join_per_series(spark):
    r = random.Random(2)
    rows = lambda n: [(g, i, r.random() * 100) for g in ("p", "q", "r") for i in range(n) if not (g == "r" and n == 60)]
    left, right = rows(80), rows(60)
    l, rt = (spark.createDataFrame(d, "g string, k bigint, x double") for d in (left, right))
    for lay in (Layout(rows_per_bucket=30), WHOLE):
        got = {(a.g, a.k): a.row2 for a in align.nearest_join(l, rt, "x", "k", by=["g"], layout=lay).collect()}
        assert len(got) == 160
        for g, k, x in left:
            if g != "r":
                assert got[g, k] == min((abs(p[2] - x), p[1]) for p in right if p[0] == g)[1]


def test_repair_timestamps(spark):
    def ref(x, limit, inc):
        x, n = list(x), len(x)
        good = [i for i in range(n) if not x[i] < limit]
        out = []
        for i in range(n):
            before = [g for g in good if g <= i]
            if before:
                out.append(x[before[-1]] + inc * (i - before[-1]))
            elif good:
                out.append(x[good[0]] - inc * (good[0] - i))
            else:
                out.append(limit - inc * (n - i))
        return out

    r = random.Random(4)
    long = [float(1000 + i) if i > 90 and not 200 < i < 420 and r.random() > 0.3 else float(r.randint(0, 50)) for i in range(600)]
    for x in (long, [1.0, 2.0, 3.0], [500.0, 1.0, 700.0, 2.0, 3.0]):
        df = spark.createDataFrame(list(enumerate(x)), "i int, x double")
        for lay in (SMALL, WHOLE):
            got = align.repair_timestamps(order_rows(df, "i", layout=lay), "x", 100.0, 2.0, "f").orderBy("i").collect()
            assert [g.f for g in got] == ref(x, 101.0, 2.0)


def lttb_ref(x, y, target, shift):
    n, out, prev = len(x), [0], 0
    bs = (n - 2) / (target - 2)
    for i in range(target - 2):
        a = int((i + shift) * bs) + 1
        b = min(int((i + shift + 1) * bs) + 1, n - 1)
        na, nb = min(int((i + shift + 1) * bs) + 1, n - 1), min(int((i + shift + 2) * bs) + 1, n)
        mx, my = np.mean(x[na:nb]) if nb > na else 0.0, np.mean(y[na:nb]) if nb > na else 0.0
        area = [abs((x[prev] - mx) * (y[j] - y[prev]) - (x[prev] - x[j]) * (my - y[prev])) for j in range(a, b)]
        prev = a + int(np.argmax(area)) if area else a
        out.append(prev)
    return out + [n - 1]


@pytest.mark.parametrize("variant,shift", [("reference", 1), ("standard", 0)])
@pytest.mark.parametrize("target", [3, 17, 400])
def test_lttb_picks(data, variant, shift, target):
    rows, df = data
    x, y = np.array([r[2] for r in rows]), np.sin(np.arange(N) / 9.0) * 5 + np.array([r[4] for r in rows])
    d = df.withColumn("s", F.sin(F.col("i") / 9.0) * 5 + F.col("u"))
    for lay in (SMALL, WHOLE):
        got = reduce.lttb(order_rows(d, "i", layout=lay), "t", "s", target, variant).orderBy("pick").collect()
        assert [g[ROW] for g in got] == lttb_ref(x, y, target, shift)


def test_lttb_smooth_long_blocks(spark):
    df = spark.range(10000).select(F.col("id").cast("double").alias("x"), F.sin(F.col("id") * 0.01).alias("y"))
    x, y = np.arange(10000.0), np.sin(np.arange(10000) * 0.01)
    got = reduce.lttb(order_rows(df, "x", layout=SMALL), "x", "y", 500).orderBy("pick").collect()
    assert len(got) == 500 and got[0].x == 0.0 and got[-1].x == 9999.0
    assert [g[ROW] for g in got] == lttb_ref(x, y, 500, 1)


def envelope_ref(y, k):
    n, out = len(y), set()
    for b in range(k):
        s = range(b * n // k, (b + 1) * n // k)
        out |= {min(s, key=lambda i: (y[i], i)), min(s, key=lambda i: (-y[i], i))}
    return sorted(out)


def test_envelope(data):
    rows, df = data
    got = both(df, lambda o: reduce.minmax_envelope(o, "t", "u", 37), [ROW])
    assert [r[0] for r in got] == envelope_ref([r[4] for r in rows], 37)


def spline_ref(x, y):
    n = len(x)
    a, d = np.zeros((n, n)), np.zeros(n)
    a[0, 0] = a[-1, -1] = 1.0
    for i in range(1, n - 1):
        h0, h1 = x[i] - x[i - 1], x[i + 1] - x[i]
        a[i, i - 1 : i + 2] = h0, 2 * (h0 + h1), h1
        d[i] = 6 * ((y[i + 1] - y[i]) / h1 - (y[i] - y[i - 1]) / h0)
    return np.linalg.solve(a, d)


def test_cubic_resample(data):
    rows, df = data
    keep = [(r[2], r[3]) for r in rows if r[3] is not None]
    x, y = np.array([k[0] for k in keep]), np.array([k[1] for k in keep])
    m = spline_ref(x, y)
    grid = x[0] + (x[-1] - x[0]) * np.arange(777) / 776
    i = np.clip(np.searchsorted(x, grid, side="right") - 1, 0, len(x) - 2)
    h = x[i + 1] - x[i]
    a, b = (x[i + 1] - grid) / h, (grid - x[i]) / h
    want = a * y[i] + b * y[i + 1] + ((a**3 - a) * m[i] + (b**3 - b) * m[i + 1]) * h * h / 6
    for lay in (Layout(rows_per_bucket=150, min_block=128), WHOLE):
        got = reduce.resample(order_rows(df, "i", layout=lay), "t", "y", 777, "cubic").orderBy("k").collect()
        assert np.allclose([g.y for g in got], want, atol=1e-9)


@pytest.mark.parametrize("n", [1200, 997])
def test_psd_split_equals_whole(spark, n):
    r = np.random.default_rng(n)
    v = r.normal(size=n) + 3
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i int, y double")
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1))
    f = np.fft.rfft((v - v.mean()) * w)[1 : n // 2]
    for direct in (1 << 20, 10):
        got = spectral.psd(order_rows(df, "i", layout=SMALL), "y", 10.0, direct_rows=direct).orderBy("k").collect()
        assert np.allclose([g.power for g in got], np.abs(f) ** 2 / n)
        assert np.allclose([g.frequency for g in got], np.arange(1, n // 2) * 10.0 / n)


@pytest.mark.parametrize("n,window", [(434, 256), (2000, 256), (100, 17), (512, 256), (15, 16)])
def test_stft_frames(spark, n, window):
    v = np.sin(np.arange(n) / 10.0)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i int, y double")
    hop, want, start = window // 2, [], 0
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(window) / (window - 1))
    while start + window <= n:
        want.append(np.abs(np.fft.rfft(v[start : start + window] * win))[:hop])
        start += hop
    if n >= window and start < n:
        part = np.zeros(window)
        part[: n - start] = v[start:][:window]
        want.append(np.abs(np.fft.rfft(part * win))[:hop])
    got = spectral.stft(order_rows(df, "i", layout=SMALL), "y", window).orderBy("frame", "bin").collect()
    assert np.allclose([g.magnitude for g in got], np.ravel(want))


def test_psd_per_series_long_and_short(spark):
    r = np.random.default_rng(1)
    v = {"long": r.normal(size=900), "short": r.normal(size=60), "tiny": r.normal(size=3)}
    rows = [(g, i, float(x)) for g, s in v.items() for i, x in enumerate(s)]
    df = spark.createDataFrame(rows, "g string, i int, y double")
    got = spectral.psd(order_rows(df, "i", "g"), "y", direct_rows=100).orderBy("g", "k").collect()
    want = []
    for g in ("long", "short"):
        n = len(v[g])
        w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1))
        want += list(np.abs(np.fft.rfft((v[g] - v[g].mean()) * w)[1 : n // 2]) ** 2 / n)
    assert np.allclose([x.power for x in got], want)


def _candidates_hold_the_winner(seg, x, y):
    at = set(reduce.hull_candidates(seg, x, y, np.arange(len(x))).tolist())
    rng = np.random.default_rng(0)
    for _ in range(40):
        px, py, ax, ay = rng.integers(-30, 30, 4)
        for s in np.unique(seg):
            own = np.flatnonzero(seg == s)
            area = np.abs((px - ax) * (y[own] - py) - (px - x[own]) * (ay - py))
            assert own[np.argmax(area)] in at
    return at


def test_hull_candidates_hold_every_winner():
    rng = np.random.default_rng(5)
    for size in (1, 2, 3, 5, 40, 300):
        for span in (1, 2, 4, 40):
            x, y = rng.integers(0, span, size), rng.integers(0, span, size)
            _candidates_hold_the_winner(rng.integers(0, 3, size), x, y)
            _candidates_hold_the_winner(np.zeros(size, dtype=int), np.sort(x), y)
            _candidates_hold_the_winner(np.zeros(size, dtype=int), np.arange(size), np.full(size, span))
            _candidates_hold_the_winner(np.zeros(size, dtype=int), rng.permutation(size), 3 * np.arange(size))
    i = np.arange(5000)
    assert len(reduce.hull_candidates(i * 0, i, i * 0 + 7, i)) == 2  # flat
    assert len(reduce.hull_candidates(i * 0, i, 3 * i + 1, i)) == 2  # collinear
    assert len(reduce.hull_candidates(i * 0, i * 0, i % 7, i)) <= 3  # upright
    assert len(reduce.hull_candidates(i * 0, i * 7919 % 10007, i * 31 % 1009, i)) < 100  # unsorted
    assert len(reduce.hull_candidates(i * 0, i, -((i - 2500) ** 2), i)) == 5000  # convex: all stay
    assert len(reduce.hull_candidates(i * 0, i, np.where(i % 2, -((i - 2500) ** 2), -7 * 10**6), i)) == 2502  # thinned and finished


SHAPES = {
    "flat": lambda i: (i, i * 0 + 5),
    "steps": lambda i: (i, i // 300 % 3 * 8),
    "line": lambda i: (i, i * 4),
    "unsorted": lambda i: (i * 7919 % 3001, i * 31 % 101),
    "upright": lambda i: (i * 0 + 2, i * 17 % 64),
    "spikes": lambda i: (i, np.where(i % 250 == 7, 1000, 0)),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_lttb_of_degenerate_shapes(spark, shape, monkeypatch):
    n, target = 2050, 258  # buckets of 8 rows, so that means are exact
    monkeypatch.setattr(reduce, "CHAIN_BUCKETS", 8)
    monkeypatch.setattr(reduce, "CHAIN_ROWS", 8)
    monkeypatch.setattr(reduce, "FAN", 3)
    x, y = (a.astype(float) for a in SHAPES[shape](np.arange(n)))
    df = spark.createDataFrame([(k, i, float(a), float(b)) for k in ("p", None) for i, (a, b) in enumerate(zip(x, y))], "k string, i int, x double, y double")
    o = order_rows(df, "i", "k", layout=SMALL)
    got = reduce.lttb(o, "x", "y", target).collect()
    for k in ("p", None):
        mine = sorted((g["pick"], g[ROW]) for g in got if g["k"] == k)
        assert [p for p, _ in mine] == list(range(target))
        assert [r for _, r in mine] == lttb_ref(x, y, target, 1)


@pytest.mark.parametrize("shape", ["flat", "steps", "line", "unsorted", "upright"])
def test_lttb_groups_hold_few_rows(spark, shape):
    n, target = 20000, 40
    x, y = (a.astype(float) for a in SHAPES[shape](np.arange(n)))
    o = order_rows(spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "i int, x double, y double"), "i", layout=SMALL)
    parts = reduce._hull_parts(with_series_size(o.select("x", "y")), target, 1)
    blocks = n // o.block + target
    assert parts.filter("role = 1").count() <= 24 * blocks
    assert parts.groupBy("bucket", "role").count().agg(F.max("count")).collect()[0][0] <= 24 * (n // target // o.block + 2)


def test_many_long_series_in_one_transform(spark):
    rng = np.random.default_rng(8)
    sizes = {f"s{i}": (60, 61, 64, 67, 90, 127)[i % 6] for i in range(150)} | {"few": 3, None: 71, "short": 9}
    values = {k: rng.normal(size=n) for k, n in sizes.items()}
    df = spark.createDataFrame([(k, i, float(v)) for k, a in values.items() for i, v in enumerate(a)], "g string, i int, y double").repartition(4)
    out = spectral.psd(order_rows(df, "i", "g"), "y", 4.0, direct_rows=50)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Union") <= 2
    got = {}
    for r in out.collect():
        got.setdefault(r.g, {})[r.k] = (r.frequency, r.power)
    for g, v in values.items():
        n = len(v)
        win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1))
        want = np.abs(np.fft.rfft((v - v.mean()) * win)) ** 2 / n
        mine = got.get(g, {})
        assert sorted(mine) == (list(range(1, n // 2)) if n >= 4 else [])
        assert all(abs(p - want[k]) < 1e-9 and abs(f - 4.0 * k / n) < 1e-12 for k, (f, p) in mine.items())


@pytest.mark.parametrize("window", [66, 151, 999, 5000])
def test_wide_moving_average(spark, window):
    rng = np.random.default_rng(window)
    sizes = {"a": 1000, "b": 40, None: 399}
    values = {g: [None if i in (300, 301, 777) else float(v) for i, v in enumerate(rng.normal(size=n))] for g, n in sizes.items()}
    df = spark.createDataFrame([(g, i, v) for g, a in values.items() for i, v in enumerate(a)], "g string, i int, v double").repartition(3)
    for lay in (SMALL, WHOLE):
        got = {(r.g, r.i): r.r for r in windows.moving_average(order_rows(df, "i", "g", layout=lay), "v", window, "r").collect()}
        for g, a in values.items():
            for i in range(len(a)):
                part = a[max(0, i - window // 2) : i + window // 2 + 1]
                want = None if None in part else sum(part) / len(part)
                assert got[g, i] is None if want is None else abs(got[g, i] - want) < 1e-9, (g, i)


def test_envelope_aggregates_by_hash(spark):
    rows = [(g, i, float(i), float(i * 7 % 11) if i % 5 else None) for g, n in (("a", 500), ("b", 20), (None, 90)) for i in range(n)]
    o = order_rows(spark.createDataFrame(rows, "g string, i int, x double, y double"), "i", "g", layout=SMALL)
    out = reduce.minmax_envelope(o, "x", "y", 30)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    got = {g: sorted(r[ROW] for r in out.filter(F.col("g").eqNullSafe(F.lit(g))).collect()) for g in ("a", "b", None)}
    assert got["b"] == list(range(20))
    for g, n in (("a", 500), (None, 90)):
        want = set()
        for b in range(30):
            own = [i for i in range(b * n // 30, (b + 1) * n // 30) if i % 5]
            if own:
                want |= {min(own, key=lambda i: (i * 7 % 11, i)), min(own, key=lambda i: (-(i * 7 % 11), i))}
        assert got[g] == sorted(want)
