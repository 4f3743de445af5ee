"""Small worked examples with known answers."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline import Layout, order_rows
from strandline.functions import fx
from strandline.functions.times import format_epoch
from strandline.functions.units import channel_role, infer_unit
from strandline.operators import reduce, rows, spectral, stats, windows
from strandline.operators.derive import derive, derive_op
from strandline.operators.qc import _resolve, health_check
from strandline.plans import report, staging
from strandline.plans.layout import ROW
from tests.conftest import SMALL


def frame(spark, **cols):
    names = list(cols)
    data = [(i, *[None if v is None else float(v) for v in r]) for i, r in enumerate(zip(*cols.values()))]
    return spark.createDataFrame(data, "i int, " + ", ".join(f"`{n}` double" for n in names))


def ordered(spark, **cols):
    return order_rows(frame(spark, **cols), "i", layout=SMALL)


def col(df, name, by="i"):
    return [r[name] for r in df.orderBy(by).collect()]


def one(spark, *values):
    return spark.range(1).select(*[v.alias(f"v{i}") for i, v in enumerate(values)]).first()


def test_formulas(spark):
    df = frame(spark, ax=[3] * 5, ay=[4] * 5, az=[0] * 5)
    mag = fx.sqrt(fx.add(fx.add(fx.power("ax", 2), fx.power("ay", 2)), fx.power("az", 2)))
    assert col(derive(df, "m", mag), "m") == [5.0] * 5
    assert derive(df, "m", fx.deg(fx.atan2("ay", "ax"))).first().m == pytest.approx(53.13010235)
    assert derive(df, "m", fx.flag(fx.and_(fx.gt("ax", 2), fx.lt("ay", 5)))).first().m == 1.0
    assert derive(df, "m", fx.flag(fx.or_(fx.gt("ax", 5), fx.eq("az", 0)))).first().m == 1.0
    assert derive(df, "m", fx.flag(fx.eq("ax", "ay"))).first().m == 0.0
    assert derive(df, "ax", fx.num("ay")).columns[-1] == "ax (2)"
    with pytest.raises(Exception):
        derive(df, "m", fx.num("nope")).collect()


def test_quoted_names(spark):
    df = frame(spark, **{"T3 X": [3] * 3, "Temp PV °C": [4] * 3})
    assert derive(df, "s", fx.add("T3 X", "Temp PV °C")).first().s == 7.0


def test_ieee_corners(spark):
    nan, inf, null = float("nan"), float("inf"), F.lit(None).cast("double")
    r = one(
        spark, fx.div(1, 0), fx.div(-1, 0), fx.stored(fx.div(0, 0)), fx.ln(0), fx.stored(fx.ln(-1)), fx.exp(fx.ln(0)),
        fx.sign(0), fx.sign(F.lit(-0.0)), fx.sign(-3), fx.least(null, 2), fx.greatest(F.lit(nan), 2), fx.least(null, F.lit(nan)),
        fx.power(null, 0), fx.floor(1e300), fx.round_(-2.5), fx.ceil(-0.2), fx.flag(fx.ne(null, 5)), fx.flag(fx.eq(F.lit(nan), F.lit(nan))),
        fx.flag(fx.gt(F.lit(nan), 1)), fx.flag(fx.lt(1, F.lit(nan))), fx.flag(fx.truthy(null)), fx.keep(F.lit(nan)),
    )
    assert list(r) == [
        inf, -inf, None, -inf, None, 0.0, 1.0, -1.0, -1.0, 2.0, 2.0, inf, 1.0, 1e300, -3.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, False,
    ]


def test_filters(spark):
    df = frame(spark, ax=[3, 3, 99, 3, 3])
    assert col(rows.filter_rows(df, fx.gt("ax", 50)), "i") == [2]
    d = spark.createDataFrame([(2, "bob"), (10, "alice"), (1, "carol")], "n int, name string")
    o = order_rows(d.withColumn("i", F.monotonically_increasing_id()), "i").df.drop("i").orderBy(ROW)
    assert [r.n for r in rows.sort_rows(o, "n").collect()] == [1, 2, 10]
    assert [r.n for r in rows.sort_rows(o, "n", desc=True).collect()] == [10, 2, 1]
    assert [r.name for r in rows.sort_rows(o, "name").collect()] == ["alice", "bob", "carol"]
    assert [r.name for r in rows.search(o, "AL").collect()] == ["alice"]
    assert rows.RowQuery(filters={"n": rows.RangeFilter(low=2)}).total(o).first().total == 2
    assert rows.RowQuery(filters={"name": rows.TextFilter("o")}).total(o).first().total == 2
    assert len(rows.RowQuery().page(o, 1, 500).collect()) == 2
    assert rows.RowQuery().page(o, 10).collect() == []


def test_blank_cells_sort_last_then_first(spark):
    d = spark.createDataFrame([(0, "2"), (1, "x"), (2, "10"), (3, "")], f"{ROW} int, v string")
    assert [r.v for r in rows.sort_rows(d, "v", numeric=True).collect()] == ["2", "10", "x", ""]
    assert [r.v for r in rows.sort_rows(d, "v", desc=True, numeric=True).collect()] == ["x", "", "10", "2"]


def test_filter_reaches_the_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    plan = rows.filter_rows(df, fx.gt("l_quantity", 25)).select("l_tax")._jdf.queryExecution().toString()
    assert "GreaterThan(l_quantity,25.0)" in plan and "ReadSchema: struct<l_quantity:double,l_tax:double>" in plan


def test_derive_arity(spark):
    df = frame(spark, a=[1, 2], b=[4, 0])
    assert col(derive_op(df, "ratio", ["a", "b"]), "ratio_a_b") == [0.25, None]
    assert col(derive_op(df, "scale", ["a"], "s", 2, 1), "s") == [3.0, 5.0]
    assert col(derive_op(df, "mean", ["a", "b"], "m"), "m") == [2.5, 1.0]
    with pytest.raises(ValueError):
        derive_op(df, "subtract", ["a"])
    with pytest.raises(ValueError):
        windows.rolling(order_rows(df, "i"), "mean", "a", 1, "r")


def test_resolve(spark):
    df = frame(spark, temp=[1], pressure=[2])
    assert [_resolve(df, s) for s in ("temp", "2", "nope", "9")] == ["temp", "pressure", None, None]


def test_rolling_and_transforms(spark):
    assert col(windows.rolling(ordered(spark, v=[0, 2, 4, 6]), "mean", "v", 2, "r"), "r") == [0, 1, 3, 5]
    r = col(windows.rolling(ordered(spark, a=range(6), b=range(0, 12, 2)), "corr", "a", 3, "r", "b"), "r")
    assert r[0] is None and r[5] == pytest.approx(1.0)
    assert col(windows.moving_average(ordered(spark, v=[1, 2, 3, 4, 5]), "v", 3, "r"), "r") == [1.5, 2, 3, 4, 4.5]
    assert col(windows.derivative(ordered(spark, x=range(4), y=[0, 2, 4, 6]), "x", "y", "r"), "r") == [2.0] * 4
    assert col(windows.integral(ordered(spark, x=range(4), y=[1] * 4), "x", "y", "r"), "r") == [0, 1, 2, 3]
    assert col(windows.normalize(ordered(spark, v=[10, 20, 30]), "v", "r"), "r") == [0, 0.5, 1]
    assert sum(col(windows.normalize(ordered(spark, v=[1, 2, 3]), "v", "r", "zscore"), "r")) == pytest.approx(0)
    assert col(windows.normalize(ordered(spark, v=[4, None, 4]), "v", "r"), "r") == [0.5] * 3
    assert col(windows.normalize(ordered(spark, v=[4, 4]), "v", "r", "zscore"), "r") == [0.0] * 2


def test_moving_average_spoiled_by_missing(spark):
    got = col(windows.moving_average(ordered(spark, v=[1, None, 3, 4, 5]), "v", 3, "r"), "r")
    assert got == [None, None, None, 4.0, 4.5]


def test_statistics(spark):
    df = frame(spark, a=[1, 2, 3, 4, 5], b=[2, 4, 6, 8, 10], c=[5, 4, 3, 2, 1], k=[1] * 5)
    r = {(x.a, x.b): x.r for x in stats.correlation_matrix(df, ["a", "b", "c", "k"]).collect()}
    assert (r["a", "b"], r["a", "c"], r["a", "k"], r["b", "a"], r["k", "k"]) == (1.0, -1.0, None, 1.0, 1.0)
    m = stats.median_mad(frame(spark, v=[3, 1, 4, 2, 100]), "v").first()
    assert (m.median, m.mad) == (3.0, 1.0)
    p = stats.percentiles(frame(spark, v=range(10)), "v", {"p0": 0, "p50": 0.5, "p100": 1}).first()
    assert (p.p0, p.p50, p.p100) == (0.0, 5.0, 9.0)
    vals = [i / 98 for i in range(99)] + [1e9]
    assert stats.percentiles(frame(spark, v=vals), "v", {"p": 0.99}, layout=SMALL).first().p < 2
    assert stats.percentiles(frame(spark, v=[None, None]), "v", {"p": 0.5}).first().p is None
    with pytest.raises(ValueError):
        stats.correlations(df, ["a"])


def test_nan_and_infinity_are_missing(spark):
    df = frame(spark, v=[1, float("nan"), 3, float("inf"), None, 2])
    s = stats.summary_stats(df, ["v"]).first()
    assert (s["count"], s.min, s.max, s.mean, s.median) == (3, 1.0, 3.0, 2.0, 2.0)
    assert stats.summary_stats(frame(spark, v=[None]), ["v"]).count() == 0
    d = stats.describe(order_rows(df, "i"), ["v"]).first()
    assert (d.n_total, d.n_missing, d.longest_run) == (6, 3, 1)
    assert stats.data_bounds(frame(spark, v=[7, 7]), "v").first().asDict() == {"y_min": 6.0, "y_max": 8.0}


def test_histogram(spark):
    h = stats.histogram(frame(spark, v=[0] * 400 + [25] * 600), "v", 30).orderBy("bin").collect()
    assert [r["count"] for r in h] == [400] + [0] * 28 + [600] and h[0].n == 1000
    assert stats.histogram(frame(spark, v=[1]), "v", 30).count() == 0
    assert stats.histogram(frame(spark, v=[1, 2]), "v", 1).count() == 2
    tie = stats.modal_bin(stats.histogram(frame(spark, v=[0, 0, 1, 1]), "v", 2)).first()
    assert tie.bin == 1


def test_segments(spark):
    s = stats.segment_stats(ordered(spark, v=[1, 1, 1, 5, 5, None]), ["v"], 3).orderBy("segment").collect()
    assert [(r.row_start, r.row_end, r["mean"]) for r in s] == [(0, 2, 1.0), (2, 4, 3.0), (4, 6, 5.0)]
    s = stats.segment_stats(ordered(spark, v=[1, None]), ["v"], 2).orderBy("segment").collect()
    assert [r.note for r in s] == [None, "no finite values"]


def test_sample_rate(spark):
    df = spark.range(20).select("id", F.timestamp_seconds(F.lit(1782921600) + F.col("id") * 2).alias("t"))
    assert stats.sample_rate(order_rows(df, "id"), "t").first().sample_rate == pytest.approx(0.5)
    same = df.withColumn("t", F.lit(5.0))
    assert stats.sample_rate(order_rows(same, "id"), "t").first().sample_rate == 1.0


def test_spectrum_peak(spark):
    v = [math.sin(2 * math.pi * 5 * i / 100) for i in range(4000)]
    p = spectral.top_peaks(spectral.psd(ordered(spark, v=v), "v", 100.0)).first()
    assert abs(p.frequency_hz - 5) < 0.5
    assert spectral.psd(ordered(spark, v=[1, 2, 3]), "v").count() == 0


def test_view_modes(spark):
    o = ordered(spark, x=range(1000), y=range(1000))
    v = reduce.view_downsample(o, "x", "y", 100, 200, 2000, "none").orderBy("x").collect()
    assert len(v) == 103 and (v[0].x, v[-1].x) == (99.0, 201.0)
    o = ordered(spark, x=range(5000), y=[1e6 if i == 2500 else 0 for i in range(5000)])
    m = reduce.view_downsample(o, "x", "y", 0, 4999, 400, "minmax").collect()
    assert len(m) <= 400 and max(r.y for r in m) == 1e6
    t = reduce.downsample(ordered(spark, x=range(500), y=range(500)), "x", "y", 40, "lttb").count()
    assert 3 < t <= 40
    assert reduce.downsample(ordered(spark, x=range(50), y=range(50)), "x", "y", 50, "odd name").count() == 50


def test_envelope_keeps_spike(spark):
    o = ordered(spark, x=range(1000), y=[1e6 if i == 640 else 0 for i in range(1000)])
    e = reduce.minmax_envelope(o, "x", "y", 100).collect()
    assert len(e) < 1000 and any(r.y == 1e6 for r in e)
    assert reduce.minmax_envelope(ordered(spark, x=range(3), y=range(3)), "x", "y", 100).count() == 3


def test_resample(spark):
    line = reduce.resample(ordered(spark, x=[0, 2, 4], y=[0, 4, 8]), "x", "y", 5)
    assert col(line, "y", "k") == [0, 2, 4, 6, 8]
    near = col(reduce.resample(ordered(spark, x=[0, 10], y=[10, 20]), "x", "y", 11, "nearest"), "y", "k")
    assert near == [10.0] * 6 + [20.0] * 5
    cube = col(reduce.resample(ordered(spark, x=range(4), y=[0, 1, 8, 27]), "x", "y", 4, "cubic"), "y", "k")
    assert cube == pytest.approx([0, 1, 8, 27])
    g = reduce.resample(ordered(spark, x=[1, 5, 9], y=[1, 5, 9]), "x", "y", 100).orderBy("k").collect()
    assert (len(g), g[0].x, g[-1].x) == (100, 1.0, 9.0)
    assert reduce.resample(ordered(spark, x=[1], y=[2]), "x", "y", 10).count() == 1
    flat = reduce.resample(ordered(spark, x=[3, 3], y=[7, 8]), "x", "y", 4).collect()
    assert [r.y for r in flat] == [7.0] * 4


def test_time_text(spark):
    r = one(spark, format_epoch(F.lit(0.0)), format_epoch(F.lit(1.25)), format_epoch(F.lit(-0.5)))
    assert list(r) == ["1970-01-01 00:00:00", "1970-01-01 00:00:01.250", "1969-12-31 23:59:59.500"]


def test_units_and_roles(spark):
    names = ["Temp1", "Azimuth", "GX", "Gamma", "flow", "Bus V", "current", "Mag1", "RPM", "depth"]
    want = ["°C", "Degrees", "G", "CPS", "Counts", "V", "mA", "Gauss", "RPM", "units"]
    assert list(one(spark, *[infer_unit(F.lit(n)) for n in names])) == want
    assert list(one(spark, *[channel_role(F.lit(n)) for n in ("raw_x", "calibrated_x", "x")])) == [0, 2, 1]


def faults(spark):
    n = 600
    return ordered(
        spark, good=[math.sin(i / 30) for i in range(n)], dead=[0] * n,
        glitchy=[1e6 if i == 250 else math.sin(i / 12) for i in range(n)],
        static_start=[50 if i < 100 else math.sin(i / 17) for i in range(n)],
    )


def test_health_check_faults(spark):
    f = health_check(faults(spark), ["good", "dead", "glitchy", "static_start"]).collect()
    got = {(r.kind, r.column) for r in f}
    assert ("dead", "dead") in got and ("glitch", "glitchy") in got
    assert ("outlier_regime", "static_start") in got and ("glitch", "static_start") not in got
    assert ("changepoint", "glitchy") not in got
    assert [r.severity for r in f] == sorted((r.severity for r in f), key=["high", "medium", "low"].index)


def test_health_check_source(spark):
    a = [math.sin(i / 25) + (10 if i > 500 else 0) for i in range(1000)]
    o = ordered(spark, raw_ax2=a, calibrated_az=[0.7 * v for v in a])
    f = [r for r in health_check(o, ["raw_ax2", "calibrated_az"]).collect() if r.kind == "regime_change_event"]
    assert len(f) == 1 and f[0].culprit == ["raw_ax2"] and set(f[0].affected) == {"raw_ax2", "calibrated_az"}
    assert f[0].severity == "high"


def test_clean_data_is_clean(spark):
    o = ordered(spark, v=[math.sin(i / 30) for i in range(100)])
    found = health_check(o, ["v"], ordered=False)
    v = report.verdict(found).first()
    assert (v.verdict_class, v.verdict_text) == ("clean", "No issues found — clean.")
    assert report.flagged_rows(found, None).count() == 0 and report.first_flagged(o, found, None).count() == 0


def test_report_tables(spark, tmp_path):
    o = faults(spark)
    t = report.qc_report(o, ["good", "dead", "glitchy", "static_start"])
    assert set(t) == {"summary", "findings", "severity_counts", "verdict", "overview", "plots", "flagged"}
    assert t["summary"].first().n_rows == 600
    assert t["flagged"].count() == 50 and {r.column for r in t["plots"].collect()} == {"glitchy", "static_start"}
    assert t["overview"].select("panel").distinct().count() == 4
    report.write_report(t, str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report" / "findings")).count() == t["findings"].count()


def test_wide_correlations_match_plain_ones(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 9)) + 1e6
    x[:, 1] = x[:, 0] * 2 + rng.normal(size=300)
    cells = [[None if rng.random() < 0.1 else float(v) for v in row] for row in x]
    df = spark.createDataFrame([(*r, 4.0) for r in cells], ", ".join(f"c{i} double" for i in range(10))).repartition(5)
    cols = df.columns
    wide = {(r.a, r.b): r.r for r in stats.correlations(df, cols).collect()}
    plain = {(r.a, r.b): r.r for r in stats.correlations(df, cols, direct=99).collect()}
    assert wide.keys() == plain.keys() and len(wide) == 45
    assert all(wide[k] is None for k in wide if "c9" in k)  # no spread
    assert all(abs(wide[k] - plain[k]) < 1e-8 for k in wide if "c9" not in k)
    # a constant column has no r, so none of its pairs is ranked
    many = spark.range(50).select(*[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)).cast("double").alias(f"v{i}") for i in range(200)], F.lit(4.0).alias("flat"))
    assert stats.ranked_pairs(many, many.columns).count() == 200 * 199 // 2 and stats.ranked_pairs(many, many.columns, 5).count() == 5


def test_names_that_differ_in_case_are_taken(spark):
    df = spark.createDataFrame([(1.0,)], "temp double")
    assert derive(df, "TEMP", F.lit(2.0)).columns == ["temp", "TEMP (2)"]


def test_nested_formulas_grow_with_their_depth(spark):
    df = spark.createDataFrame([(7.9,), (-0.0,), (None,)], "v double")
    sizes = []
    for depth in (4, 12):
        c = F.col("v")
        for _ in range(depth):
            c = fx.floor(fx.ln(c))
        sizes.append(len(str(c)))
        assert df.select(c.alias("r")).count() == 3
    assert sizes[1] < 6 * sizes[0]


def test_a_scope_removes_what_it_staged(spark):
    with staging.staged_scope(spark):
        kept = staging.stage(spark.range(5))
        files = kept.inputFiles()
        assert kept.count() == 5
    assert files and not any(os.path.exists(f.removeprefix("file://")) for f in files)


@pytest.mark.parametrize("desc", [False, True])
@pytest.mark.parametrize("sort", ["v", "t", None])
def test_deep_pages_sort_only_what_they_touch(spark, monkeypatch, sort, desc):
    monkeypatch.setattr(rows, "TOP_ROWS", 100)
    n = 5000
    cells = [(i, None if i % 50 == 3 else float(i * 37 % 1009), None if i % 60 == 7 else f"t{i * 11 % 97}") for i in range(n)]
    df = spark.createDataFrame(cells, "row_idx int, v double, t string").repartition(6)
    whole = [r.row_idx for r in rows.sort_rows(df, sort, desc).collect()]
    q = rows.RowQuery(sort=sort, desc=desc)
    lay = Layout(rows_per_bucket=300)
    for offset, limit in ((100, 1), (2990, 40), (4990, 40), (0, 5000), (4999, 1), (6000, 10)):
        assert [r.row_idx for r in q.page(df, offset, limit, layout=lay).collect()] == whole[offset : offset + limit]
    touched, _, _ = rows.page_ranges(df, sort, desc, ["row_idx"], 2990, 40, lay)
    assert touched.count() < 1500
    assert touched.groupBy("_bucket").count().agg(F.max("count")).collect()[0][0] < 900


def test_a_page_a_million_rows_down(spark):
    df = spark.range(0, 1_200_000, 1, 8).select(F.col("id").alias("row_idx"), (F.col("id") * 7919 % 1_200_007).cast("double").alias("v"))
    got = rows.RowQuery(sort="v").page(df, 1_000_000, 5)
    assert "TakeOrdered" not in got._jdf.queryExecution().executedPlan().toString()
    assert [r.v for r in got.collect()] == sorted(i * 7919 % 1_200_007 for i in range(1_200_000))[1_000_000:1_000_005]


def test_nearest_join_with_any_order(spark):
    from strandline.operators import align

    left = spark.createDataFrame([(0.0, "a"), (5.0, "b"), (9.5, "c")], "x double, o string")
    right = spark.createDataFrame([(4.0, "k", 1), (4.0, "m", 2), (10.0, "k", 3), (10.0, "j", 4)], "x double, o string, v int")
    got = sorted((r.o, r.row2, r.r_v, r.distance) for r in align.nearest_join(left, right, "x", "o", 2.0).collect())
    assert got == [("b", "m", 2, 1.0), ("c", "j", 4, 0.5)]
    at = lambda d: d.withColumn("o", F.to_timestamp(F.concat(F.lit("2024-01-0"), F.ascii("o") - 96 - F.when(F.col("o") >= "j", 8).otherwise(0))))
    assert align.nearest_join(at(left), at(right), "x", "o", 2.0).count() == 2
    assert align.nearest_join(left, right, "x", "o", 0.1).count() == 0


def test_scopes_nest_and_stay_apart(spark, tmp_path):
    import os
    from concurrent.futures import ThreadPoolExecutor

    from strandline.plans import staging

    def made(df):
        return df.inputFiles()[0].rsplit("/", 1)[0].replace("file://", "")

    with staging.staged_scope(spark):
        with staging.staged_scope(spark):
            inner, kept = staging.stage(spark.range(3)), staging.stage(spark.range(3), outer=True)
            gone, stays = made(inner), made(kept)
        assert not os.path.exists(gone) and os.path.exists(stays)
        with ThreadPoolExecutor(1) as pool:  # another thread is no part of the scope
            other = made(pool.submit(lambda: staging.stage(spark.range(2))).result())
    assert not os.path.exists(stays) and os.path.exists(other)


@pytest.mark.parametrize("sizes", [{}, {"cell_rows": 40, "tile_points": 30, "tile_queries": 50}])
def test_nearest_rows_of_many_queries(spark, sizes):
    from strandline.operators import align

    rng = np.random.default_rng(4)
    pts = np.concatenate([rng.integers(0, 30, (500, 2)), rng.normal(200, 0.1, (400, 2)), np.full((300, 2), 7.0)]).astype(float)
    ask = np.concatenate([rng.integers(-40, 240, (900, 2)), rng.normal(200, 0.1, (400, 2)), [[1e6, -1e6], [7, 7]]]).astype(float)
    df = spark.createDataFrame([(int(5000 - i), float(a), float(b)) for i, (a, b) in enumerate(pts)] + [(1, None, 2.0), (2, float("nan"), 2.0)], "id int, x double, y double")
    q = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(ask)] + [(9000, None, 1.0), (9001, float("inf"), 0.0)], "k int, qx double, qy double")
    got = {r.k: (r.row, r.distance) for r in align.nearest_rows(df, "x", "y", "id", q, **sizes).collect()}
    rows = 5000 - np.arange(len(pts))
    for i, (a, b) in enumerate(ask):
        d = np.sqrt((pts[:, 0] - a) * (pts[:, 0] - a) + (pts[:, 1] - b) * (pts[:, 1] - b))
        assert got[i] == (rows[d == d.min()].min(), d.min())
    assert got[9000] == got[9001] == (None, None) and len(got) == len(ask) + 2
    none = align.nearest_rows(df.limit(0), "x", "y", "id", q.limit(3))
    assert [r.row for r in none.collect()] == [None] * 3


def test_boxes_look_at_few_points(monkeypatch):
    from strandline.operators.align import Boxes

    rng = np.random.default_rng(5)
    pts = np.column_stack([rng.integers(1, 51, 16_000), 900 + rng.integers(0, 10_000, 16_000) / 100]).astype(float)
    ask = np.column_stack([rng.integers(-5, 56, 400), rng.uniform(10, 5000, 400)]).astype(float)
    looked, least = [], Boxes._least
    monkeypatch.setattr(Boxes, "_least", lambda self, leaf, at: looked.append(len(leaf) * self.leaves.shape[1]) or least(self, leaf, at))
    d, k = Boxes.grow(pts).nearest(ask)
    away = np.sqrt(((pts[None] - ask[:, None]) ** 2).sum(axis=2))
    assert (k == away.argmin(axis=1)).all() and (d == away.min(axis=1)).all()
    assert sum(looked) < len(pts) * len(ask) / 20


def test_report_looks_at_levels_once(spark, monkeypatch):
    from strandline.operators import qc
    from strandline.plans import report

    o = faults(spark)
    calls, real = [], qc.medians_and_deviations
    monkeypatch.setattr(qc, "medians_and_deviations", lambda *a: calls.append(a) or real(*a))
    t = report.qc_report(o, ["good", "dead", "glitchy", "static_start"])
    assert len(calls) == 1
    shown = {r.row_idx: r.glitchy for r in t["flagged"].collect()}
    kept = {r.row_idx: r.glitchy for r in o.df.collect()}
    assert shown and all(kept[k] == v for k, v in shown.items())


def test_short_series_share_transform_groups(spark):
    from strandline.operators import spectral

    shapes = [(1, 21), (8, 16), (16, 16), (181, 181), (300, 300)]
    rows = [(i, *shapes[i % 5], b) for i in range(2000) for b in range(shapes[i % 5][1])]
    d = spark.createDataFrame(rows, "sid long, n1 long, n2 long, line long")
    groups = d.groupBy(*spectral._groups()).agg(F.sum("n1").alias("numbers"), F.count_distinct("sid").alias("series")).collect()
    short = [g for g in groups if g._t is None]
    assert max(g.numbers for g in short) <= spectral.SHARED_NUMBERS
    assert max(g.series for g in groups if g._t is not None) == 1 and max(g.numbers for g in groups if g._t is not None) <= 64 * 300
    few = [g for g in short if g._l <= 8]
    assert sum(g.series for g in few) == 1200 and len(few) < 40

    # lengths that split, lengths that need a convolution, and one long enough for groups of its own
    rng = np.random.default_rng(6)
    lengths = [21, 64, 67, 67, 127, 500, 40_000]
    values = {i: rng.normal(size=n) for i, n in enumerate(lengths)}
    made = spark.createDataFrame([(i, j, float(v)) for i, vs in values.items() for j, v in enumerate(vs)], "s int, t int, y double")
    got = spectral.psd(order_rows(made, "t", "s"), "y", 1.0, direct_rows=20).toPandas()
    for i, v in values.items():
        n = len(v)
        want = np.abs(np.fft.rfft((v - v.mean()) * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1)))))[1 : n // 2] ** 2 / n
        power = got[got.s == i].sort_values("k")
        assert power.k.tolist() == list(range(1, n // 2)) and np.allclose(power.power, want, atol=1e-9)
