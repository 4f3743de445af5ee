"""Order-dependent series queries: rolling windows, differences, integrals, normalisation, alignment, spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import align, spectral, windows
from strandline.plans.report import transform
from strandline.queries.registry import EV, EV_BY, ROW, events, query, rounded, table, um

# root of value (no exact decimal ties when rounding) with every 11th row missing
HOLES = "CASE WHEN row_idx % 11 <> 3 THEN sqrt(value) END"


def _holed(o):
    v = F.when(F.col(ROW) % 11 != 3, F.sqrt("value"))
    return o.with_df(o.df.select(*o.by, ROW, "event_id", "x", "user_id", v.alias("v")))


ROLLING = {"mean": "avg(v)", "std": "stddev_pop(v)", "min": "min(v)", "max": "max(v)"}


def _rolling_sql(agg: str, w: int, ev: str = EV, part: str = "") -> str:
    return (
        f"WITH {ev}, h AS (SELECT *, {HOLES} AS v FROM ev) SELECT event_id, round({agg} OVER "
        f"({part} ORDER BY row_idx ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW), 6) AS r FROM h"
    )


def _rolling(stat, w, by=()):
    def run(spark, d):
        out = windows.rolling(_holed(events(spark, d, by)), stat, "v", w, "r")
        return rounded(out, 6, "r").select("event_id", "r")

    return run


for _stat, _agg in ROLLING.items():
    query(f"rolling_{_stat}", _rolling_sql(_agg, 20))(_rolling(_stat, 20))
    query(f"rolling_{_stat}_wide", _rolling_sql(_agg, 500))(_rolling(_stat, 500))
query("rolling_mean_by_series", _rolling_sql("avg(v)", 12, EV_BY, "PARTITION BY event_type"))(_rolling("mean", 12, "event_type"))


def _corr_sql(w: int) -> str:
    f = f"OVER (ORDER BY row_idx ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return (
        f"WITH {EV}, h AS (SELECT *, {HOLES} AS v FROM ev), "
        "p AS (SELECT event_id, row_idx, v AS a, CASE WHEN v IS NOT NULL THEN user_id::double END AS b FROM h), "
        f"s AS (SELECT event_id, count(a) {f} AS n, covar_pop(a, b) {f} AS c, stddev_pop(a) {f} AS sa, stddev_pop(b) {f} AS sb FROM p) "
        "SELECT event_id, CASE WHEN n >= 2 THEN round(c / nullif(sa * sb, 0), 6) END AS r FROM s"
    )


def _corr(w):
    def run(spark, d):
        out = windows.rolling(_holed(events(spark, d)), "corr", "v", w, "r", other="user_id")
        return rounded(out, 6, "r").select("event_id", "r")

    return run


query("rolling_corr", _corr_sql(30))(_corr(30))
query("rolling_corr_wide", _corr_sql(300))(_corr(300))


@query(
    "moving_average",
    f"WITH {EV}, h AS (SELECT *, {HOLES} AS v FROM ev) SELECT event_id, CASE WHEN count(v) OVER w = count(*) OVER w THEN round(avg(v) OVER w, 6) END AS r "
    "FROM h WINDOW w AS (ORDER BY row_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)",
)
def moving_average(spark, d):
    return rounded(windows.moving_average(_holed(events(spark, d)), "v", 5, "r"), 6, "r").select("event_id", "r")


@query(
    "moving_average_wide",
    f"WITH {EV}, h AS (SELECT *, CASE WHEN row_idx = n // 5 THEN NULL ELSE value END AS v FROM ev) SELECT event_id, CASE WHEN count(v) OVER w = count(*) OVER w THEN round(avg(v) OVER w, 6) END AS r "
    "FROM h WINDOW w AS (ORDER BY row_idx ROWS BETWEEN 4000 PRECEDING AND 4000 FOLLOWING)",
)
def moving_average_wide(spark, d):
    """8,001 rows a window, one of them missing a fifth of the way in."""
    o = events(spark, d)
    o = o.with_column("v", F.when(F.col(ROW) != o.n // 5, F.col("value")))
    return rounded(windows.moving_average(o, "v", 8000, "r"), 6, "r").select("event_id", "r")


@query("row_delta", f"WITH {EV} SELECT event_id, round(x - lag(x) OVER (ORDER BY row_idx), 6) AS dx FROM ev")
def row_delta(spark, d):
    return rounded(windows.row_delta(events(spark, d), "x", "dx"), 6, "dx").select("event_id", "dx")


@query(
    "derivative",
    f"WITH {EV}, s AS (SELECT event_id, coalesce(lag(x) OVER w, x) AS x0, coalesce(lead(x) OVER w, x) AS x1, coalesce(lag(value) OVER w, value) AS y0, "
    "coalesce(lead(value) OVER w, value) AS y1 FROM ev WINDOW w AS (ORDER BY row_idx)) SELECT event_id, round((y1 - y0) / nullif(x1 - x0, 0), 6) AS dy FROM s",
)
def derivative(spark, d):
    return rounded(windows.derivative(events(spark, d), "x", "value", "dy"), 6, "dy").select("event_id", "dy")


def _integral_sql(ev: str, part: str) -> str:
    return (
        f"WITH {ev}, s AS (SELECT event_id, row_idx, event_type, coalesce((x - lag(x) OVER w) * (value + lag(value) OVER w) / 2, 0) AS a "
        f"FROM ev WINDOW w AS ({part} ORDER BY row_idx)) SELECT event_id, round(sum(a) OVER ({part} ORDER BY row_idx), 2) AS area FROM s"
    )


@query("integral", _integral_sql(EV, ""))
def integral(spark, d):
    return rounded(windows.integral(events(spark, d), "x", "value", "area"), 2, "area").select("event_id", "area")


@query("integral_by_series", _integral_sql(EV_BY, "PARTITION BY event_type"))
def integral_by_series(spark, d):
    out = windows.integral(events(spark, d, "event_type"), "x", "value", "area")
    return rounded(out, 2, "area").select("event_id", "area")


@query("normalize_minmax", "SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 9) AS z FROM customer")
def normalize_minmax(spark, d):
    return rounded(windows.normalize(table(spark, d, "customer"), "c_acctbal", "z"), 9, "z").select("c_custkey", "z")


@query("normalize_zscore", "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS z FROM customer")
def normalize_zscore(spark, d):
    return rounded(windows.normalize(table(spark, d, "customer"), "c_acctbal", "z", "zscore"), 6, "z").select("c_custkey", "z")


@query(
    "normalized_overlay",
    "SELECT event_id, round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w), 9) AS z FROM events WINDOW w AS (PARTITION BY event_type)",
)
def normalized_overlay(spark, d):
    t = table(spark, d, "events")
    return rounded(windows.normalize(t, "value", "z", by=("event_type",)), 9, "z").select("event_id", "z")


@query("transform_log", f"WITH {EV} SELECT row_idx, CASE WHEN value > 0 AND isfinite(value) THEN round(ln(value), 9) END AS y FROM ev")
def transform_log(spark, d):
    o = events(spark, d)
    out = transform(o.with_df(o.df.select(ROW, "x", F.col("value").alias("y"))), "x", "y", "log")
    return rounded(out, 9, "y").select(ROW, "y")


# ---------------------------------------------------------------- alignment

SIDES = (
    "l AS (SELECT event_id, epoch_us(ts) / 1e6 AS x, value FROM events WHERE event_type = 'click'), "
    "r AS (SELECT event_id, epoch_us(ts) / 1e6 AS x, value FROM events WHERE event_type = 'purchase')"
)
NEAREST = (
    f"WITH {SIDES}, b AS (SELECT l.event_id, l.x, l.value, r.event_id AS e0, r.x AS x0, r.value AS v0 FROM l ASOF LEFT JOIN r ON l.x > r.x), "
    "c AS (SELECT b.*, r.event_id AS e1, r.x AS x1, r.value AS v1 FROM b ASOF LEFT JOIN r ON b.x <= r.x), "
    "p AS (SELECT *, x0 IS NOT NULL AND (x1 IS NULL OR x - x0 <= x1 - x) AS low FROM c), "
    "m AS (SELECT event_id, x, value, CASE WHEN low THEN e0 ELSE e1 END AS r_event_id, CASE WHEN low THEN x0 ELSE x1 END AS x2, CASE WHEN low THEN v0 ELSE v1 END AS r_value FROM p)"
)


def _sides(spark, d):
    t = table(spark, d, "events")
    t = t.select("event_id", epoch_cols(t), "value", "event_type")
    left = t.filter("event_type = 'click'").drop("event_type")
    return left, t.filter("event_type = 'purchase'").drop("event_type")


def epoch_cols(t):
    from strandline.functions.times import epoch_seconds

    return epoch_seconds(t, "ts").alias("x")


@query("nearest_join", NEAREST + " SELECT event_id, r_event_id, round(abs(x - x2), 6) AS distance FROM m WHERE abs(x - x2) <= 300")
def nearest_join(spark, d):
    m = align.nearest_join(*_sides(spark, d), "x", "event_id", 300.0)
    return rounded(m, 6, "distance").select("event_id", "r_event_id", "distance")


@query("nearest_join_unbounded", NEAREST + " SELECT event_id, r_event_id FROM m")
def nearest_join_unbounded(spark, d):
    return align.nearest_join(*_sides(spark, d), "x", "event_id").select("event_id", "r_event_id")


@query(
    "nearest_join_ties",
    "WITH l AS (SELECT o_orderkey, epoch_us(o_orderdate) / 1e6 AS x FROM orders WHERE o_orderpriority = '1-URGENT'), "
    "d AS (SELECT epoch_us(o_orderdate) / 1e6 AS x, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 1), "
    "b AS (SELECT l.*, d.x AS x0, d.last_key AS k0 FROM l ASOF LEFT JOIN d ON l.x > d.x), "
    "c AS (SELECT b.*, d.x AS x1, d.first_key AS k1 FROM b ASOF LEFT JOIN d ON b.x <= d.x) "
    "SELECT o_orderkey, CASE WHEN x0 IS NOT NULL AND (x1 IS NULL OR x - x0 <= x1 - x) THEN k0 ELSE k1 END AS row2 FROM c",
)
def nearest_join_ties(spark, d):
    from strandline.functions.times import epoch_seconds

    t = table(spark, d, "orders")
    t = t.select("o_orderkey", epoch_seconds(t, "o_orderdate").alias("x"), "o_orderpriority")
    left, right = t.filter("o_orderpriority = '1-URGENT'"), t.filter("o_orderpriority = '5-LOW'")
    return align.nearest_join(left, right, "x", "o_orderkey").select("o_orderkey", "row2")


# of right rows with one x: the last by event_id below the left x, the first at or above it; what is not finite is NULL
ARITHMETIC = (
    f"WITH {SIDES}, d AS (SELECT x, arg_max(struct_pack(v := value), event_id).v AS v_last, arg_min(struct_pack(v := value), event_id).v AS v_first FROM r GROUP BY x), "
    "b AS (SELECT l.event_id, l.x, l.value, d.x AS x0, d.v_last AS v0 FROM l ASOF LEFT JOIN d ON l.x > d.x), "
    "c AS (SELECT b.*, d.x AS x1, d.v_first AS v1 FROM b ASOF LEFT JOIN d ON b.x <= d.x), "
    "p AS (SELECT *, x0 IS NOT NULL AND (x1 IS NULL OR x - x0 <= x1 - x) AS low FROM c), "
    "m AS (SELECT event_id, x, value, CASE WHEN low THEN x0 ELSE x1 END AS x2, CASE WHEN low THEN v0 ELSE v1 END AS r_value FROM p), "
    f"o AS (SELECT event_id, value + r_value AS s, value - r_value AS d, value * r_value AS p, CASE WHEN abs(r_value) >= {align.EPSILON!r}::double THEN value / r_value END AS q "
    "FROM m WHERE abs(x - x2) <= 600) "
    "SELECT event_id, " + ", ".join(f"CASE WHEN isfinite({c}) THEN round({c}, 6) END AS y_{op}" for c, op in zip("sdpq", ("add", "subtract", "multiply", "divide"))) + " FROM o"
)


@query("series_arithmetic", ARITHMETIC)
def series_arithmetic(spark, d):
    m = align.nearest_join(*_sides(spark, d), "x", "event_id", 600.0)
    ops = ["add", "subtract", "multiply", "divide"]
    for op in ops:
        m = align.combine(m, "value", op, f"y_{op}")
    return rounded(m, 6, *[f"y_{op}" for op in ops]).select("event_id", *[f"y_{op}" for op in ops])


@query(
    "match_stats",
    NEAREST + " SELECT count(*) FILTER (abs(x - x2) <= 300) AS matched_count, least((SELECT count(*) FROM l), (SELECT count(*) FROM r)) AS total_possible FROM m",
)
def match_stats(spark, d):
    left, right = _sides(spark, d)
    return align.match_stats(left, right, align.nearest_join(left, right, "x", "event_id", 300.0))


POINTS = [(10.0, 950.0), (25.5, 1000.0), (50.0, 900.0), (-3.0, 1100.5)]


@query(
    "nearest_points",
    " UNION ALL ".join(
        f"SELECT {x}::double AS qx, {y}::double AS qy, arg_min(p_partkey, struct_pack(d := sqrt((p_size - {x}) ** 2 + (p_retailprice - {y}) ** 2), k := p_partkey)) AS row, "
        f"round(min(sqrt((p_size - {x}) ** 2 + (p_retailprice - {y}) ** 2)), 6) AS distance FROM part"
        for x, y in POINTS
    ),
)
def nearest_points(spark, d):
    return rounded(align.nearest_points(table(spark, d, "part"), "p_size", "p_retailprice", "p_partkey", POINTS), 6, "distance")


@query(
    "nearest_rows",
    "WITH q AS (SELECT o_orderkey, (o_custkey % 61)::double - 5 AS qx, o_totalprice / 100 AS qy FROM orders), "
    "b AS (SELECT o_orderkey, arg_min(struct_pack(r := p_partkey, d := sqrt((p_size - qx) * (p_size - qx) + (p_retailprice - qy) * (p_retailprice - qy))), "
    "struct_pack(d := sqrt((p_size - qx) * (p_size - qx) + (p_retailprice - qy) * (p_retailprice - qy)), r := p_partkey)) AS s FROM q, part GROUP BY o_orderkey) "
    "SELECT o_orderkey, s.r AS row, round(s.d, 6) AS distance FROM b",
)
def nearest_rows(spark, d):
    """The nearest part to every order, by size and price."""
    q = table(spark, d, "orders").select("o_orderkey", ((F.col("o_custkey") % 61).cast("double") - 5).alias("qx"), (F.col("o_totalprice") / 100).alias("qy"))
    out = align.nearest_rows(table(spark, d, "part"), "p_size", "p_retailprice", "p_partkey", q)
    return rounded(out, 6, "distance").select("o_orderkey", "row", "distance")


# ---------------------------------------------------------------- spectra

DFT = (
    f"WITH {EV}, m AS (SELECT row_idx AS j, n, (value - avg(value) OVER ()) * (0.5 - 0.5 * cos(2 * pi() * row_idx / (n - 1))) AS z FROM ev), "
    "k AS (SELECT unnest(range(1, (SELECT any_value(n) FROM m) // 2)) AS k), "
    "f AS (SELECT k, any_value(n) AS n, sum(z * cos(2 * pi() * ((j * k) % n) / n)) AS re, sum(z * sin(2 * pi() * ((j * k) % n) / n)) AS im FROM m, k GROUP BY k), "
    "s AS (SELECT k, k * 2.0 / n AS frequency, (re * re + im * im) / n AS power FROM f) "
)


@query("psd", DFT + "SELECT k, round(frequency, 9) AS frequency, round(power, 4) AS power FROM s")
def psd(spark, d):
    return rounded(rounded(spectral.psd(events(spark, d), "value", 2.0), 9, "frequency"), 4, "power")


@query("psd_split", DFT + "SELECT k, round(frequency, 9) AS frequency, round(power, 4) AS power FROM s")
def psd_split(spark, d):
    out = spectral.psd(events(spark, d), "value", 2.0, direct_rows=1000)
    return rounded(rounded(out, 9, "frequency"), 4, "power")


@query(
    "psd_inferred_rate",
    DFT + f", p AS (SELECT x - lag(x) OVER (ORDER BY row_idx) AS dt FROM ev), r AS (SELECT 1.0 / ({um('dt')}) AS rate FROM p WHERE dt > 0) "
    "SELECT k, round(frequency / 2.0 * (SELECT rate FROM r), 12) AS frequency, round(power, 4) AS power FROM s",
)
def psd_inferred_rate(spark, d):
    return rounded(rounded(spectral.psd(events(spark, d), "value", ts="ts"), 12, "frequency"), 4, "power")


@query("psd_peaks", DFT + "SELECT k, round(frequency, 3) AS frequency_hz, round(power, 4) AS power FROM s ORDER BY s.power DESC, k LIMIT 6")
def psd_peaks(spark, d):
    return rounded(spectral.top_peaks(spectral.psd(events(spark, d), "value", 2.0)), 4, "power")


PSD_BY = (
    f"WITH {EV_BY}, m AS (SELECT event_type, row_idx AS j, n, (value - avg(value) OVER (PARTITION BY event_type)) * (0.5 - 0.5 * cos(2 * pi() * row_idx / (n - 1))) AS z FROM ev), "
    "k AS (SELECT event_type, unnest(range(1, n // 2)) AS k FROM (SELECT event_type, any_value(n) AS n FROM m GROUP BY 1)), "
    "f AS (SELECT event_type, k, any_value(n) AS n, sum(z * cos(2 * pi() * ((j * k) % n) / n)) AS re, sum(z * sin(2 * pi() * ((j * k) % n) / n)) AS im FROM m JOIN k USING (event_type) GROUP BY 1, 2) "
    "SELECT event_type, k, round(k::double / n, 9) AS frequency, round((re * re + im * im) / n, 4) AS power FROM f"
)


@query("psd_by_series", PSD_BY)
def psd_by_series(spark, d):
    out = spectral.psd(events(spark, d, "event_type"), "value", 1.0)
    return rounded(rounded(out, 9, "frequency"), 4, "power")


@query("psd_long_series", PSD_BY.replace("event_type", "user_id"))
def psd_long_series(spark, d):
    """Every user with over 20 events as a long series: split transforms and convolutions of many lengths at once."""
    out = spectral.psd(events(spark, d, "user_id"), "value", 1.0, direct_rows=20)
    return rounded(rounded(out, 9, "frequency"), 4, "power")


STFT = (
    f"WITH {EV}, w AS (SELECT any_value(n) AS n, (any_value(n) - 64) // 32 + 1 AS whole FROM ev), "
    "fr AS (SELECT unnest(range(0, (SELECT CASE WHEN whole * 32 < n THEN whole + 1 ELSE whole END FROM w))) AS frame), "
    "z AS (SELECT frame, row_idx - frame * 32 AS i, value * (0.5 - 0.5 * cos(2 * pi() * (row_idx - frame * 32) / 63)) AS z "
    "FROM fr JOIN ev ON row_idx >= frame * 32 AND row_idx < frame * 32 + 64), b AS (SELECT unnest(range(0, 32))::int AS bin), "
    "s AS (SELECT frame, bin, sqrt(pow(sum(z * cos(2 * pi() * i * bin / 64)), 2) + pow(sum(z * sin(2 * pi() * i * bin / 64)), 2)) AS magnitude FROM z, b GROUP BY ALL) "
)


@query("stft", STFT + "SELECT frame, bin, round(magnitude, 6) AS magnitude FROM s")
def stft(spark, d):
    return rounded(spectral.stft(events(spark, d), "value", 64), 6, "magnitude")


@query("stft_axes", STFT + "SELECT max(frame) + 1 AS n_frames, 32 AS bins, 1.0::double AS nyquist, (max(frame) + 1) * 32.0::double / 2 AS duration FROM s")
def stft_axes(spark, d):
    return spectral.stft_axes(spectral.stft(events(spark, d), "value", 64), 64, 2.0)
