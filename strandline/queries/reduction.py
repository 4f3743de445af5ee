"""Reduction queries: envelopes, triangle downsampling, resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import reduce as red
from strandline.plans.report import plot_bounds, plot_series
from strandline.queries.registry import EV, EV_BY, ROW, events, query, rounded


def _envelope_sql(ev: str, k: int, part: str) -> str:
    keys = f"{part}, " if part else ""
    return (
        f"WITH {ev}, b AS (SELECT *, floor(((row_idx + 1) * {k} - 1) / n)::bigint AS b FROM ev), "
        f"o AS (SELECT {keys}b, list_distinct([arg_min(row_idx, struct_pack(v := value, r := row_idx)), "
        f"arg_max(row_idx, struct_pack(v := value, r := -row_idx))]) AS l FROM b GROUP BY {keys}b), p AS (SELECT {keys}unnest(l) AS row_idx FROM o) "
    )


@query("minmax_envelope", _envelope_sql(EV, 200, "") + "SELECT row_idx, event_id, x, value FROM p JOIN ev USING (row_idx)")
def minmax_envelope(spark, d):
    o = events(spark, d)
    e = red.minmax_envelope(o, "x", "value", 200)
    return e.join(o.df.select(ROW, "event_id"), ROW)


@query(
    "envelope_by_series",
    _envelope_sql(EV_BY, 50, "event_type") + "SELECT event_type, row_idx, round(value, 6) AS value FROM p JOIN ev USING (event_type, row_idx)",
)
def envelope_by_series(spark, d):
    e = red.minmax_envelope(events(spark, d, "event_type"), "x", "value", 50)
    return rounded(e, 6, "value").select("event_type", ROW, "value")


def _lttb_sql(target: int, shift: int, source: str = EV, kept: str = "") -> str:
    """The chain of picks by recursion; `source` defines ev with its series in `event_type` where there are several."""
    k = "event_type" if source == EV_BY else "0"
    last = target - 3
    name = f"{kept}, " if kept else ""
    return (
        f"WITH RECURSIVE {source}, w AS (SELECT *, {k} AS k, (n - 2)::double / {target - 2} AS w FROM ev), "
        f"i AS (SELECT unnest(range(0, {target - 2})) AS b), "
        "c AS (SELECT b, k, row_idx AS j, x, value AS y FROM i, w WHERE row_idx < n AND "
        f"row_idx >= floor((b + {shift}) * w)::bigint + 1 AND row_idx < greatest(least(floor((b + {shift} + 1) * w)::bigint + 1, n - 1), floor((b + {shift}) * w)::bigint + 2)), "
        "m AS (SELECT b, k, avg(x) AS mx, avg(value) AS my FROM i, w WHERE "
        f"row_idx >= least(floor((b + {shift} + 1) * w)::bigint + 1, n - 1) AND row_idx < least(floor((b + {shift} + 2) * w)::bigint + 1, n) "
        f"OR (row_idx = n - 1 AND b = {last}) GROUP BY b, k), "
        "q AS (SELECT c.b, c.k, j, x, y, mx, my FROM c JOIN m ON c.b = m.b AND c.k = m.k), "
        "walk AS (SELECT -1::bigint AS b, k, row_idx AS j, x, value AS y FROM w WHERE row_idx = 0 UNION ALL "
        "SELECT r.b, r.k, r.s.j, r.s.x, r.s.y FROM (SELECT q.b, q.k, arg_max(struct_pack(j := q.j, x := q.x, y := q.y), "
        "struct_pack(a := abs((p.x - mx) * (q.y - p.y) - (p.x - q.x) * (my - p.y)), j := -q.j)) AS s "
        f"FROM walk p JOIN q ON q.b = p.b + 1 AND q.k = p.k GROUP BY q.b, q.k) r) "
        f"SELECT {name}(b + 1)::int AS pick, j AS row_idx FROM walk UNION ALL SELECT {name}{target - 1}, row_idx FROM w WHERE row_idx = n - 1"
    )


@query("lttb", _lttb_sql(200, 1))
def lttb(spark, d):
    return red.lttb(events(spark, d), "x", "value", 200).select("pick", ROW)


@query("lttb_standard", _lttb_sql(200, 0))
def lttb_standard(spark, d):
    return red.lttb(events(spark, d), "x", "value", 200, "standard").select("pick", ROW)


@query("lttb_by_series", _lttb_sql(100, 1, EV_BY, "k").replace("SELECT k, (b", "SELECT k AS event_type, (b"))
def lttb_by_series(spark, d):
    return red.lttb(events(spark, d, "event_type"), "x", "value", 100).select("event_type", "pick", ROW)


# plateaus of 700 rows, and a zigzag in x that is nowhere sorted
FLAT = (
    "ev AS (SELECT event_id::double AS x, (row_idx // 700 % 3) * 8.0::double AS value, row_idx, n FROM "
    "(SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_idx, count(*) OVER () AS n FROM events))"
)
UNSORTED = (
    "ev AS (SELECT (row_idx * 7919 % 10007)::double AS x, round(value)::double AS value, row_idx, n FROM "
    "(SELECT value, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_idx, count(*) OVER () AS n FROM events))"
)


@query("lttb_flat", _lttb_sql(150, 1, FLAT))
def lttb_flat(spark, d):
    o = events(spark, d)
    o = o.with_column("v", (F.floor(F.col(ROW) / 700) % 3) * F.lit(8.0)).with_column("x", F.col("event_id").cast("double"))
    return red.lttb(o, "x", "v", 150).select("pick", ROW)


@query("lttb_unsorted", _lttb_sql(150, 1, UNSORTED))
def lttb_unsorted(spark, d):
    o = events(spark, d).with_column("x", (F.col(ROW) * 7919 % 10007).cast("double")).with_column("value", F.round("value"))
    return red.lttb(o, "x", "value", 150).select("pick", ROW)


VIEW = (
    f"WITH {EV}, e AS (SELECT max(row_idx) FILTER (x < 1704412800) AS lo, min(row_idx) FILTER (x > 1705276800) AS hi FROM ev), "
    "v AS (SELECT event_id, x, value, row_number() OVER (ORDER BY row_idx) - 1 AS row_idx, count(*) OVER () AS n FROM ev, e "
    "WHERE x BETWEEN 1704412800 AND 1705276800 OR row_idx = lo OR row_idx = hi), "
    "b AS (SELECT *, floor(((row_idx + 1) * 60 - 1) / n)::bigint AS b FROM v), "
    "o AS (SELECT b, list_distinct([arg_min(event_id, struct_pack(v := value, r := row_idx)), arg_max(event_id, struct_pack(v := value, r := -row_idx))]) AS l FROM b GROUP BY b), "
    "p AS (SELECT unnest(l) AS event_id FROM o) "
)


@query("view_downsample", VIEW + "SELECT x, value FROM p JOIN ev USING (event_id)")
def view_downsample(spark, d):
    return red.view_downsample(events(spark, d), "x", "value", 1704412800.0, 1705276800.0, 120, "minmax").select("x", "value")


# the rows of the same view as the series to reduce
IN_VIEW = VIEW[len("WITH ") : VIEW.index("b AS (")].replace("ev AS", "base AS", 1).replace("FROM ev,", "FROM base,").replace("FROM ev)", "FROM base)")
IN_VIEW += "ev AS (SELECT event_id, x, value, row_idx, n FROM v)"


@query("view_downsample_lttb", f"SELECT row_idx FROM ({_lttb_sql(120, 1, IN_VIEW)})")
def view_downsample_lttb(spark, d):
    return red.view_downsample(events(spark, d), "x", "value", 1704412800.0, 1705276800.0, 120, "lttb").select(ROW)


def _resample_sql(points: int, value: str) -> str:
    return (
        f"WITH {EV}, s AS (SELECT x, value AS y, lead(x) OVER w AS x1, lead(value) OVER w AS y1 FROM ev WINDOW w AS (ORDER BY row_idx)), "
        "e AS (SELECT min(x) AS a, max(x) AS z FROM ev), "
        f"g AS (SELECT k, a + (z - a) * k / {points - 1} AS gx FROM e, range({points}) r(k)), "
        "j AS (SELECT * FROM g ASOF JOIN (SELECT * FROM s WHERE x1 IS NOT NULL) q ON g.gx >= q.x) "
        f"SELECT k, round(gx, 1) AS x, round({value}, 6) AS y FROM j"
    )


def _resampled(method):
    def run(spark, d):
        return rounded(rounded(red.resample(events(spark, d), "x", "value", 1501, method), 1, "x"), 6, "y")

    return run


query("resample_linear", _resample_sql(1501, "y + (y1 - y) * (gx - x) / (x1 - x)"))(_resampled("linear"))
query("resample_nearest", _resample_sql(1501, "CASE WHEN abs(gx - x) <= abs(x1 - gx) THEN y ELSE y1 END"))(_resampled("nearest"))
# the tridiagonal system of the whole series, forward and backward row by row
SPLINE_SQL = (
    f"WITH RECURSIVE {EV}, h AS MATERIALIZED (SELECT row_idx AS i, n, x, value AS y, x - lag(x) OVER w AS h0, lead(x) OVER w - x AS h1, "
    "6 * ((lead(value) OVER w - value) / (lead(x) OVER w - x) - (value - lag(value) OVER w) / (x - lag(x) OVER w)) AS r FROM ev WINDOW w AS (ORDER BY row_idx)), "
    "f AS (SELECT 0::bigint AS i, 0.0::double AS c, 0.0::double AS d UNION ALL SELECT h.i, h1 / (2 * (h0 + h1) - h0 * f.c), (r - h0 * f.d) / (2 * (h0 + h1) - h0 * f.c) FROM f JOIN h ON h.i = f.i + 1 WHERE h.i < h.n - 1), "
    "fm AS MATERIALIZED (SELECT * FROM f), "
    "b AS (SELECT max(row_idx) AS i, 0.0::double AS m FROM ev UNION ALL SELECT fm.i, CASE WHEN fm.i = 0 THEN 0 ELSE fm.d - fm.c * b.m END FROM b JOIN fm ON fm.i = b.i - 1), "
    "s AS (SELECT x, y, m, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(m) OVER w AS m1 FROM h JOIN b USING (i) WINDOW w AS (ORDER BY i)), "
    "e AS (SELECT min(x) AS a, max(x) AS z FROM ev), g AS (SELECT k, a + (z - a) * k / 1500 AS gx FROM e, range(1501) r(k)), "
    "j AS (SELECT *, (x1 - gx) / (x1 - x) AS u, (gx - x) / (x1 - x) AS v FROM g ASOF JOIN (SELECT * FROM s WHERE x1 IS NOT NULL) q ON g.gx >= q.x) "
    "SELECT k, round(gx, 1) AS x, round(u * y + v * y1 + ((u * u * u - u) * m + (v * v * v - v) * m1) * (x1 - x) * (x1 - x) / 6, 6) AS y FROM j"
)
query("resample_cubic", SPLINE_SQL)(_resampled("cubic"))


@query(
    "resample_by_series",
    f"WITH {EV_BY}, s AS (SELECT event_type, x, value AS y, lead(x) OVER w AS x1, lead(value) OVER w AS y1 FROM ev WINDOW w AS (PARTITION BY event_type ORDER BY row_idx)), "
    "e AS (SELECT event_type, min(x) AS a, max(x) AS z FROM ev GROUP BY 1), g AS (SELECT event_type, k, a + (z - a) * k / 299 AS gx FROM e, range(300) r(k)), "
    "j AS (SELECT g.event_type, k, gx, x, y, x1, y1 FROM g ASOF JOIN (SELECT * FROM s WHERE x1 IS NOT NULL) q ON g.event_type = q.event_type AND g.gx >= q.x) "
    "SELECT event_type, k, round(gx, 1) AS x, round(y + (y1 - y) * (gx - x) / (x1 - x), 6) AS y FROM j",
)
def resample_by_series(spark, d):
    out = red.resample(events(spark, d, "event_type"), "x", "value", 300)
    return rounded(rounded(out, 1, "x"), 6, "y")


PLOT = (
    f"WITH {EV}, f AS (SELECT x, row_idx, log10(value) AS y, row_number() OVER (ORDER BY row_idx) - 1 AS i, count(*) OVER () AS n FROM ev WHERE value > 0), "
    "b AS (SELECT *, floor(((i + 1) * 200 - 1) / n)::bigint AS b FROM f), "
    "o AS (SELECT b, list_distinct([arg_min(i, struct_pack(v := y, r := i)), arg_max(i, struct_pack(v := y, r := -i))]) AS l FROM b GROUP BY b), "
    "p AS (SELECT unnest(l) AS i FROM o) "
)


@query("plot_series", PLOT + "SELECT 0 AS panel, 'value' AS series, i AS row_idx, x, round(y, 9) AS y FROM p JOIN f USING (i)")
def plot(spark, d):
    return rounded(plot_series(events(spark, d), "ts", ["value"], y_log=True, width=200), 9, "y")


@query(
    "plot_bounds",
    f"WITH {EV}, e AS (SELECT min(x) AS a, max(x) AS b FROM ev), r AS (SELECT value AS v, row_number() OVER (ORDER BY value) - 1 AS k, n FROM ev), "
    "q AS (SELECT 0 AS panel, max(v) FILTER (k = floor((n - 1) * 0.01 + 0.5)) AS lo, max(v) FILTER (k = floor((n - 1) * 0.99 + 0.5)) AS hi FROM r), "
    "u AS (SELECT user_id::double AS v, row_number() OVER (ORDER BY user_id) - 1 AS k, n FROM ev), "
    "q2 AS (SELECT 1 AS panel, max(v) FILTER (k = floor((n - 1) * 0.01 + 0.5)) AS lo, max(v) FILTER (k = floor((n - 1) * 0.99 + 0.5)) AS hi FROM u) "
    "SELECT panel, round(lo - (hi - lo) * 0.05::double, 6) AS y_min, round(hi + (hi - lo) * 0.05::double, 6) AS y_max, round(a - (b - a) * 0.03, 3) AS x_min, round(b + (b - a) * 0.03, 3) AS x_max "
    "FROM (SELECT * FROM q UNION ALL SELECT * FROM q2), e",
)
def bounds(spark, d):
    p = plot_series(events(spark, d), "ts", ["value", "user_id"], downsample="none", layout="stacked")
    return rounded(rounded(plot_bounds(p, robust=True), 6, "y_min", "y_max"), 3, "x_min", "x_max")


@query(
    "plot_stacked_derivative",
    f"WITH {EV}, s AS (SELECT row_idx, x, coalesce(lag(x) OVER w, x) AS x0, coalesce(lead(x) OVER w, x) AS x1, coalesce(lag(value) OVER w, value) AS y0, "
    "coalesce(lead(value) OVER w, value) AS y1, coalesce(lag(user_id) OVER w, user_id) AS u0, coalesce(lead(user_id) OVER w, user_id) AS u1 FROM ev WINDOW w AS (ORDER BY row_idx)) "
    "SELECT 0 AS panel, 'value' AS series, row_idx, x, round((y1 - y0) / (x1 - x0), 9) AS y FROM s WHERE row_idx >= 100 AND row_idx < 500 UNION ALL "
    "SELECT 1, 'user_id', row_idx, x, round((u1 - u0) / (x1 - x0), 9) FROM s WHERE row_idx >= 100 AND row_idx < 500",
)
def plot_stacked(spark, d):
    p = plot_series(events(spark, d), "ts", ["value", "user_id"], "derivative", rows=(100, 500), layout="stacked")
    return rounded(p, 9, "y")


@query(
    "plot_normalized",
    f"WITH {EV} SELECT 0 AS panel, 'value' AS series, row_idx, x, round((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()), 9) AS y FROM ev",
)
def plot_normalized(spark, d):
    return rounded(plot_series(events(spark, d), "ts", ["value"], downsample="none", layout="normalized"), 9, "y")
