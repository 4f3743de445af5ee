"""Column statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import stats as s
from strandline.operators.spectral import stft
from strandline.queries.series import STFT
from strandline.queries.registry import EV, LI, MEASURES, ROW, events, lines, query, rounded, table, um


def _union(cols, body: str) -> str:
    return " UNION ALL ".join(body.format(c=c, i=i) for i, c in enumerate(cols))


LONG = "long AS (" + _union(MEASURES, "SELECT '{c}' AS \"column\", row_idx, n, {c} AS v FROM li") + ")"
LONG_RAW = "long AS (" + _union(MEASURES, "SELECT '{c}' AS \"column\", {c} AS v FROM lineitem") + ")"


@query(
    "summary_stats",
    f"WITH {LONG_RAW} SELECT \"column\", count(v) AS count, min(v) AS min, max(v) AS max, round(max(v) - min(v), 6) AS peak_to_peak, "
    "round(avg(v), 7) AS mean, round(median(v), 6) AS median, round(stddev_pop(v), 6) AS std_dev FROM long GROUP BY 1",
)
def summary_stats(spark, d):
    out = s.summary_stats(table(spark, d, "lineitem"), MEASURES)
    return rounded(rounded(out, 7, "mean"), 6, "median", "std_dev", "peak_to_peak")


RUNS = (
    "WITH li AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS row_idx FROM lineitem), "
    "long AS (" + _union([*MEASURES, "l_returnflag"], "SELECT '{c}' AS \"column\", row_idx, {c}::varchar AS raw, TRY_CAST({c}::varchar AS DOUBLE) AS v FROM li") + "), "
    "f AS (SELECT *, CASE WHEN raw IS NOT DISTINCT FROM lag(raw) OVER w AND row_idx > 0 THEN 0 ELSE 1 END AS fresh FROM long WINDOW w AS (PARTITION BY \"column\" ORDER BY row_idx)), "
    "g AS (SELECT *, sum(fresh) OVER (PARTITION BY \"column\" ORDER BY row_idx) AS run FROM f), "
    "r AS (SELECT \"column\", max(c) AS longest_constant_run FROM (SELECT \"column\", run, count(*) AS c FROM g GROUP BY 1, 2) GROUP BY 1) "
)


@query(
    "describe",
    RUNS
    + "SELECT \"column\", CASE WHEN \"column\" = 'l_returnflag' THEN 'text' ELSE 'numeric' END AS kind, count(*) AS n_total, count(*) - count(v) AS n_missing, "
    "coalesce(round(100.0 * count(*) FILTER (v = 0) / nullif(count(v), 0), 1), 0) AS pct_zero, count(DISTINCT raw) AS \"distinct\", "
    "any_value(longest_constant_run) AS longest_constant_run, min(v) AS min, max(v) AS max, round(max(v) - min(v), 6) AS peak_to_peak, "
    "round(avg(v), 7) AS mean, round(median(v), 6) AS median, round(stddev_pop(v), 6) AS std_dev "
    "FROM long JOIN r USING (\"column\") GROUP BY \"column\"",
)
def describe(spark, d):
    out = s.describe(lines(spark, d), [*MEASURES, "l_returnflag"]).drop("position")
    out = out.withColumnRenamed("longest_run", "longest_constant_run")
    return rounded(rounded(out, 7, "mean"), 6, "median", "std_dev", "peak_to_peak")


@query("longest_run", RUNS + "SELECT \"column\", longest_constant_run AS longest_run FROM r")
def longest_run(spark, d):
    from strandline.plans.blocks import longest_runs

    return longest_runs(lines(spark, d), [*MEASURES, "l_returnflag"])


@query(
    "distinct_counts",
    "WITH e AS (SELECT CASE WHEN event_id % 10 <> 0 THEN user_id END AS u, event_type FROM events) "
    "SELECT 'u' AS \"column\", count(DISTINCT u) + max((u IS NULL)::int) AS \"distinct\" FROM e "
    "UNION ALL SELECT 'event_type', count(DISTINCT event_type) FROM e",
)
def distinct_counts(spark, d):
    u = F.when(F.col("event_id") % 10 != 0, F.col("user_id"))
    return s.distinct_counts(table(spark, d, "events").select(u.alias("u"), "event_type"), ["u", "event_type"])


@query(
    "median_mad",
    "WITH m AS (SELECT event_type, " + um("value") + " AS median, count(value) AS n FROM events GROUP BY 1), "
    "a AS (SELECT e.event_type, abs(value - median) AS dv FROM events e JOIN m USING (event_type)) "
    "SELECT event_type, any_value(m.n) AS n, round(any_value(median), 6) AS median, round(" + um("dv") + ", 6) AS mad FROM a JOIN m USING (event_type) GROUP BY 1",
)
def median_mad(spark, d):
    return rounded(s.median_mad(table(spark, d, "events"), "value", ["event_type"]), 6, "median", "mad")


@query(
    "percentiles",
    "WITH r AS (SELECT c_acctbal AS v, row_number() OVER (ORDER BY c_acctbal) - 1 AS k, count(*) OVER () AS n FROM customer) "
    "SELECT max(n) AS n, max(v) FILTER (k = 0) AS p0, max(v) FILTER (k = floor((n - 1) * 0.25 + 0.5)) AS p25, "
    "max(v) FILTER (k = floor((n - 1) * 0.5 + 0.5)) AS p50, max(v) FILTER (k = floor((n - 1) * 0.9 + 0.5)) AS p90, max(v) FILTER (k = n - 1) AS p100 FROM r",
)
def percentiles(spark, d):
    f = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    return s.percentiles(table(spark, d, "customer"), "c_acctbal", f)


@query(
    "robust_range",
    "WITH r AS (SELECT value AS v, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS n FROM events), "
    "q AS (SELECT max(v) FILTER (k = floor((n - 1) * 0.01 + 0.5)) AS lo, max(v) FILTER (k = floor((n - 1) * 0.99 + 0.5)) AS hi FROM r) "
    "SELECT round(lo - (hi - lo) * 0.05, 6) AS y_min, round(hi + (hi - lo) * 0.05, 6) AS y_max FROM q",
)
def robust_range(spark, d):
    return rounded(s.robust_y_range(table(spark, d, "events"), "value", at_least=20), 6, "y_min", "y_max")


@query(
    "robust_range_log",
    "WITH r AS (SELECT log10(value) AS v, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS n FROM events WHERE value > 0), "
    "q AS (SELECT max(v) FILTER (k = floor((n - 1) * 0.01 + 0.5)) AS lo, max(v) FILTER (k = floor((n - 1) * 0.99 + 0.5)) AS hi FROM r) "
    "SELECT round(lo - (hi - lo) * 0.05, 6) AS y_min, round(hi + (hi - lo) * 0.05, 6) AS y_max FROM q",
)
def robust_range_log(spark, d):
    return rounded(s.robust_y_range(table(spark, d, "events"), "value", log=True), 6, "y_min", "y_max")


@query("data_bounds", "SELECT event_type, min(value) AS y_min, max(value) AS y_max FROM events GROUP BY 1")
def data_bounds(spark, d):
    return s.data_bounds(table(spark, d, "events"), "value", ["event_type"])


@query(
    "fit_bounds",
    "WITH b AS (SELECT min(p_size)::double AS a, max(p_size)::double AS b, min(p_retailprice) AS c, max(p_retailprice) AS d FROM part) "
    "SELECT round(a - (b - a) * 0.05, 6) AS x_min, round(b + (b - a) * 0.05, 6) AS x_max, round(c - (d - c) * 0.05, 6) AS y_min, round(d + (d - c) * 0.05, 6) AS y_max FROM b",
)
def fit_bounds(spark, d):
    return rounded(s.fit_bounds(table(spark, d, "part"), "p_size", "p_retailprice"), 6, "x_min", "x_max", "y_min", "y_max")


@query(
    "y_range_in_view",
    "WITH b AS (SELECT min(p_retailprice) AS c, max(p_retailprice) AS d FROM part WHERE p_size BETWEEN 10 AND 20) "
    "SELECT round(c - (d - c) * 0.05, 6) AS y_min, round(d + (d - c) * 0.05, 6) AS y_max FROM b",
)
def y_range_in_view(spark, d):
    return rounded(s.y_range_in(table(spark, d, "part"), "p_size", "p_retailprice", 10, 20), 6, "y_min", "y_max")


@query(
    "y_range_per_unit",
    "WITH b AS (SELECT p_type, min(p_retailprice) AS c, max(p_retailprice) AS d FROM part WHERE p_size BETWEEN 10 AND 20 GROUP BY 1) "
    "SELECT p_type, round(c - (d - c) * 0.05, 6) AS y_min, round(d + (d - c) * 0.05, 6) AS y_max FROM b",
)
def y_range_per_unit(spark, d):
    return rounded(s.y_range_in(table(spark, d, "part"), "p_size", "p_retailprice", 10, 20, "p_type"), 6, "y_min", "y_max")


@query("x_extent", "SELECT min(p_size)::double AS x_min, max(p_size)::double AS x_max FROM part")
def x_extent(spark, d):
    return s.x_extent(table(spark, d, "part"), "p_size")


PAIRS = [(i, j) for i in range(4) for j in range(i + 1, 4)]
CORR = "c AS (" + " UNION ALL ".join(
    f"SELECT '{MEASURES[i]}' AS a, '{MEASURES[j]}' AS b, corr({MEASURES[i]}, {MEASURES[j]}) AS r FROM lineitem" for i, j in PAIRS
) + ")"


@query("correlation_pairs", f"WITH {CORR} SELECT a, b, round(r, 3) AS r FROM c ORDER BY abs(r) DESC LIMIT 60")
def correlation_pairs(spark, d):
    return s.ranked_pairs(table(spark, d, "lineitem"), MEASURES)


@query(
    "correlation_matrix",
    f"WITH {CORR} SELECT a, b, round(r, 3) AS r FROM c UNION ALL SELECT b, a, round(r, 3) FROM c UNION ALL "
    + " UNION ALL ".join(f"SELECT '{m}', '{m}', 1.0" for m in MEASURES),
)
def correlation_matrix(spark, d):
    return s.correlation_matrix(table(spark, d, "lineitem"), MEASURES)


@query(
    "pearson_incomplete",
    "WITH v AS (SELECT CASE WHEN event_id % 3 <> 0 THEN value END AS p, CASE WHEN event_id % 5 <> 0 THEN user_id::double + value / 100 END AS q, 1.0 AS one FROM events) "
    "SELECT 'p' AS a, 'q' AS b, round(corr(p, q), 9) AS r FROM v UNION ALL SELECT 'p', 'one', NULL UNION ALL SELECT 'q', 'one', NULL",
)
def pearson_incomplete(spark, d):
    t = table(spark, d, "events").select(
        F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("p"),
        F.when(F.col("event_id") % 5 != 0, F.col("user_id") + F.col("value") / 100).alias("q"),
        F.lit(1.0).alias("one"),
    )
    return rounded(s.correlations(t, ["p", "q", "one"]), 9, "r").select("a", "b", "r")


def _hist(src: str, v: str, bins: int, by: str = "") -> str:
    k, g = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    j = f"USING ({by})" if by else "ON TRUE"
    on = f"USING ({by}, bin)" if by else "USING (bin)"
    return (
        f"WITH e AS (SELECT {k}min({v}) AS lo, max({v}) AS hi, count({v}) AS n FROM {src} {g}), "
        f"c AS (SELECT {k}least(floor(({v} - lo) / (hi - lo) * {bins}), {bins - 1})::int AS bin, count(*) AS count FROM {src} JOIN e {j} GROUP BY ALL), "
        f"g AS (SELECT e.*, r.bin::int AS bin FROM e, range({bins}) r(bin)), "
        f"h AS (SELECT {k}bin, round(lo + (hi - lo) * (bin + 0.5) / {bins}, 6) AS bin_center, coalesce(count, 0) AS count, n FROM g LEFT JOIN c {on}) "
    )


@query("histogram", _hist("lineitem", "l_extendedprice", 40) + "SELECT * FROM h")
def histogram(spark, d):
    return rounded(s.histogram(table(spark, d, "lineitem"), "l_extendedprice"), 6, "bin_center")


@query("histogram_by_series", _hist("events", "value", 25, "event_type") + "SELECT * FROM h")
def histogram_by_series(spark, d):
    return rounded(s.histogram(table(spark, d, "events"), "value", 25, ["event_type"]), 6, "bin_center")


@query("modal_bin", _hist("events", "value", 25, "event_type") + "SELECT event_type, max(struct_pack(c := count, b := bin)).b AS bin, round(arg_max(bin_center, struct_pack(c := count, b := bin)), 3) AS bin_center, max(count) AS count FROM h GROUP BY 1")
def modal_bin(spark, d):
    return s.modal_bin(s.histogram(table(spark, d, "events"), "value", 25, ["event_type"]), ["event_type"])


@query(
    "segment_stats",
    f"WITH {LI}, {LONG}, t AS (SELECT *, floor(((row_idx + 1) * 10 - 1) / n)::int AS segment FROM long) "
    "SELECT \"column\", segment, (segment * any_value(n)) // 10 AS row_start, ((segment + 1) * any_value(n)) // 10 AS row_end, "
    "round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, round(min(v), 4) AS min, round(max(v), 4) AS max, NULL::varchar AS note FROM t GROUP BY 1, 2",
)
def segment_stats(spark, d):
    return s.segment_stats(lines(spark, d), MEASURES)


@query(
    "sample_rate",
    f"WITH {EV}, t AS (SELECT x - lag(x) OVER (ORDER BY row_idx) AS dt FROM ev), p AS (SELECT dt FROM t WHERE dt > 0) SELECT round(1.0 / ({um('dt')}), 12) AS sample_rate FROM p",
)
def sample_rate(spark, d):
    return rounded(s.sample_rate(events(spark, d), "ts"), 12, "sample_rate")


@query(
    "colour_range",
    STFT
    + "SELECT max(n2) AS n, round(max(v) FILTER (k = floor(n2 * 0.05)), 6) AS low, round(max(v) FILTER (k = floor((n2 - 1) * 0.995)), 6) AS high FROM "
    "(SELECT log10(magnitude + 1e-12) AS v, row_number() OVER (ORDER BY magnitude) - 1 AS k, count(*) OVER () AS n2 FROM s)",
)
def colour_range(spark, d):
    return rounded(s.colour_range(stft(events(spark, d), "value", 64), "magnitude"), 6, "low", "high")


@query(
    "dataset_summary",
    "SELECT count(*) AS n_rows, 6 AS n_columns, 4 AS n_numeric_columns, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%g') AS time_start, "
    "strftime(max(ts), '%Y-%m-%d %H:%M:%S.%g') AS time_end FROM events",
)
def dataset_summary(spark, d):
    return s.dataset_summary(table(spark, d, "events"), "ts")
