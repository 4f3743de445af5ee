"""Row-level queries: search, filters, derived columns, formulas, sorting and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline import order_rows
from strandline.functions import fx
from strandline.functions.times import epoch_seconds, format_epoch
from strandline.functions.units import channel_role, infer_unit
from strandline.operators import rows as r
from strandline.operators.align import repair_timestamps
from strandline.operators.derive import derive, derive_op, map_series
from strandline.operators.qc import _resolve
from strandline.queries.registry import EV, EV_BY, LINE_KEY, ROW, events, lines, query, rounded, table

LINE_SQL = ", ".join(LINE_KEY)


@query("row_index", f"WITH {EV} SELECT event_id, row_idx FROM ev")
def row_index(spark, d):
    return events(spark, d).df.select("event_id", ROW)


@query("row_index_by_series", f"WITH {EV_BY} SELECT event_id, event_type, row_idx FROM ev")
def row_index_by_series(spark, d):
    return events(spark, d, "event_type").df.select("event_id", "event_type", ROW)


@query("projection", f"SELECT l_tax, l_orderkey, l_quantity FROM lineitem")
def projection(spark, d):
    t = table(spark, d, "lineitem")
    return t.select("l_tax", *[_resolve(t, c) for c in ("0", "l_quantity")])


@query(
    "search_rows",
    "SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE contains(lower(p_name), 'ring') "
    "OR contains(lower(p_brand), 'ring') OR contains(lower(p_type), 'ring')",
)
def search_rows(spark, d):
    t = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return r.search(t, "RiNg", ["p_name", "p_brand", "p_type"])


@query("search_any_column", "SELECT * FROM nation WHERE contains(lower(n_name), '_1') OR contains(n_nationkey::varchar, '_1') OR contains(n_regionkey::varchar, '_1')")
def search_any_column(spark, d):
    return r.search(table(spark, d, "nation"), "_1")


@query(
    "column_filters",
    "SELECT p_partkey, p_name, p_size, p_retailprice FROM part WHERE contains(lower(p_name), 'red') "
    "AND p_size >= 10 AND p_size <= 30 AND p_retailprice >= 950",
)
def column_filters(spark, d):
    t = table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    return r.filter_columns(
        t, {"p_name": r.TextFilter("RED"), "p_size": r.RangeFilter(10, 30), "p_retailprice": r.RangeFilter(low=950)}
    )


@query("range_filter", f"SELECT {LINE_SQL} FROM lineitem WHERE l_discount >= 0.02 AND l_discount <= 0.04 AND l_quantity <= 12")
def range_filter(spark, d):
    t = table(spark, d, "lineitem")
    return r.filter_columns(t, {"l_discount": r.RangeFilter(0.02, 0.04), "l_quantity": r.RangeFilter(high=12)}).select(*LINE_KEY)


@query("range_filter_text", "SELECT event_id, k FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events) WHERE TRY_CAST(k AS DOUBLE) BETWEEN 20 AND 40")
def range_filter_text(spark, d):
    t = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    return r.filter_columns(t, {"k": r.RangeFilter(20, 40)})


@query(
    "filter_predicate",
    f"SELECT {LINE_SQL}, l_discount, l_tax FROM lineitem WHERE (l_quantity > 25 AND l_discount < 0.05) OR l_tax = 0.08",
)
def filter_predicate(spark, d):
    t = table(spark, d, "lineitem")
    cond = fx.or_(fx.and_(fx.gt("l_quantity", 25), fx.lt("l_discount", 0.05)), fx.eq("l_tax", 0.08))
    return r.filter_rows(t, cond).select(*LINE_KEY, "l_discount", "l_tax")


@query(
    "filter_missing_operand",
    "SELECT event_id, v FROM (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN round(value) END AS v FROM events) "
    "WHERE v IS NULL OR v <> 20",
)
def filter_missing_operand(spark, d):
    t = table(spark, d, "events").select(
        "event_id", F.when(F.col("event_id") % 5 != 0, F.round("value")).alias("v")
    )
    return r.filter_rows(t, fx.ne("v", 20))


@query("row_range", f"WITH {EV} SELECT event_id, row_idx FROM ev WHERE row_idx >= n // 4 AND row_idx < n // 2")
def row_range(spark, d):
    o = events(spark, d)
    return r.row_range(o, o.n // 4, o.n // 2).select("event_id", ROW)


@query("x_range", "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09 12:00:00'")
def x_range(spark, d):
    t = table(spark, d, "events")
    lo, hi = 1704412800.0, 1704801600.0
    return r.x_range(t.withColumn("x", epoch_seconds(t, "ts")), "x", lo, hi).select("event_id")


@query(
    "view_window",
    f"WITH {EV}, v AS (SELECT max(row_idx) FILTER (x < 1704412800) AS lo, min(row_idx) FILTER (x > 1704801600) AS hi FROM ev) "
    "SELECT event_id, row_idx FROM ev, v WHERE x BETWEEN 1704412800 AND 1704801600 OR row_idx = lo OR row_idx = hi",
)
def view_window(spark, d):
    return r.view_window(events(spark, d), "x", 1704412800.0, 1704801600.0).select("event_id", ROW)


@query(
    "scatter",
    "WITH s AS (SELECT p_size::double AS x, p_retailprice AS y, row_number() OVER (ORDER BY p_partkey) - 1 AS row_idx, "
    "count(*) OVER () AS n FROM part) SELECT row_idx, x, y, round(row_idx / (n - 1), 9) AS time_frac FROM s",
)
def scatter(spark, d):
    return rounded(r.scatter(table(spark, d, "part"), ["p_partkey"], "p_size", "p_retailprice"), 9, "time_frac")


@query("log_projection", "SELECT c_custkey, round(log10(c_acctbal), 9) AS c_acctbal FROM customer WHERE c_acctbal > 0")
def log_projection(spark, d):
    return rounded(r.log_y(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal"), 9, "c_acctbal")


DERIVED = {
    "derive_magnitude": ("magnitude", ["l_quantity", "l_discount", "l_tax"], "sqrt(l_quantity*l_quantity + l_discount*l_discount + l_tax*l_tax)"),
    "derive_add": ("add", ["l_quantity", "l_extendedprice"], "l_quantity + l_extendedprice"),
    "derive_mean": ("mean", ["l_quantity", "l_discount", "l_tax"], "(l_quantity + l_discount + l_tax) / 3"),
    "derive_subtract": ("subtract", ["l_discount", "l_tax"], "l_discount - l_tax"),
    "derive_ratio": ("ratio", ["l_extendedprice", "l_discount"], "CASE WHEN l_discount <> 0 THEN l_extendedprice / l_discount END"),
}


def _derived(op, cols):
    def run(spark, d):
        out = derive_op(table(spark, d, "lineitem"), op, cols, "out")
        return rounded(out, 6, "out").select(*LINE_KEY, "out")

    return run


for _name, (_op, _cols, _sql) in DERIVED.items():
    query(_name, f"SELECT {LINE_SQL}, round({_sql}, 6) AS out FROM lineitem")(_derived(_op, _cols))


@query("derive_scale", f"SELECT {LINE_SQL}, round(l_quantity * 2.5 + -3, 6) AS out FROM lineitem")
def derive_scale(spark, d):
    out = derive_op(table(spark, d, "lineitem"), "scale", ["l_quantity"], "out", 2.5, -3.0)
    return rounded(out, 6, "out").select(*LINE_KEY, "out")


@query(
    "derive_expr",
    f"SELECT {LINE_SQL}, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge FROM lineitem",
)
def derive_expr(spark, d):
    t = table(spark, d, "lineitem")
    value = fx.mul(fx.mul("l_extendedprice", fx.sub(1, "l_discount")), fx.add(1, "l_tax"))
    return rounded(derive(t, "charge", value), 6, "charge").select(*LINE_KEY, "charge")


@query(
    "map_series",
    "SELECT c_custkey, round(abs(b), 6) AS abs_y, round(CASE WHEN b > 0 THEN ln(b) END, 9) AS log_y, "
    "round(CASE WHEN b >= 0 THEN sqrt(b) END, 9) AS sqrt_y FROM (SELECT c_custkey, c_acctbal AS b FROM customer)",
)
def maps(spark, d):
    t = table(spark, d, "customer").select("c_custkey", *[F.col("c_acctbal").alias(c) for c in ("abs_y", "log_y", "sqrt_y")])
    for kind in ("abs", "log", "sqrt"):
        t = map_series(t, kind, f"{kind}_y")
    return rounded(rounded(t, 6, "abs_y"), 9, "log_y", "sqrt_y")


FORMULAS = {
    # name: (Column builder over v = (value - 100) / 50 and k = user_id, SQL over the same v, k)
    "plus": (lambda v, k: fx.add(v, k), "v + k"),
    "minus": (lambda v, k: fx.sub(v, k), "v - k"),
    "times": (lambda v, k: fx.mul(v, k), "v * k"),
    "over": (lambda v, k: fx.div(v, k - 8), "CASE WHEN k <> 8 THEN v / (k - 8) END"),
    "pow": (lambda v, k: fx.power(fx.abs_(v), 1.5), "pow(abs(v), 1.5)"),
    "neg": (lambda v, k: fx.neg(fx.power(v, 2)), "-(v * v)"),
    "sqrt": (lambda v, k: fx.sqrt(v), "CASE WHEN v >= 0 THEN sqrt(v) END"),
    "abs": (lambda v, k: fx.abs_(v), "abs(v)"),
    "sin": (lambda v, k: fx.sin(v), "sin(v)"),
    "cos": (lambda v, k: fx.cos(v), "cos(v)"),
    "tan": (lambda v, k: fx.tan(v / 10), "tan(v / 10)"),
    "asin": (lambda v, k: fx.asin(v), "CASE WHEN abs(v) <= 1 THEN asin(v) END"),
    "acos": (lambda v, k: fx.acos(v), "CASE WHEN abs(v) <= 1 THEN acos(v) END"),
    "atan": (lambda v, k: fx.atan(v), "atan(v)"),
    "atan2": (lambda v, k: fx.atan2(v, k), "atan2(v, k)"),
    "hypot": (lambda v, k: fx.hypot(v, k), "sqrt(v * v + k * k)"),
    "exp": (lambda v, k: fx.exp(v), "exp(v)"),
    "ln": (lambda v, k: fx.ln(v), "CASE WHEN v > 0 THEN ln(v) END"),
    "log": (lambda v, k: fx.log10(v), "CASE WHEN v > 0 THEN log10(v) END"),
    "exp_ln": (lambda v, k: fx.exp(fx.ln(k - 8)), "CASE WHEN k >= 8 THEN k - 8 END"),
    "floor": (lambda v, k: fx.floor(v), "floor(v)"),
    "ceil": (lambda v, k: fx.ceil(v), "ceil(v)"),
    "round": (lambda v, k: fx.round_(v), "round(v)"),
    "sign": (lambda v, k: fx.sign(k - 8), "CASE WHEN k >= 8 THEN 1 ELSE -1 END"),
    "deg": (lambda v, k: fx.deg(v), "degrees(v)"),
    "rad": (lambda v, k: fx.rad(v), "radians(v)"),
    "min": (lambda v, k: fx.least(v, k, 3), "least(v, k, 3)"),
    "max": (lambda v, k: fx.greatest(v, k, 3), "greatest(v, k, 3)"),
    "gt": (lambda v, k: fx.flag(fx.gt(v, k)), "(v > k)::int"),
    "lt": (lambda v, k: fx.flag(fx.lt(v, k)), "(v < k)::int"),
    "ge": (lambda v, k: fx.flag(fx.ge(k, 8)), "(k >= 8)::int"),
    "le": (lambda v, k: fx.flag(fx.le(k, 8)), "(k <= 8)::int"),
    "eq": (lambda v, k: fx.flag(fx.eq(k, 8)), "(k = 8)::int"),
    "ne": (lambda v, k: fx.flag(fx.ne(k, 8)), "(k <> 8)::int"),
    "and": (lambda v, k: fx.flag(fx.and_(fx.gt(v, 0), fx.truthy(k - 8))), "(v > 0 AND k <> 8)::int"),
    "or": (lambda v, k: fx.flag(fx.or_(fx.gt(v, 0), fx.eq(k, 8))), "(v > 0 OR k = 8)::int"),
}


@query(
    "formula_functions",
    "SELECT event_id, "
    + ", ".join(f"round(({sql})::double, 9) + 0.0 AS f_{n}" for n, (_, sql) in FORMULAS.items())
    + " FROM (SELECT event_id, (value - 100) / 50 AS v, user_id::double AS k FROM events)",
)
def formula_functions(spark, d):
    t = table(spark, d, "events").select("event_id", ((F.col("value") - 100) / 50).alias("v"), F.col("user_id").cast("double").alias("k"))
    v, k = F.col("v"), F.col("k")
    return t.select("event_id", *[(F.round(fx.stored(f(v, k)), 9) + 0.0).alias(f"f_{n}") for n, (f, _) in FORMULAS.items()])


@query(
    "formula_missing",
    "SELECT event_id, CASE WHEN v IS NULL THEN 0 ELSE (v > 50)::int END::double AS gt, "
    "(v IS NULL OR v <> 50)::int::double AS ne, least(coalesce(v, 10), 10) AS least10, "
    "greatest(coalesce(v, 10), 10) AS greatest10, (v IS NULL OR v <> 0)::int::double AS truthy, "
    "CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE v END AS pow0 "
    "FROM (SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN value END AS v FROM events)",
)
def formula_missing(spark, d):
    t = table(spark, d, "events")
    v = F.when(F.col("event_id") % 4 != 0, F.col("value"))
    v = F.when(F.col("event_id") % 8 == 4, F.lit(float("nan"))).otherwise(v)
    power = F.when(F.col("event_id") % 3 == 0, 0.0).otherwise(1.0)
    return t.select(
        "event_id", fx.flag(fx.gt(v, 50)).alias("gt"), fx.flag(fx.ne(v, 50)).alias("ne"),
        fx.stored(fx.least(v, 10)).alias("least10"), fx.stored(fx.greatest(v, 10)).alias("greatest10"),
        fx.flag(fx.truthy(v)).alias("truthy"), fx.stored(fx.power(v, power)).alias("pow0"),
    )


@query("sort_page", f"SELECT {LINE_SQL}, l_tax FROM lineitem ORDER BY l_extendedprice DESC, {LINE_SQL} LIMIT 50 OFFSET 100")
def sort_page(spark, d):
    t = table(spark, d, "lineitem").select(*LINE_KEY, "l_tax")
    return r.RowQuery(sort="l_extendedprice", desc=True).page(t, 100, 50, tie=LINE_KEY)


@query(
    "sort_page_filtered",
    "SELECT p_partkey, p_name, p_retailprice FROM part WHERE contains(lower(p_name), 'widget') AND p_retailprice > 910 "
    "ORDER BY p_name, p_partkey LIMIT 500",
)
def sort_page_filtered(spark, d):
    t = table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice")
    q = r.RowQuery(filters={"p_name": r.TextFilter("widget")}, cond=fx.gt("p_retailprice", 910), sort="p_name")
    return q.page(t, 0, 500, tie=["p_partkey"])


@query(
    "sort_blanks_first_descending",
    "SELECT event_id, v FROM (SELECT event_id, CASE WHEN event_id % 200 <> 7 THEN json_extract_string(props, '$.k') ELSE 'n/a' END AS v FROM events) "
    "ORDER BY TRY_CAST(v AS DOUBLE) DESC NULLS FIRST, event_id LIMIT 100",
)
def sort_blanks_first_descending(spark, d):
    v = F.when(F.col("event_id") % 200 != 7, F.get_json_object("props", "$.k")).otherwise("n/a")
    t = table(spark, d, "events").select("event_id", v.alias("v"))
    return r.sort_rows(t, "v", desc=True, tie=["event_id"], numeric=True).limit(100)


@query("page_file_order", f"WITH {EV} SELECT event_id, row_idx FROM ev ORDER BY row_idx LIMIT 20 OFFSET 40")
def page_file_order(spark, d):
    return r.RowQuery(columns=["event_id", ROW]).page(events(spark, d).df, 40)


@query("filtered_count", "SELECT count(*) AS total FROM lineitem WHERE l_quantity >= 10 AND l_returnflag = 'R'")
def filtered_count(spark, d):
    t = table(spark, d, "lineitem").select("l_quantity", "l_returnflag")
    return r.RowQuery(filters={"l_quantity": r.RangeFilter(low=10), "l_returnflag": r.TextFilter("r")}).total(t)


@query("view_index", "SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) - 1 AS view_row FROM part")
def view_index(spark, d):
    return r.view_index(table(spark, d, "part"), "p_size", ["p_partkey"], desc=True).select("p_partkey", "view_row")


@query("view_index_text_desc", "SELECT p_partkey, row_number() OVER (ORDER BY p_name DESC, p_partkey) - 1 AS view_row FROM part")
def view_index_text(spark, d):
    return r.view_index(table(spark, d, "part"), "p_name", ["p_partkey"], desc=True).select("p_partkey", "view_row")


@query("view_index_time_desc", "SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) - 1 AS view_row FROM events")
def view_index_time(spark, d):
    return r.view_index(table(spark, d, "events"), "ts", ["event_id"], desc=True).select("event_id", "view_row")


@query("infer_unit", """SELECT p_partkey, CASE WHEN regexp_matches(c, 'temp') THEN '°C' WHEN regexp_matches(c, 'inc|azi|tool-face|angle') THEN 'Degrees'
    WHEN regexp_matches(c, 'vibe|accel|shock|gx|gy|gz|grav') THEN 'G' WHEN contains(c, 'gamma') THEN 'CPS' WHEN regexp_matches(c, 'pulse|flow') THEN 'Counts'
    WHEN regexp_matches(c, '1v8|5v|3v3|bat|bus') THEN 'V' WHEN contains(c, 'current') THEN 'mA' WHEN regexp_matches(c, 'mag|mx|my|mz') THEN 'Gauss'
    WHEN contains(c, 'rpm') THEN 'RPM' ELSE 'units' END AS unit,
    CASE WHEN starts_with(c, 'raw') THEN 0 WHEN regexp_matches(c, 'calibrated|calculated|computed|corrected|derived|adjusted') THEN 2 ELSE 1 END AS role
    FROM (SELECT p_partkey, lower((['Temp ', 'raw_accel ', 'Calibrated azi ', 'Bus 5V ', 'RPM ', 'MagX '])[p_partkey % 6 + 1] || p_name) AS c FROM part)""")
def unit_names(spark, d):
    heads = F.array(*[F.lit(h) for h in ("Temp ", "raw_accel ", "Calibrated azi ", "Bus 5V ", "RPM ", "MagX ")])
    name = F.concat(F.get(heads, (F.col("p_partkey") % 6).cast("int")), F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", infer_unit(name).alias("unit"), channel_role(name).alias("role"))


@query("format_timestamp", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%g') END AS text FROM events")
def format_timestamp(spark, d):
    t = table(spark, d, "events")
    x = epoch_seconds(t, "ts")
    # a half-microsecond nudge keeps the cut to milliseconds clear of double rounding
    return t.select("event_id", format_epoch(F.when(F.col("event_id") % 3 == 0, F.floor(x).cast("double")).otherwise(x + 5e-7)).alias("text"))


@query("epoch_axis", "SELECT event_id, epoch_us(ts) / 1e6 AS x FROM events")
def epoch_axis(spark, d):
    t = table(spark, d, "events")
    return t.select("event_id", epoch_seconds(t, "ts").alias("x"))


@query(
    "repair_timestamps",
    f"WITH {EV}, b AS (SELECT event_id, row_idx, CASE WHEN row_idx < 5 OR row_idx % 7 < 2 THEN row_idx % 90 ELSE x END AS x FROM ev), "
    "g AS (SELECT *, last_value(CASE WHEN x >= 101 THEN row_idx END IGNORE NULLS) OVER w AS gr, "
    "last_value(CASE WHEN x >= 101 THEN x END IGNORE NULLS) OVER w AS gx FROM b WINDOW w AS (ORDER BY row_idx)), "
    "f AS (SELECT min(row_idx) AS fr, arg_min(x, row_idx) AS fx FROM b WHERE x >= 101) "
    "SELECT event_id, round(CASE WHEN x >= 101 THEN x WHEN gr IS NOT NULL THEN gx + 2.5 * (row_idx - gr) "
    "ELSE fx - 2.5 * (fr - row_idx) END, 6) AS x FROM g, f",
)
def repair(spark, d):
    o = events(spark, d)
    broken = F.when((F.col(ROW) < 5) | (F.col(ROW) % 7 < 2), (F.col(ROW) % 90).cast("double")).otherwise(F.col("x"))
    fixed = repair_timestamps(o.with_df(o.df.select("event_id", ROW, broken.alias("x"))), "x", 100.0, 2.5, "x")
    return rounded(fixed, 6, "x").select("event_id", "x")
