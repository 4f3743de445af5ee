"""File and typing queries: tables written out as text files by Spark and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strandline.functions.dates import epoch_of_text
from strandline.functions.numbers import to_number
from strandline.operators.rows import export_csv
from strandline.functions import fx
from strandline.plans.staging import shared_folder
from strandline.queries.registry import EV_BY, LINE_KEY, ROW, events, query, rounded, table
from strandline.sources import delimited, kinds, wide


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query(
    "to_number",
    "SELECT event_id, CASE event_id % 8 WHEN 0 THEN round(value, 6) WHEN 1 THEN round(-value, 6) WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN round(value, 6) WHEN 5 THEN 0.5 WHEN 6 THEN round(value * 1000, 6) ELSE NULL END AS v FROM events",
)
def numbers(spark, d):
    v = F.col("value").cast("string")
    forms = [v, F.concat(F.lit("-"), v), F.lit("n/a"), F.concat(v, F.lit("d")), F.concat(F.lit(" +"), v, F.lit(" ")), F.lit(".5"),
             F.concat(v, F.lit("e3")), F.lit("inf")]
    text = F.get(F.array(*forms), (F.col("event_id") % 8).cast("int"))
    return rounded(table(spark, d, "events").select("event_id", to_number(text).alias("v")), 6, "v")


@query(
    "parse_timestamps",
    "SELECT event_id, floor(epoch_us(ts) / 1000000) AS t_us, floor(epoch_us(ts) / 1000000) AS t_12h, floor(epoch_us(ts) / 1000) / 1000 AS t_frac, floor(epoch_us(ts) / 1000000) AS t_rfc FROM events",
)
def parse_timestamps(spark, d):
    ts = F.col("ts")
    t = table(spark, d, "events").select(
        "event_id", F.date_format(ts, "M/d/yyyy HH:mm:ss").alias("us"), F.date_format(ts, "dd/MM/yyyy hh:mm:ss a").alias("h12"),
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("fr"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("rf"),
    )
    return t.select(
        "event_id", epoch_of_text(F.col("us"), "%m/%d/%Y %H:%M:%S").alias("t_us"),
        epoch_of_text(F.col("h12"), "%d/%m/%Y %I:%M:%S %p").alias("t_12h"),
        epoch_of_text(F.col("fr"), "%Y-%m-%d %H:%M:%S%.f").alias("t_frac"), epoch_of_text(F.col("rf"), "rfc3339").alias("t_rfc"),
    )


@query(
    "infer_kinds",
    "SELECT * FROM (VALUES ('us_time', 'datetime', '%m/%d/%Y %I:%M:%S %p'), ('day', 'datetime', '%Y-%m-%d'), ('half', 'numeric', NULL), "
    "('third', 'text', NULL), ('kind', 'text', NULL), ('value', 'numeric', NULL)) t(\"column\", kind, date_format) WHERE EXISTS (SELECT 1 FROM events)",
)
def infer(spark, d):
    ts, v = F.col("ts"), F.col("value").cast("string")
    t = table(spark, d, "events").select(
        "event_id", F.date_format(ts, "MM/dd/yyyy hh:mm:ss a").alias("us_time"), F.date_format(ts, "yyyy-MM-dd").alias("day"),
        F.when(F.col("event_id") % 2 == 0, v).otherwise("").alias("half"), F.when(F.col("event_id") % 3 == 0, v).otherwise("x").alias("third"),
        F.col("event_type").alias("kind"), "value",
    )
    return kinds.infer_kinds(t, ["event_id"]).select("column", "kind", "date_format")


def _messy(spark, d) -> str:
    """Line items as semicolon text with a quoted, comma-holding label and a missing tax now and then."""
    path = _folder(spark) + ".dat"
    t = table(spark, d, "lineitem").select(
        *LINE_KEY, F.concat(F.col("l_returnflag"), F.lit('; "'), F.col("l_linestatus"), F.lit('"')).alias("label"),
        F.when(F.col("l_linenumber") != 3, F.col("l_tax")).alias("l_tax"),
    )
    t.write.csv(path, sep=";", header=True, escape='"')
    return path


def _written(df, top, line, path) -> None:
    """Lines as text files, each with the same lines at its top."""
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    rows = df.select(line.alias("value"), first.alias("_top"))
    rows.select(F.explode(F.when(F.col("_top"), F.array(*[F.lit(t) for t in top], F.col("value"))).otherwise(F.array("value")))).write.text(path)


@query(
    "load_delimited",
    "SELECT l_orderkey::double AS l_orderkey, l_linenumber::double AS l_linenumber, l_extendedprice, l_returnflag || '; \"' || l_linestatus || '\"' AS label, "
    "CASE WHEN l_linenumber <> 3 THEN l_tax END AS l_tax FROM lineitem",
)
def load(spark, d):
    t = delimited.load_delimited(spark, _messy(spark, d))
    numbers = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_tax"]
    return t.select(*[to_number(F.col(c)).alias(c) for c in numbers], "label")


@query("sniff_files", "SELECT DISTINCT ';' AS delimiter, 0 AS header_row, 7 AS width, 'UTF-8' AS encoding FROM lineitem")
def sniff(spark, d):
    s = delimited.sniff_files(spark, _messy(spark, d))
    return s.select("delimiter", "header_row", F.size("columns").alias("width"), "encoding").distinct()


@query("sniffed_lines", "SELECT count(*) AS rows FROM lineitem")
def sniffed_lines(spark, d):
    s = delimited.sniff_files(spark, _messy(spark, d))
    return s.agg((F.sum("lines") - F.count(F.lit(1))).alias("rows"))


@query("export_filtered", "SELECT count(*) AS rows_written, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_quantity > 40 AND l_tax < 0.03")
def export(spark, d):
    path = _folder(spark) + ".csv"
    n = export_csv(table(spark, d, "lineitem"), path, ["l_orderkey", "l_extendedprice"], fx.and_(fx.gt("l_quantity", 40), fx.lt("l_tax", 0.03)))
    back = delimited.load_delimited(spark, path)
    return back.agg(F.round(F.sum(to_number(F.col("l_extendedprice"))), 2).alias("total")).select(F.lit(n).alias("rows_written"), "total")


@query(
    "merge_date_time",
    "SELECT event_id::double AS event_id, floor(epoch_us(ts) / 1000000) AS t FROM events",
)
def merge(spark, d):
    path = _folder(spark) + ".tsv"
    ts = F.col("ts")
    t = table(spark, d, "events").select(
        F.date_format(ts, "MM/dd/yyyy").alias("Date"), F.date_format(ts, "hh:mm:ss a").alias("Time"), "event_id"
    )
    t.write.csv(path, sep="\t", header=True)
    back = delimited.load_delimited(spark, path)
    return back.select(to_number(F.col("event_id")).alias("event_id"), epoch_of_text(F.col("Date Time"), "%m/%d/%Y %I:%M:%S %p").alias("t"))


@query(
    "typed_load",
    "SELECT event_id::double AS event_id, event_type, round(value, 6) AS value, CASE WHEN event_id % 7 <> 0 THEN ts::date END AS day FROM events",
)
def typed_load(spark, d):
    """Text turned into numbers and days; the days are written day first, so only whole columns tell the layout."""
    path = _folder(spark) + ".csv"
    day = F.when(F.col("event_id") % 7 != 0, F.date_format("ts", "dd/MM/yyyy")).otherwise("")
    table(spark, d, "events").select("event_id", "event_type", "value", day.alias("Day.of event")).write.csv(path, header=True)
    loaded = delimited.load_delimited(spark, path, merge_times=False)
    got = kinds.typed(loaded, kinds.infer_kinds(loaded, delimited.ROW_ORDER))
    return got.select("event_id", "event_type", F.round("value", 6).alias("value"), F.col("`Day.of event`").cast("date").alias("day"))


@query(
    "load_headers",
    "SELECT l_orderkey::double AS a, l_linenumber::double AS b, l_partkey::double AS c, l_suppkey::double AS e FROM lineitem",
)
def load_headers(spark, d):
    """Headers with dots, and two that differ in case only once they are trimmed."""
    path = _folder(spark) + ".csv"
    names = {"l_orderkey": "acc.x", "l_linenumber": "acc.y", "l_partkey": "Temp", "l_suppkey": "temp "}
    table(spark, d, "lineitem").select(*[F.col(c).alias(n) for c, n in names.items()]).write.csv(path, header=True)
    got = delimited.load_delimited(spark, path)
    return got.select(*[to_number(F.col(f"`{c}`")).alias(n) for c, n in (("acc.x", "a"), ("acc.y", "b"), ("Temp", "c"), ("temp (2)", "e"))])


@query(
    "load_quoted_breaks",
    "SELECT l_orderkey::double AS l_orderkey, l_linenumber::double AS l_linenumber, l_extendedprice, CASE WHEN l_linenumber % 2 = 0 "
    "THEN 'flag ' || l_returnflag || chr(10) || chr(10) || 'status; \"' || l_linestatus || '\"' ELSE l_returnflag || ' 5\" pipe' END AS note FROM lineitem",
)
def load_quoted_breaks(spark, d):
    """Records of one line and of three, with quotes inside quoted cells and inside plain ones."""
    path = _folder(spark) + ".dat"
    note = F.when(
        F.col("l_linenumber") % 2 == 0,
        F.concat(F.lit('"flag '), "l_returnflag", F.lit('\n\nstatus; ""'), "l_linestatus", F.lit('"""')),
    ).otherwise(F.concat("l_returnflag", F.lit(' 5" pipe')))
    _written(table(spark, d, "lineitem"), ["l_orderkey;note;l_linenumber;l_extendedprice"], F.concat_ws(";", "l_orderkey", note, "l_linenumber", "l_extendedprice"), path)
    t = delimited.load_delimited(spark, path)
    return t.select(*[to_number(F.col(c)).alias(c) for c in ("l_orderkey", "l_linenumber", "l_extendedprice")], "note")


@query("load_preamble", "SELECT l_orderkey::double AS \"Column 1\", l_quantity AS \"T3 X\", l_tax AS \"T3 Y\" FROM lineitem")
def load_preamble(spark, d):
    """Title lines, a blank line and a header with an unnamed first column at the top of every file."""
    path = _folder(spark) + ".dat"
    top = ["Report of the run", "Number of Channels: 2", "", "Frequency, Hz: 10", "\tT3 X\tT3 Y"]
    _written(table(spark, d, "lineitem"), top, F.concat_ws("\t", "l_orderkey", "l_quantity", "l_tax"), path)
    t = delimited.load_delimited(spark, path)
    return t.select(*[to_number(F.col(f"`{c}`")).alias(c) for c in ("Column 1", "T3 X", "T3 Y")])


@query("load_ragged", "SELECT l_orderkey::double AS a, l_linenumber::double AS b, CASE WHEN l_linenumber % 3 <> 0 THEN l_tax END AS c FROM lineitem")
def load_ragged(spark, d):
    """Every third record a cell short, every fifth one with two cells too many."""
    path = _folder(spark) + ".txt"
    n = F.col("l_linenumber")
    extra = F.when((n % 5 == 0) & (n % 3 != 0), F.lit("|more|cells")).otherwise("")
    line = F.concat(F.concat_ws("|", "l_orderkey", "l_linenumber", F.when(n % 3 != 0, F.col("l_tax"))), extra)
    _written(table(spark, d, "lineitem"), ["a|b|c"], line, path)
    t = delimited.load_delimited(spark, path)
    return t.select(*[to_number(F.col(c)).alias(c) for c in ("a", "b", "c")])


@query("load_latin1", "SELECT l_orderkey::double AS k, 'Größe ' || l_returnflag || ' °C' AS \"Maß\" FROM lineitem")
def load_latin1(spark, d):
    path = _folder(spark) + ".csv"
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.concat(F.lit("Größe "), "l_returnflag", F.lit(" °C")).alias("Maß"))
    t.write.csv(path, header=True, encoding="ISO-8859-1")
    got = delimited.load_delimited(spark, path)
    return got.select(to_number(F.col("k")).alias("k"), "Maß")


@query("overview", "SELECT * FROM (SELECT count(*) AS rows FROM customer), (VALUES (0, 'c_custkey', 'numeric'), (1, 'c_name', 'text'), (2, 'c_nationkey', 'numeric'), (3, 'c_acctbal', 'numeric'), (4, 'c_mktsegment', 'text')) t(\"index\", name, kind)")
def overview(spark, d):
    t = table(spark, d, "customer")
    return delimited.overview(t, kinds.infer_kinds(t.select("c_custkey", *[F.col(c).cast("string").alias(c) for c in t.columns[1:]]).withColumn("_o", F.col("c_custkey")), ["_o"]))


@query(
    "wide_export",
    f"WITH {EV_BY}, c AS (SELECT row_idx, x, value FROM ev WHERE event_type = 'click'), p AS (SELECT row_idx, value FROM ev WHERE event_type = 'purchase'), "
    "s AS (SELECT coalesce(c.row_idx, p.row_idx) AS row_idx, c.value AS a, p.value AS b FROM c FULL JOIN p USING (row_idx)) "
    "SELECT row_idx, a::decimal(18, 2)::double AS click, b::decimal(18, 2)::double AS purchase FROM s",
)
def wide_export(spark, d):
    o = events(spark, d, "event_type")
    w = wide.wide_series(o, "event_type", "x", "value", ["click", "purchase"])
    return w.select(ROW, F.round(to_number(F.col("click")), 2).alias("click"), F.round(to_number(F.col("purchase")), 2).alias("purchase"))
