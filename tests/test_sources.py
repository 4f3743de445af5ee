"""Delimited files, dates, kinds and exports."""

import pytest
from pyspark.sql import functions as F

from strandline import order_rows
from strandline.functions import fx
from strandline.functions.dates import RFC3339, epoch_of_text, matches_date, matches_time
from strandline.functions.numbers import to_number
from strandline.operators.rows import export_csv, filter_rows
from strandline.plans.layout import ROW
from strandline.sources import delimited, kinds, wide
from strandline.sources.delimited import ROW_ORDER, detect_delimiter, detect_header, load_delimited, sniff_files


def write(tmp_path, name, text, encoding="utf-8"):
    p = tmp_path / name
    p.write_bytes(text.encode(encoding))
    return str(p)


def data(df):
    cols = [c for c in df.columns if c not in ROW_ORDER]
    return cols, [tuple(r) for r in df.orderBy(*ROW_ORDER).select(*[F.col(f"`{c}`") for c in cols]).collect()]


def test_plain_csv(spark, tmp_path):
    cols, got = data(load_delimited(spark, write(tmp_path, "a.csv", "time,temp\n0,20.0\n1,21.5\n")))
    assert cols == ["time", "temp"] and got == [("0", "20.0"), ("1", "21.5")]


def test_preamble_dat(spark, tmp_path):
    text = "Report of run 7\nNumber of Channels: 3\n\nFrequency, Hz: 10\n\tT3 X\tT3 Y\tT3 Z\n" + "".join(
        f"{i}.0E+00\t1.5E-0{i}\t2.0\t3.0\n" for i in range(1, 5)
    )
    cols, got = data(load_delimited(spark, write(tmp_path, "b.dat", text)))
    assert cols == ["Column 1", "T3 X", "T3 Y", "T3 Z"] and len(got) == 4
    s = sniff_files(spark, str(tmp_path / "b.dat")).first()
    assert (s.delimiter, s.header_row) == ("\t", 3)


def test_date_and_time_columns_join(spark, tmp_path):
    text = "Date,Time,Temp\n07/07/2026,02:55:14 PM,21.7\n07/07/2026,02:55:15 PM,21.6\n,,3\n"
    df = load_delimited(spark, write(tmp_path, "c.csv", text))
    cols, got = data(df)
    assert cols == ["Date Time", "Temp"] and got[0][0] == "07/07/2026 02:55:14 PM" and got[2][0] == ""
    k = {r.column: (r.kind, r.date_format) for r in kinds.infer_kinds(df.filter("Temp <> '3'"), ROW_ORDER).collect()}
    assert k == {"Date Time": ("datetime", "%m/%d/%Y %I:%M:%S %p"), "Temp": ("numeric", None)}


def test_ragged_quoted_and_pipe(spark, tmp_path):
    text = 'a|b|c\n1|"x|y ""q"""|3\n4|5\n6|7|8|9\n'
    cols, got = data(load_delimited(spark, write(tmp_path, "d.txt", text)))
    assert got == [("1", 'x|y "q"', "3"), ("4", "5", ""), ("6", "7", "8")]


def test_latin1(spark, tmp_path):
    cols, got = data(load_delimited(spark, write(tmp_path, "e.csv", "Temp °C,n\n20,1\n21,2\n", "latin-1")))
    assert cols == ["Temp °C", "n"] and got == [("20", "1"), ("21", "2")]


def test_many_files_of_two_layouts(spark, tmp_path):
    d = tmp_path / "many"
    d.mkdir()
    for i in range(3):
        write(d, f"x{i}.csv", "t,v\n" + "".join(f"{j},{i}\n" for j in range(5)))
    write(d, "y.csv", "title line\nt;w\n1;2\n3;4\n")
    df = load_delimited(spark, str(d))
    assert df.count() == 17 and set(df.columns) == {*ROW_ORDER, "t", "v", "w"}
    o = order_rows(df, ROW_ORDER, by="_file")
    assert o.df.filter("v = '1'").orderBy(ROW).select(ROW, "t").collect() == [(i, str(i)) for i in range(5)]


def test_large_file_keeps_order(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        p = write(tmp_path, "big.csv", "n,v\n" + "".join(f"{i},{i * 0.5}\n" for i in range(40000)))
        df = load_delimited(spark, p)
        assert df.select("_block").distinct().count() > 1
        o = order_rows(df, ROW_ORDER)
        assert o.n == 40000 and o.df.filter(F.col(ROW) != F.col("n").cast("bigint")).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_bad_extension(spark):
    with pytest.raises(ValueError, match="unsupported"):
        load_delimited(spark, "/tmp/file.json")


def test_detectors():
    assert detect_delimiter(["1,2;3,5", "4,4;6,1"]) == ","
    assert detect_delimiter(["one column", "only"]) == ","
    assert detect_header([["a", "b"], ["1", "x"], ["2", "y"]]) == 0
    assert detect_header([["title"], ["a", "b"], ["2024-01-01 10:00:00", "y"]]) == 1
    assert detect_header([["title"], ["", "b"], ["1", "2"]]) == 1


def test_numbers(spark):
    cells = [" 1.5 ", "+.5", "5.", "1e3", "-2E-1", "1d", "0x1p3", "inf", "nan", "", "a", None, "1,5"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    got = [r.v for r in df.select("i", to_number(F.col("c")).alias("v")).orderBy("i").collect()]
    assert got == [1.5, 0.5, 5.0, 1000.0, -0.2] + [None] * 8


@pytest.mark.parametrize(
    "text,fmt,want",
    [
        ("2024-02-10T14:30:00Z", RFC3339, 1707575400.0),
        ("1970-01-01T00:00:00Z", RFC3339, 0.0),
        ("2024-02-10T14:30:00.2509+02:00", RFC3339, 1707568200.25),
        ("2024-02-10 14:30:00", "%Y-%m-%d %H:%M:%S", 1707575400.0),
        ("2/1/2024 1:02:03", "%m/%d/%Y %H:%M:%S", 1706749323.0),
        ("2/1/2024 1:02:03", "%d/%m/%Y %H:%M:%S", 1704157323.0),
        ("07/07/2026 02:55:14 pm", "%m/%d/%Y %I:%M:%S %p", 1783436114.0),
        ("2024-02-10 14:30:00.5", "%Y-%m-%d %H:%M:%S%.f", 1707575400.5),
        ("2024-02-10 14:30:00", "%Y-%m-%d %H:%M:%S%.f", 1707575400.0),
        ("2024-02-10", "%Y-%m-%d", 1707523200.0),
        ("02/30/2024", "%m/%d/%Y", None),
        ("2024-02-10 14:30:00 x", "%Y-%m-%d %H:%M:%S", None),
        ("hello", "%Y-%m-%d", None),
        ("", RFC3339, None),
    ],
)
def test_dates(spark, text, fmt, want):
    assert spark.range(1).select(epoch_of_text(F.lit(text), fmt).alias("t")).first().t == want


def test_dates_in_another_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        r = spark.range(1).select(
            epoch_of_text(F.lit("2024-03-10 02:30:00"), "%Y-%m-%d %H:%M:%S").alias("a"),
            epoch_of_text(F.lit("1970-01-01T00:00:00Z"), RFC3339).alias("b"),
        ).first()
        assert (r.a, r.b) == (1710037800.0, 0.0)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_time_of_day(spark):
    cells = ["02:55:14 PM", "14:55", "25:00:00", "2024-01-01"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = [tuple(r) for r in df.select(*[matches_time(F.col("c"), f).alias(f"f{i}") for i, f in enumerate(["%I:%M:%S %p", "%H:%M", "%H:%M:%S"])]).collect()]
    assert got == [(True, False, False), (False, True, False), (False, False, False), (False, False, False)]


def test_month_first_wins_ties(spark):
    df = spark.createDataFrame([(i, f"0{i + 1}/02/2024") for i in range(5)], "i int, d string")
    assert kinds.guess_dates(df, ["d"])["d"].date_format == "%m/%d/%Y"
    assert spark.range(1).select(matches_date(F.lit("13/02/2024"), "%m/%d/%Y").alias("m")).first().m is False


def test_kinds(spark):
    rows = [(i, f"2024-01-0{i + 1} 00:00:00", str(10 * i), "alpha") for i in range(3)]
    df = spark.createDataFrame(rows, "i int, ts string, val string, label string")
    k = kinds.infer_kinds(df, ["i"])
    assert {r.column: r.kind for r in k.collect()} == {"ts": "datetime", "val": "numeric", "label": "text"}
    t = kinds.typed(df, k)
    assert [f.dataType.simpleString() for f in t.schema] == ["int", "timestamp_ntz", "double", "string"]
    assert delimited.overview(df, k).filter("name = 'ts'").first().rows == 3


def test_export_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"', 2.5), (2, "x", None), (3, "y", 9.0)], "k int, s string, v double")
    n = export_csv(df, str(tmp_path / "out.csv"), ["s", "v"], fx.ne("v", 9))
    assert n == 2
    _, got = data(load_delimited(spark, str(tmp_path / "out.csv")))
    assert sorted(got) == [('a,"b"', "2.5"), ("x", "")]


def test_wide_export(spark, tmp_path):
    rows = [("p", i, float(i), i / 4) for i in range(3)] + [("q", i, 10.0 + i, -1.0) for i in range(2)]
    o = order_rows(spark.createDataFrame(rows, "s string, i int, x double, y double"), "i", "s")
    w = wide.wide_series(o, "s", "x", "y", ["p", "q"], "time")
    assert [tuple(r)[1:] for r in w.orderBy(ROW).collect()] == [("0", "0", "-1"), ("1", "0.25", "-1"), ("2", "0.5", "")]
    wide.export_wide(w, str(tmp_path / "wide"))
    text = "".join(open(p).read() for p in sorted((tmp_path / "wide").glob("part*")))
    assert text.splitlines()[0] == "time,p,q"


def test_row_local_functions_on_a_stream(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    d = tmp_path / "in"
    d.mkdir()
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(str(d / "part"))
    live = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(d))
    out = filter_rows(live, fx.gt("value", 50)).select("event_id", fx.ln("value").alias("v"))
    q = out.writeStream.format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("seen").count() == spark.read.parquet(f"{sf}/events.parquet").filter("value > 50").count()


BROKEN = 'title;"of\nthe run"\nk;note;v\n' + "".join(
    f'{i};"line one of {i}\n\nsaid ""{i};{i}"";\n"tail;{i}\n' if i % 3 == 0 else f'{i};plain 5" pipe;{i}\n' if i % 3 == 1 else f'{i};"a;b";{i}\n' for i in range(3000)
)


def broken_rows():
    # the reader of single records keeps what follows a closing quote in the cell
    note = {0: lambda i: f'line one of {i}\n\nsaid "{i};{i}";\n', 1: lambda i: 'plain 5" pipe', 2: lambda i: "a;b"}
    return [(str(i), note[i % 3](i), str(i)) for i in range(3000)]


@pytest.mark.parametrize("split", [4096, 1 << 27])
def test_quoted_line_breaks_across_splits(spark, tmp_path, split):
    text = BROKEN.replace('"tail;', '";')
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        df = load_delimited(spark, write(tmp_path, "broken.csv", text))
        cols, got = data(df)
        assert cols == ["k", "note", "v"] and got == broken_rows()
        s = sniff_files(spark, str(tmp_path / "broken.csv")).first()
        assert (s.delimiter, s.header_row, s.breaks) == (";", 1, True)
        assert split > 4096 or df.select("_block").distinct().count() > 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_record_longer_than_splits_and_latin1(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        long = "\n".join(f"ligne très {i}" for i in range(2000))
        cols, got = data(load_delimited(spark, write(tmp_path, "long.csv", f'a,b\n1,x\n2,"{long}"\n3,"y\nz"\n', "latin-1")))
        assert cols == ["a", "b"] and got == [("1", "x"), ("2", long), ("3", "y\nz")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_quote_that_never_closes_keeps_lines_apart(spark, tmp_path):
    s = write(tmp_path, "open.csv", 'a,b\n1,x\n2,"y\n3,z\n')
    assert sniff_files(spark, s).first().breaks is False
    assert [r[0] for r in data(load_delimited(spark, s))[1]] == ["1", "2", "3"]


def test_lines_are_neither_sorted_nor_windowed(spark, tmp_path):
    d = tmp_path / "few"
    d.mkdir()
    write(d, "p.csv", "title\na,b\n1,2\n3,4\n")
    write(d, "q.csv", "\n  \n")
    write(d, "r.csv", "a,b\n" + "5,6\n" * 300)
    plan = sniff_files(spark, str(d))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    df = load_delimited(spark, str(d))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort " not in plan.replace("SortMergeJoin", "")
    assert df.count() == 302
    s = sniff_files(spark, str(d / "r.csv"), head_lines=5, head_records=3, tail_lines=2).first()
    assert (s.lines, s.delimiter, s.header_row) == (301, ",", 0)


@pytest.mark.parametrize("sep", [",", ";"])
def test_quotes_follow_the_csv_rules(sep):
    import csv
    import random

    rng = random.Random(1)
    q = delimited.Quotes(sep)
    for _ in range(3000):
        text = "".join(rng.choice(f'ab"{sep}\n"') for _ in range(rng.randrange(1, 25)))
        state, count = 0, 0
        for line in text.split("\n"):
            count += state == 0
            state = q.after(state, line.encode())
        if not text.endswith("\n"):
            assert count == sum(1 for _ in csv.reader(text.splitlines(True), delimiter=sep)), text


def test_lines_of_one_shape_are_looked_at_once(monkeypatch):
    import random

    import pyarrow as pa

    calls, after = [], delimited.Quotes.after
    monkeypatch.setattr(delimited.Quotes, "after", lambda self, state, line: calls.append(line) or after(self, state, line))
    lines = [b'%d;"A; ""%d""";0.5' % (i % 10, i % 7) for i in range(5000)] + [b'5;"open', b'', b'still";6']
    n = len(lines)
    batch = pa.RecordBatch.from_pydict({
        "_file": ["f"] * n, "_block": pa.array([0] * n, pa.int64()), "value": pa.array(lines, pa.binary()), "blank": [not v for v in lines],
        "valid": [True] * n, "quoted": [b'"' in v for v in lines],
    })
    out = [r for b in delimited._look_at_splits(iter([batch[:3000], batch[3000:5001], batch[5001:]]), 9, 4) for r in b.to_pylist()]
    k = delimited.DELIMITERS.index(";")
    assert [(r["lines"], len(r["head"]), r["tail"]) for r in out] == [(n - 1, 9, [v for v in lines if v][-4:])]
    assert out[0]["ends"][k] & 1 == 0 and out[0]["opens"][k] & 1 == 1 and len(calls) < 100

    rng, effects = random.Random(2), delimited.Effects()
    for _ in range(3000):
        line = "".join(rng.choice('ab";,|\t') for _ in range(rng.randrange(0, 14))).encode()
        for i, d in enumerate(delimited.DELIMITERS):
            for side in (0, 1):
                assert effects.of(line) >> 2 * i + side & 1 == after(delimited.Quotes(d), side, line)
