"""Delimited text files of unknown layout.

One streaming pass over the file splits keeps a bounded state of each: its first and last lines, byte validity, and
what its quotes do to a reader that enters it outside or inside a quoted cell.  States of a file merge in
file order, so no line is sorted or shuffled.  Files of one layout are then read together as text columns: by
Spark's CSV reader, or, where quoted cells hold line breaks, from records assembled within the splits, each
entered in the state that the splits before it leave, and stitched where a record crosses a split.
"""

from __future__ import annotations

import csv
import io
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.plans.ordering import BROADCAST_ROWS, join_sized
from strandline.plans.staging import stage
from strandline.sources.kinds import column, merge_date_time

ROW_ORDER = ["_file", "_block", "_pos"]

# Accepted extensions, delimiters in order of preference, and how much of a file is looked at.
EXTENSIONS = ["csv", "dat", "txt", "tsv"]
DELIMITERS = ["\t", ",", ";", "|"]
TAIL_LINES, HEAD_RECORDS, HEAD_LINES = 40, 50, 200

LAYOUT = "_file string, delimiter string, header_row int, columns array<string>, encoding string, lines bigint, breaks boolean"
STATE = (
    "_file string, _block bigint, head array<binary>, tail array<binary>, lines bigint, valid boolean, ends array<int>, opens array<int>"
)
ARROW_STATE = pa.schema(
    [("_file", pa.string()), ("_block", pa.int64()), ("head", pa.list_(pa.binary())), ("tail", pa.list_(pa.binary())), ("lines", pa.int64()),
     ("valid", pa.bool_()), ("ends", pa.list_(pa.int32())), ("opens", pa.list_(pa.int32()))]
)
GROUP_BYTES = 1 << 37  # splits of so many bytes are merged before their file's states are
OUTSIDE, INSIDE = 0, 1


def detect_delimiter(lines: Sequence[str]) -> str:
    """The delimiter with the best (share of rows with the usual column count) x (that count)."""
    best, best_score = ",", 0.0
    for d in DELIMITERS:
        widths = Counter(line.count(d) + 1 for line in lines)
        usual = max((w for w in widths if w > 1), key=lambda w: (widths[w], -w), default=None)
        if usual is not None and widths[usual] / len(lines) * usual > best_score:
            best, best_score = d, widths[usual] / len(lines) * usual
    return best


def _is_number(cell: str) -> bool:
    try:
        float(cell)
    except ValueError:
        return False
    return "_" not in cell


# Layouts that make a header cell a date, numbers by field: year, month, day, hour, minute, second.
HEADER_DATES = [
    r"(?P<y>\d{4})-(?P<m>\d{1,2})-(?P<d>\d{1,2}) (?P<h>\d{1,2}):(?P<i>\d{1,2}):(?P<s>\d{1,2})",
    r"(?P<m>\d{1,2})/(?P<d>\d{1,2})/(?P<y>\d{4}) (?P<h>\d{1,2}):(?P<i>\d{1,2}):(?P<s>\d{1,2})",
    r"(?P<d>\d{1,2})/(?P<m>\d{1,2})/(?P<y>\d{4}) (?P<h>\d{1,2}):(?P<i>\d{1,2}):(?P<s>\d{1,2})",
    r"(?P<m>\d{1,2})/(?P<d>\d{1,2})/(?P<y>\d{4})",
]
LIMITS = {"m": (1, 12), "d": (1, 31), "h": (0, 23), "i": (0, 59), "s": (0, 60)}


def _is_date_like(cell: str) -> bool:
    """Whether one of the layouts fits the whole cell with every field in its range."""
    fits = (re.fullmatch(layout, cell) for layout in HEADER_DATES)
    return any(all(LIMITS[k][0] <= int(v) <= LIMITS[k][1] for k, v in f.groupdict().items() if k != "y") for f in fits if f)


def detect_header(records: Sequence[Sequence[str]]) -> int:
    """Index of the header record: from the bottom, the first all-text record of the usual width.

    Otherwise the first record of the usual width.  Among equally common widths the larger counts.
    """
    widths = Counter(len(r) for r in records)
    usual = max(widths, key=lambda w: (widths[w], w))
    fitting = [i for i, r in enumerate(records) if len(r) == usual]
    for i in reversed(fitting):
        cells = [c.strip() for c in records[i]]
        if all(c and not _is_number(c) and not _is_date_like(c) for c in cells):
            return i
    return fitting[0]


def column_names(header: Sequence[str]) -> list[str]:
    """Trimmed names, `Column 3` for blank ones, and ` (2)` added to repeats."""
    out: list[str] = []
    taken = {c.lower() for c in ROW_ORDER}
    for i, h in enumerate(header):
        name = h.strip() or f"Column {i + 1}"
        base, k = name, 2
        while name.lower() in taken:  # Spark does not tell names by case
            name, k = f"{base} ({k})", k + 1
        taken.add(name.lower())
        out.append(name)
    return out


# ---------------------------------------------------------------- quotes across lines


class Quotes:
    """Whether a line ends inside a quoted cell, by the side of the quotes on which it begins.

    A quote opens a cell only as its first character; inside, two quotes are one; after the closing quote the rest
    of the cell is plain.
    """

    def __init__(self, delimiter: str):
        d, inner = re.escape(delimiter.encode()), rb'(?:[^"]|"")*+'
        opened = rb'(?:(?:"' + inner + rb'"[^' + d + rb']*+|[^"' + d + rb"][^" + d + rb"]*+)?+" + d + rb')*+"' + inner
        self.outside = re.compile(opened, re.DOTALL)
        self.still = re.compile(inner, re.DOTALL)
        self.again = re.compile(inner + rb'"[^' + d + rb"]*+" + d + opened, re.DOTALL)

    def after(self, state: int, line: bytes) -> int:
        if b'"' not in line:
            return state
        if state == OUTSIDE:
            return int(self.outside.fullmatch(line) is not None)
        return int(self.still.fullmatch(line) is not None or self.again.fullmatch(line) is not None)


class Effects:
    """What lines do to a reader, each as one byte: bit 2 * k + s is the side on which a reader that uses delimiter k
    and enters the line on side s leaves it.

    Only quotes and delimiters count, so lines of one shape are looked at once; long ones are not kept.
    """

    SHAPES, LONGEST = 1 << 16, 512

    def __init__(self):
        special = b'"' + "".join(DELIMITERS).encode()
        self.plain = bytes(b if b in special else 0 for b in range(256))
        self.quotes, self.known = [Quotes(d) for d in DELIMITERS], {}
        side, f = np.arange(256)[:, None], np.arange(256)[None, :]
        bits = range(2 * len(DELIMITERS))
        #: the byte after a line, by 256 * (the byte before it) + the line's effect
        self.then = sum(((f >> (b & ~1) + (side >> b & 1)) & 1) << b for b in bits).ravel().tolist()

    def of(self, line: bytes) -> int:
        shape = line.translate(self.plain)
        f = self.known.get(shape)
        if f is None:
            if len(self.known) >= self.SHAPES:
                self.known.clear()
            f = sum(q.after(s, shape) << 2 * k + s for k, q in enumerate(self.quotes) for s in (OUTSIDE, INSIDE))
            if len(shape) <= self.LONGEST:
                self.known[shape] = f
        return f


@dataclass
class Split:
    """What is kept of a stretch of a file: bounded first and last lines, and for each delimiter the side of the
    quotes on which a reader leaves it, and whether a line ended inside, by the side on which it enters."""

    head_lines: int
    tail_lines: int
    head: list[bytes] = field(default_factory=list)
    tail: list[bytes] = field(default_factory=list)
    lines: int = 0
    valid: bool = True
    ends: list[list[int]] = field(default_factory=lambda: [[OUTSIDE, INSIDE] for _ in DELIMITERS])
    opens: list[list[bool]] = field(default_factory=lambda: [[False, False] for _ in DELIMITERS])

    def add(self, head: list[bytes], tail: list[bytes], lines: int, valid: bool) -> None:
        if len(self.head) < self.head_lines:
            self.head += head[: self.head_lines - len(self.head)]
        self.tail = (self.tail + tail)[-self.tail_lines :]
        self.lines += lines
        self.valid &= valid

    def pass_lines(self, lines: Sequence[bytes], effects: Effects) -> None:
        pack = lambda pairs: sum(int(v) << 2 * k + i for k, pair in enumerate(pairs) for i, v in enumerate(pair))
        now, seen, then, of = pack(self.ends), pack(self.opens), effects.then, effects.of
        for line in lines:
            now = then[now << 8 | of(line)]
            seen |= now
        unpack = lambda byte: [[byte >> 2 * k + i & 1 for i in (OUTSIDE, INSIDE)] for k in range(len(DELIMITERS))]
        self.ends, self.opens = unpack(now), [[bool(v) for v in pair] for pair in unpack(seen)]

    def pass_split(self, ends: Sequence[int], opens: Sequence[int]) -> None:
        for mine, seen, e, o in zip(self.ends, self.opens, ends, opens, strict=True):
            for i in (OUTSIDE, INSIDE):
                seen[i] |= bool(o >> mine[i] & 1)
                mine[i] = e >> mine[i] & 1

    def row(self, file: str, block: int) -> dict:
        pack = lambda pairs: [int(a) | int(b) << 1 for a, b in pairs]
        return {"_file": file, "_block": block, "head": self.head, "tail": self.tail, "lines": self.lines, "valid": self.valid, "ends": pack(self.ends), "opens": pack(self.opens)}


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """The batch cut where another split begins."""
    if not batch.num_rows:
        return
    file, block = batch["_file"], batch["_block"].to_numpy()
    new = pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False) | (block[1:] != block[:-1])
    at = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(at, at[1:]):
        yield file[lo].as_py(), int(block[lo]), batch.slice(lo, hi - lo)


def _flags(run: pa.RecordBatch, name: str) -> np.ndarray:
    return run[name].to_numpy(zero_copy_only=False).astype(bool)


def _look_at_splits(batches: Iterator[pa.RecordBatch], head_lines: int, tail_lines: int) -> Iterator[pa.RecordBatch]:
    """One bounded row for each split; a task reads its splits one after another."""
    effects, now, split = Effects(), None, None

    def state() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([split.row(*now)], schema=ARROW_STATE)

    for batch in batches:
        for file, block, run in _runs(batch):
            if (file, block) != now:
                if now is not None:
                    yield state()
                now, split = (file, block), Split(head_lines, tail_lines)
            seen = np.flatnonzero(~_flags(run, "blank"))
            lines = lambda at: run["value"].take(pa.array(at)).to_pylist()  # noqa: B023, E731
            head = lines(seen[: head_lines - len(split.head)]) if len(split.head) < head_lines else []
            split.add(head, lines(seen[max(0, len(seen) - tail_lines) :]), len(seen), bool(_flags(run, "valid")[seen].all()))
            split.pass_lines(lines(np.flatnonzero(_flags(run, "quoted"))), effects)
    if now is not None:
        yield state()


def _merged(pdf: pd.DataFrame, head_lines: int, tail_lines: int) -> Split:
    out = Split(head_lines, tail_lines)
    for r in pdf.sort_values("_block").itertuples(index=False):
        out.add(list(r.head), list(r.tail), r.lines, r.valid)
        out.pass_split(r.ends, r.opens)
    return out


def _merge_splits(pdf: pd.DataFrame, head_lines: int, tail_lines: int) -> pd.DataFrame:
    return pd.DataFrame([_merged(pdf, head_lines, tail_lines).row(pdf["_file"].iloc[0], int(pdf["_block"].min()))])


def _look(pdf: pd.DataFrame, head_lines: int, head_records: int, tail_lines: int) -> pd.DataFrame:
    """Layout of one file from its merged state; a file without a line that is not blank has none.

    Records span lines only if all quotes close: one that stays open to the end of the file would swallow it.
    """
    s = _merged(pdf, head_lines, tail_lines)
    if not s.lines:
        return pd.DataFrame(columns=[c.split()[0] for c in LAYOUT.split(", ")])
    encoding = "utf-8" if s.valid else "latin-1"
    head, tail = ([line.decode(encoding) for line in part] for part in (s.head, s.tail))
    sep = detect_delimiter(tail)
    k = DELIMITERS.index(sep)
    breaks = s.opens[k][OUTSIDE] and s.ends[k][OUTSIDE] == OUTSIDE
    source = io.StringIO("\n".join(head)) if breaks else head
    records = [r for r in csv.reader(source, delimiter=sep) if r][:head_records]
    at = detect_header(records)
    return pd.DataFrame(
        {
            "_file": [pdf["_file"].iloc[0]], "delimiter": [sep], "header_row": [at],
            "columns": [column_names(records[at])], "encoding": ["UTF-8" if s.valid else "ISO-8859-1"],
            "lines": [s.lines], "breaks": [breaks],
        }
    )


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    raw = spark.read.option("recursiveFileLookup", "true").text(list(paths))
    return raw.select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_pos"), F.col("value"),
    )


def _splits(spark: SparkSession, paths: Sequence[str], head_lines: int, tail_lines: int) -> DataFrame:
    d = _lines(spark, paths).select(
        "_file", "_block", F.col("value").cast("binary").alias("value"), (F.length(F.trim("value")) == 0).alias("blank"),
        F.is_valid_utf8("value").alias("valid"), F.contains("value", F.lit('"')).alias("quoted"),
    )
    return stage(d.mapInArrow(lambda batches: _look_at_splits(batches, head_lines, tail_lines), STATE))


def _layouts(splits: DataFrame, head_lines: int, head_records: int, tail_lines: int) -> DataFrame:
    some = splits.groupBy("_file", F.floor(F.col("_block") / GROUP_BYTES).alias("_g")).applyInPandas(lambda pdf: _merge_splits(pdf, head_lines, tail_lines), STATE)
    return some.groupBy("_file").applyInPandas(lambda pdf: _look(pdf, head_lines, head_records, tail_lines), LAYOUT)


def sniff_files(spark: SparkSession, paths: Sequence[str] | str, head_lines: int = HEAD_LINES, head_records: int = HEAD_RECORDS, tail_lines: int = TAIL_LINES) -> DataFrame:
    """Layout per file: (_file, delimiter, header_row, columns, encoding, lines, breaks).

    Blank lines do not count.  The delimiter comes from the last `tail_lines` lines, the header from the first
    `head_records` records within the first `head_lines` lines.  `breaks` tells that quoted cells hold line breaks.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    return _layouts(_splits(spark, paths, head_lines, tail_lines), head_lines, head_records, tail_lines)


def _check_extension(path: str) -> None:
    ext = path.rsplit("/", 1)[-1].rsplit(".", 1)
    if len(ext) == 2 and ext[1].lower() not in EXTENSIONS:
        raise ValueError(f"unsupported file format: .{ext[1]}")


def load_delimited(
    spark: SparkSession, paths: Sequence[str] | str, merge_times: bool = True, header_row: int | None = None,
    head_lines: int = HEAD_LINES, head_records: int = HEAD_RECORDS, tail_lines: int = TAIL_LINES,
) -> DataFrame:
    """All data rows as text columns, plus the row order columns `_file`, `_block`, `_pos`.

    Short records are padded with empty cells, extra cells dropped.  Line breaks inside quoted cells stay, as
    `\\n`; in a file whose last quote never closes every line is a record.  Files with different columns are
    united by name.  The row order columns are a unique key for `order_rows`.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    for p in paths:
        _check_extension(p)
    splits = _splits(spark, paths, head_lines, tail_lines)
    layouts = _layouts(splits, head_lines, head_records, tail_lines)
    if header_row is not None:
        layouts = layouts.withColumn("header_row", F.lit(header_row))
    layouts = stage(layouts)
    layout = ["delimiter", "header_row", "columns", "encoding", "breaks"]
    kinds = layouts.select(*layout).distinct().collect()
    if not kinds:
        raise ValueError("no data found")
    out = None
    for k in kinds:
        own = layouts.filter(reduce(Column.__and__, [F.col(c).eqNullSafe(F.lit(k[c])) for c in layout])).select("_file")
        if k.breaks:
            part = _read_records(spark, paths, k, splits.join(own, "_file", "left_semi"))
        else:
            part = _read(spark, paths, k)
            if len(kinds) > 1:  # each layout takes its own files; their names stay distributed
                part = part.join(own, "_file", "left_semi")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    names = [c for c in out.columns if c not in ROW_ORDER]
    out = out.select(*ROW_ORDER, *[F.coalesce(column(c), F.lit("")).alias(c) for c in names])
    return merge_date_time(out, ROW_ORDER) if merge_times else out


def _csv_options(k) -> dict:
    return {"sep": k.delimiter, "mode": "PERMISSIVE", "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "\u0000"}


def _cells(k) -> T.StructType:
    return T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(k.columns))])


def _read(spark: SparkSession, files: Sequence[str], k) -> DataFrame:
    raw = spark.read.option("recursiveFileLookup", "true").csv(
        list(files), schema=_cells(k), header=k.header_row == 0, encoding=k.encoding, enforceSchema=True, **_csv_options(k)
    )
    d = raw.select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_pos"), *[f"_c{i}" for i in range(len(k.columns))],
    )
    if k.header_row > 0:
        # preamble and header sit in a file's first split, whose rows are numbered without gaps
        cut = d.filter("_block = 0").groupBy("_file").agg((F.min("_pos") + k.header_row).alias("_cut"))
        d = join_sized(d, cut, ["_file"]).filter((F.col("_block") > 0) | (F.col("_pos") > F.col("_cut"))).drop("_cut")
    return d.select(*ROW_ORDER, *[F.col(f"_c{i}").alias(c) for i, c in enumerate(k.columns)])


# ---------------------------------------------------------------- records of several lines

WHOLE, OPENED, CONTINUED, CLOSED = range(4)
RECORD = "_file string, _block bigint, _pos bigint, nth bigint, part int, record binary"
ARROW_RECORD = pa.schema(
    [("_file", pa.string()), ("_block", pa.int64()), ("_pos", pa.int64()), ("nth", pa.int64()), ("part", pa.int32()), ("record", pa.binary())]
)


def _entries(pdf: pd.DataFrame, delimiter: int) -> pd.DataFrame:
    """The side of the quotes on which a reader enters each split of a file."""
    pdf = pdf.sort_values("_block")
    state, out = OUTSIDE, []
    for ends in pdf["ends"]:
        out.append(state)
        state = ends[delimiter] >> state & 1
    return pdf[["_file", "_block"]].assign(entry=out)


def _assemble(batches: Iterator[pa.RecordBatch], delimiter: str, edges: bool = False) -> Iterator[pa.RecordBatch]:
    """Records of each split in order.  Lines before the first record of a split and after its last whole one are
    parts of a record that crosses its edges.  Blank lines between records are dropped.  With `edges` only such parts
    are sure to be given, so that whole records are not made twice."""
    effects, k, now = Effects(), DELIMITERS.index(delimiter), None
    state, held, start, nth, inherited = OUTSIDE, [], 0, 0, False

    def made(pos: np.ndarray, numbers: np.ndarray, parts: np.ndarray, records: pa.Array) -> pa.RecordBatch:
        file, block = (pa.repeat(v, len(records)) for v in now)
        return pa.RecordBatch.from_arrays([file, block, pa.array(pos), pa.array(numbers), pa.array(parts), records], schema=ARROW_RECORD)

    def leave() -> Iterator[pa.RecordBatch]:
        if held:
            part = CONTINUED if inherited else OPENED
            yield made(np.array([start]), np.array([nth]), np.array([part], dtype="int32"), pa.array([b"\n".join(held)], pa.binary()))

    for batch in batches:
        for file, block, run in _runs(batch):
            if (file, block) != now:
                if now is not None:
                    yield from leave()
                now, state, held, nth = (file, block), run["entry"][0].as_py(), [], 0
                inherited = state == INSIDE
            quoted = _flags(run, "quoted")
            sides = [state]
            for line in run["value"].take(pa.array(np.flatnonzero(quoted))).to_pylist():
                sides.append(effects.of(line) >> 2 * k + sides[-1] & 1)
            after = np.array(sides)[np.cumsum(quoted)]
            before = np.append(state, after[:-1])
            state = sides[-1]
            kept = np.flatnonzero((before == INSIDE) | ~_flags(run, "blank"))
            values, pos = run["value"].take(pa.array(kept)), run["_pos"].to_numpy()[kept]
            cuts = np.append(0, np.flatnonzero(after[kept] == OUTSIDE) + 1)
            whole = len(cuts) - 1
            if whole and edges and not inherited:
                held, nth = [], nth + whole
            elif whole:
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values[: cuts[-1]])
                records, at = pc.binary_join(lists, b"\n"), pos[cuts[:-1]]
                if held:
                    records = pa.concat_arrays([pa.array([b"\n".join([*held, records[0].as_py()])], pa.binary()), records[1:]])
                    at[0], held = start, []
                parts = np.full(whole, WHOLE, dtype="int32")
                numbers = nth + np.arange(whole)
                if inherited:  # the end of a record that another split has begun
                    parts[0], inherited = CLOSED, False
                    numbers[1:] -= 1
                    nth -= 1
                nth += whole
                yield made(at, numbers, parts, records)
            if cuts[-1] < len(kept):
                if not held:
                    start = int(pos[cuts[-1]])
                held += values[cuts[-1] :].to_pylist()
    if now is not None:
        yield from leave()


def _read_records(spark: SparkSession, paths: Sequence[str], k, splits: DataFrame) -> DataFrame:
    """Rows of files whose records span lines."""
    at = DELIMITERS.index(k.delimiter)
    entries = stage(splits.select("_file", "_block", "ends").groupBy("_file").applyInPandas(lambda pdf: _entries(pdf, at), "_file string, _block bigint, entry int"))
    d = _lines(spark, paths).select(
        "_file", "_block", "_pos", F.col("value").cast("binary").alias("value"), F.rlike("value", F.lit(r"\A\s*\z")).alias("blank"),
        F.contains("value", F.lit('"')).alias("quoted"),
    )
    if entries.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        d = d.join(F.broadcast(entries), ["_file", "_block"])  # keeps the order of lines
    else:
        d = d.join(entries, ["_file", "_block"]).repartition("_file", "_block").sortWithinPartitions(*ROW_ORDER)
    records = d.mapInArrow(lambda batches: _assemble(batches, k.delimiter), RECORD)
    crossing = d.mapInArrow(lambda batches: _assemble(batches, k.delimiter, True), RECORD)
    # parts of one record: its opening and all that follows up to the next opening, at most two parts a split
    parts = crossing.filter(F.col("part") != WHOLE)
    order = Window.partitionBy("_file").orderBy("_block", "_pos")
    parts = parts.withColumn("_g", F.sum(F.when(F.col("part") == OPENED, 1).otherwise(0)).over(order))
    joined = parts.groupBy("_file", "_g").agg(F.sort_array(F.collect_list(F.struct("_block", "_pos", "nth", "record"))).alias("p"))
    first = F.col("p")[0]
    text = lambda r: F.decode(r, k.encoding)
    whole = records.filter(F.col("part") == WHOLE).select(*ROW_ORDER, "nth", text(F.col("record")).alias("record"))
    joined = joined.select(
        "_file", first["_block"].alias("_block"), first["_pos"].alias("_pos"), first["nth"].alias("nth"),
        F.array_join(F.transform("p", lambda p: text(p["record"])), "\n").alias("record"),
    )
    d = whole.unionByName(joined).filter((F.col("_block") > 0) | (F.col("nth") > k.header_row))
    d = d.withColumn("_r", F.from_csv("record", _cells(k).simpleString()[len("struct<") : -1].replace(":", " "), _csv_options(k)))
    return d.select(*ROW_ORDER, *[F.col(f"_r._c{i}").alias(c) for i, c in enumerate(k.columns)])


def overview(df: DataFrame, kinds: DataFrame) -> DataFrame:
    """(index, name, kind, rows) of a loaded table."""
    n = df.agg(F.count(F.lit(1)).alias("c")).scalar()
    return kinds.select(F.col("position").alias("index"), F.col("column").alias("name"), "kind", n.alias("rows"))
