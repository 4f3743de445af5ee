"""Data-quality detectors on an ordered table and the ranked list of findings.

Only per-channel, per-segment and per-event facts (bounded by the number of columns) are read back to
the driver; everything that grows with the rows stays distributed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import fx
from strandline.functions.times import epoch_seconds
from strandline.functions.units import channel_role
from strandline.operators.rows import number_of, top_per_group
from strandline.operators.stats import _stack, median_mad, named, segment_of, to_long
from strandline.plans.blocks import group_runs, longest_runs, over_blocks
from strandline.plans.layout import ROW
from strandline.plans.ordering import Ordered, facts
from strandline.plans.ranks import pick_ranks, upper_median_rank
from strandline.plans.selection import medians_and_deviations
from strandline.plans.staging import local_copy, stage, stage_rows

# Fixed values of the detectors.
ROBUST_SIGMA = 1.4826
GAP_FACTOR = 3.0
ZERO_SHARE, MISSING_SHARE = 0.95, 0.05
FROZEN_SHARE, FROZEN_ROWS = 0.05, 30
OUTLIER_Z, OUTLIER_MIN_ROWS, GLITCH_ROWS, GLITCH_RANGES = 10.0, 20, 4, 10
CHANGE_MIN_ROWS, CHANGE_FACTOR, CULPRIT_RATIO = 60, 6.0, 5.0
NOISE_FLOOR = 1e-9
RANKS = {"high": 0, "medium": 1, "low": 2}

# Fixed values below: the wording of the findings' details is an output that has to match.
FINDING = (
    "severity string, kind string, column string, detail string, row bigint, "
    "rows array<struct<start:bigint,end:bigint>>, first_gap_row bigint, onset_row bigint, "
    "culprit array<string>, affected array<string>"
)
ORDER = "rank int, phase int, position int, part int, at bigint"


def _finding(df: DataFrame, severity, kind: str, detail: Column, phase: int, part: int, position=0, at=0, **fields) -> DataFrame:
    made = {"severity": severity if isinstance(severity, Column) else F.lit(severity), "kind": F.lit(kind), "detail": detail}
    made |= fields
    made |= {"phase": F.lit(phase), "part": F.lit(part)}
    made["position"] = position if isinstance(position, Column) else F.lit(position)
    made["at"] = at if isinstance(at, Column) else F.lit(at)
    made["rank"] = reduce(
        lambda acc, kv: F.when(made["severity"] == kv[0], kv[1]).otherwise(acc), list(RANKS.items())[:2], F.lit(2)
    )
    cols = []
    for f in f"{FINDING}, {ORDER}".split(", "):
        name, kind_ = f.split(" ", 1)
        cols.append(made.get(name, F.lit(None)).cast(kind_).alias(name))
    return df.select(*cols)


# ---------------------------------------------------------------- time axis


def time_steps(o: Ordered, ts: str) -> DataFrame:
    t = o.df.select(ROW, epoch_seconds(o.df, ts).alias("_t"))
    d = over_blocks(o.with_df(t), 1, 0, lambda w: {"dt": fx.finite(F.col("_t") - F.lag("_t").over(w))})
    return d.filter("dt is not null").select(ROW, "dt")


def time_gaps(o: Ordered, ts: str) -> DataFrame:
    """Steps over 3 upper-median steps: (n_gaps, lost, first_gap_row), one row when there are any."""
    steps = time_steps(o, ts)
    med = pick_ranks(steps.filter("dt > 0").select("dt"), "dt", {"m": upper_median_rank}, (), o.n, o.layout)
    d = steps.withColumn("_f", facts(med.agg(F.max("m").alias("m"))))
    m = F.col("_f.m")
    gap = d.filter((F.col("dt") > m * GAP_FACTOR) & (F.col("dt") > m + 1e-6))
    out = gap.agg(
        F.count(F.lit(1)).alias("n_gaps"), F.sum(F.col("dt") - m).alias("lost"), (F.min(ROW) - 1).alias("first_gap_row")
    )
    return out.filter((F.col("n_gaps") > 0) & F.lit(o.n >= 3))


# ---------------------------------------------------------------- single channels


def channel_facts(o: Ordered, channels: Sequence[str]) -> DataFrame:
    """Finite / zero / total counts, constancy and longest run per channel, one row each."""
    df = o.df

    def of(c: str) -> Column:
        v = number_of(df, c)
        constant = (F.count(c) == F.count(F.lit(1))) & F.min(c).eqNullSafe(F.max(c))
        return F.struct(
            F.count(F.lit(1)).alias("n"), F.count(v).alias("n_finite"),
            F.count(F.when(v == 0, 1)).alias("n_zero"), constant.alias("constant"),
        )

    return _stack(df, {c: of(c) for c in channels}).join(longest_runs(o, channels), "column", "left")


def dead(facts_: DataFrame) -> DataFrame:
    share = F.lit(100.0) * F.col("n_zero") / F.col("n_finite")
    d = facts_.filter("n_finite > 0")
    const = d.filter("constant")
    zero = d.filter(~F.col("constant") & (F.col("n_zero") / F.col("n_finite") > ZERO_SHARE))
    return _finding(
        const, "high", "dead", F.lit("single distinct value (dead/constant)"), 1, 0, F.col("position"), column=F.col("column")
    ).unionByName(
        _finding(
            zero, "high", "dead", F.format_string("%.0f%% zero", F.bround(share, 0)), 1, 0, F.col("position"), column=F.col("column")
        )
    )


def frozen(facts_: DataFrame) -> DataFrame:
    # a lone distinct value is the "dead" case; an all-missing channel has one distinct cell too
    varied = ~F.col("constant") & (F.col("n_finite") > 0)
    hit = varied & (F.col("longest_run") > F.greatest(F.col("n") * FROZEN_SHARE, F.lit(float(FROZEN_ROWS))))
    detail = F.format_string("stuck for %d consecutive rows", F.col("longest_run"))
    return _finding(facts_.filter(hit), "medium", "frozen", detail, 1, 1, F.col("position"), column=F.col("column"))


def missing(facts_: DataFrame) -> DataFrame:
    lost = F.col("n") - F.col("n_finite")
    detail = F.format_string("%.1f%% missing (%d rows)", F.bround(F.lit(100.0) * lost / F.col("n"), 1), lost)
    hit = (F.col("n") > 0) & (lost / F.col("n") > MISSING_SHARE)
    return _finding(facts_.filter(hit), "medium", "missing", detail, 1, 2, F.col("position"), column=F.col("column"))


def segment_count(n: int) -> int:
    return min(max(n // 200, 8), 40)


@dataclass(frozen=True)
class Levels:
    """Upper median and MAD of each channel in each equal row segment and, under the number `segments`, in all rows."""

    segments: int
    found: dict[tuple[int, int], dict]


def channel_levels(o: Ordered, channels: Sequence[str]) -> Levels:
    """Levels of all channels and segments from the same scans."""
    k = segment_count(o.n)
    return Levels(k, medians_and_deviations(o.df, [number_of(o.df, c) for c in channels], upper_median_rank, segment_of(k, o.n), k))


def outliers(o: Ordered, channels: Sequence[str], levels: Levels | None = None) -> DataFrame:
    """(column, position, row_idx) with |v - median| / (1.4826 MAD) > 10, for channels of 20+ values, MAD > 0."""
    if levels is None:
        levels = Levels(0, medians_and_deviations(o.df, [number_of(o.df, c) for c in channels], upper_median_rank))
    mine = {c: v for (s, c), v in levels.found.items() if s == levels.segments}
    known = {channels[c]: (v["median"], v["mad"]) for c, v in mine.items() if v["n"] >= OUTLIER_MIN_ROWS and v["mad"] > 0}
    marks = [
        F.when(
            F.abs(number_of(o.df, c) - known[c][0]) / (ROBUST_SIGMA * known[c][1]) > OUTLIER_Z,
            F.struct(F.lit(c).alias("column"), F.lit(i).alias("position")),
        )
        for i, c in enumerate(channels)
        if c in known
    ]
    if not marks:
        return o.df.sparkSession.createDataFrame([], f"column string, position int, {ROW} bigint")
    hits = o.df.select(ROW, F.explode(F.array_compact(F.array(*marks))).alias("c"))
    return hits.select("c.column", "c.position", ROW)


def outlier_runs(o: Ordered, channels: Sequence[str], levels: Levels | None = None) -> DataFrame:
    """Outliers at most 3 rows apart joined: (column, position, start, end, count)."""
    return group_runs(outliers(o, channels, levels), ("column", "position"), o.block, 2)


def glitches(runs: DataFrame) -> DataFrame:
    short = runs.filter(F.col("count") <= GLITCH_ROWS)
    total = short.groupBy("column", "position").agg(F.sum("count").alias("n"))
    ranges = (
        top_per_group(short, ["column"], ["start"], GLITCH_RANGES)
        .groupBy("column")
        .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("ranges"))
    )
    d = total.join(ranges, "column")
    detail = F.format_string("%d isolated out-of-range sample(s)", F.col("n"))
    return _finding(d, "high", "glitch", detail, 1, 4, F.col("position"), column=F.col("column"), rows=F.col("ranges"))


def regimes(runs: DataFrame) -> DataFrame:
    d = runs.filter(F.col("count") > GLITCH_ROWS)
    detail = F.format_string("%d consecutive out-of-range samples (a regime, not a glitch)", F.col("count"))
    return _finding(
        d, "medium", "outlier_regime", detail, 1, 3, F.col("position"), F.col("start"),
        column=F.col("column"), rows=F.array(F.struct("start", "end")),
    )


# ---------------------------------------------------------------- level shifts


def segment_levels(o: Ordered, channels: Sequence[str], levels: Levels | None = None) -> tuple[DataFrame, int]:
    """Upper median and MAD per channel and equal row segment; at most 40 rows per channel."""
    levels = levels or channel_levels(o, channels)
    rows = [(c, s, v["n"], v["median"], v["mad"]) for (s, c), v in levels.found.items() if s < levels.segments]
    return o.df.sparkSession.createDataFrame(rows, "position int, segment int, n bigint, median double, mad double"), levels.segments


def changepoints(o: Ordered, channels: Sequence[str], levels: Levels | None = None) -> DataFrame:
    """At most one level shift per channel, placed on its row: (position, column, onset, shift).

    Without `levels` the indexed channels are written once for the scans that find them.
    """
    spark = o.df.sparkSession
    empty = "position int, column string, onset bigint, shift double"
    if o.n < CHANGE_MIN_ROWS:
        return spark.createDataFrame([], empty)
    if levels is None:
        o = stage_rows(o, *dict.fromkeys(channels))
    levels, k = segment_levels(o, channels, levels)
    seq = Window.partitionBy("position").orderBy("segment")
    mads = F.sort_array(F.collect_list("mad").over(Window.partitionBy("position")))
    noise = F.greatest(F.get(mads, F.floor(F.size(mads) / 2).cast("int")) * ROBUST_SIGMA, F.lit(NOISE_FLOOR))
    d = levels.withColumn("_noise", noise).withColumn("m0", F.lag("median").over(seq))
    d = d.withColumn("_before", F.lag("segment").over(seq))
    jump = (F.col("_before") == F.col("segment") - 1) & (F.abs(F.col("median") - F.col("m0")) > F.col("_noise") * CHANGE_FACTOR)
    first = d.filter(jump).groupBy("position").agg(F.min(F.struct("segment", "m0", "median")).alias("f"))
    found = first.select("position", "f.segment", "f.m0", F.col("f.median").alias("m1")).collect()
    if not found:
        return spark.createDataFrame([], empty)
    return _localize(o, channels, found, k)


def _localize(o: Ordered, channels: Sequence[str], found, k: int) -> DataFrame:
    """First row of the two segments whose trailing mean crosses the middle of the two levels."""
    marks = []
    for r in found:
        lo, hi = (r.segment - 1) * o.n // k, (r.segment + 1) * o.n // k
        win = min(max((hi - lo) // 6, 5), 300)
        at = F.struct(
            F.lit(r.position).alias("position"), F.lit(channels[r.position]).alias("column"),
            number_of(o.df, channels[r.position]).alias("value"), F.lit(lo).cast("bigint").alias("lo"), F.lit(hi).cast("bigint").alias("hi"),
            F.lit(win).alias("win"), F.lit(float(r.m0)).alias("m0"), F.lit(float(r.m1)).alias("m1"),
        )
        marks.append((lo, hi, win, F.when((F.col(ROW) >= lo) & (F.col(ROW) < hi), at)))
    near = reduce(Column.__or__, [(F.col(ROW) >= lo) & (F.col(ROW) < hi) for lo, hi, _, _ in marks])
    rows = o.df.filter(near).select(ROW, F.explode(F.array_compact(F.array(*[m for *_, m in marks]))).alias("c"))
    rows = rows.select(ROW, "c.*")
    wins = sorted({w for _, _, w, _ in marks})

    def build(w):
        mean = F.lit(None).cast("double")
        for win in wins:
            mean = F.when(F.col("win") == win, F.avg("value").over(w.rowsBetween(-win, 0))).otherwise(mean)
        return {"_mean": mean}

    series = Ordered(rows, o.n, ("column",), o.layout)
    d = over_blocks(series, max(wins), 0, build)
    mid = (F.col("m0") + F.col("m1")) * 0.5
    crossed = F.when(F.col("m1") >= F.col("m0"), F.col("_mean") >= mid).otherwise(F.col("_mean") <= mid)
    out = d.groupBy("position", "column", "lo", "hi", "m0", "m1").agg(F.min(F.when(crossed, F.col(ROW))).alias("_r"))
    return out.select(
        "position", "column", F.coalesce("_r", F.floor((F.col("lo") + F.col("hi")) / 2)).cast("bigint").alias("onset"),
        (F.col("m1") - F.col("m0")).alias("shift"),
    )


def tolerance(n: int) -> int:
    return max(n // 50, 20)


def cluster_events(cps: DataFrame, n: int) -> DataFrame:
    """Changepoints chained while at most `tolerance` rows apart (at most one row per channel)."""
    seq = Window.orderBy("onset", "position")
    fresh = F.coalesce(F.col("onset") > F.lag("onset").over(seq) + tolerance(n), F.lit(True)).cast("int")
    return cps.withColumn("_f", fresh).withColumn("cluster", F.sum("_f").over(seq)).drop("_f")


def shift_ratios(o: Ordered, raw: Sequence[str], onsets: Mapping[int, int], half: int) -> DataFrame:
    """Level shift against noise at each event for each raw channel: (cluster, column, position, ratio)."""
    spans = [
        F.when(
            (F.col(ROW) >= max(at - half, 0)) & (F.col(ROW) < at + half),
            F.struct(F.lit(c).alias("cluster"), (F.col(ROW) >= at).alias("after")),
        )
        for c, at in onsets.items()
        if 0 < at < o.n
    ]
    if not spans:
        return o.df.sparkSession.createDataFrame([], "cluster bigint, column string, position int, ratio double")
    d = o.df.select(ROW, *raw, F.explode(F.array_compact(F.array(*spans))).alias("s"))
    d = d.withColumn("cluster", F.col("s.cluster").cast("bigint")).withColumn("after", F.col("s.after"))
    long = to_long(d, raw, ("cluster", "after"))
    n = min(o.n, 2 * half * len(onsets)) * len(raw)
    mm = median_mad(long, "value", ("cluster", "position", "after"), n, layout=o.layout, largest=half)
    side = lambda after, c: F.max(F.when(F.col("after") == after, F.col(c)))
    both = mm.groupBy("cluster", "position").agg(
        side(False, "median").alias("m0"), side(True, "median").alias("m1"), F.max("mad").alias("mad"),
        F.count(F.lit(1)).alias("sides"),
    )
    ratio = F.abs(F.col("m1") - F.col("m0")) / F.greatest(F.col("mad") * ROBUST_SIGMA, F.lit(NOISE_FLOOR))
    return named(both.filter("sides = 2").withColumn("ratio", ratio), raw).select("cluster", "column", "position", "ratio")


def events(
    o: Ordered, channels: Sequence[str], cps: DataFrame, lineage: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """Findings for clustered level shifts, traced to a source by name, lineage or co-occurrence."""
    cps = local_copy(cps)
    members = cluster_events(cps, o.n)
    ordered = F.sort_array(F.collect_list(F.struct("onset", "position", "column", "shift")))
    cl = members.groupBy("cluster").agg(F.min("onset").alias("onset"), ordered.alias("m"))
    cl = cl.select("cluster", "onset", F.col("m.column").alias("affected"), F.get("m", F.lit(0))["shift"].alias("shift"))
    named = F.filter("affected", lambda c: channel_role(c) == 0)
    hints = {d: [_resolve(o.df, s) for s in src] for d, src in (lineage or {}).items()}
    hints = {d: [s for s in src if s] for d, src in hints.items()}
    if hints:
        table = F.create_map(*[x for d, src in hints.items() for x in (F.lit(d), F.array(*[F.lit(s) for s in src]).cast("array<string>"))])
        traced = F.flatten(F.transform("affected", lambda c: F.coalesce(F.try_element_at(table, c), F.array().cast("array<string>"))))
    else:
        traced = F.array().cast("array<string>")
    cl = cl.withColumn("culprit", F.array_distinct(F.concat(named, traced)))
    raw = [c for c in channels if c.lower().startswith("raw")]
    open_ = {r.cluster: (r.onset, r.affected) for r in cl.filter(F.size("culprit") == 0).collect()} if raw else {}
    if open_:
        half = max(tolerance(o.n), 30)
        ratios = shift_ratios(o, raw, {c: v[0] for c, v in open_.items()}, half)
        ratios = ratios.join(F.broadcast(cl.select("cluster", "affected")), "cluster")
        ratios = ratios.filter((F.col("ratio") > CULPRIT_RATIO) & ~F.array_contains("affected", F.col("column")))
        best = ratios.groupBy("cluster").agg(F.max_by("column", F.struct("ratio", -F.col("position"))).alias("_c"))
        cl = cl.join(F.broadcast(local_copy(best)), "cluster", "left")
        cl = cl.withColumn("culprit", F.when(F.col("_c").isNotNull(), F.array("_c")).otherwise(F.col("culprit"))).drop("_c")
    cl = local_copy(cl)
    outside = F.size(F.array_except("culprit", "affected")) > 0
    single = (F.size("affected") == 1) & ~outside
    at = F.format_string("%d", F.col("onset"))
    shifts = _finding(
        cl.filter(single), "medium", "changepoint",
        F.concat(F.lit("median shifts "), F.format_string("%.4f", F.col("shift")), F.lit(" at ~row "), at),
        2, 0, 0, F.col("cluster"), column=F.get("affected", F.lit(0)), row=F.col("onset"),
    )
    known = F.size("culprit") > 0
    count = F.size("affected").cast("string")
    detail = F.when(
        known,
        F.concat(F.lit("level shift at ~row "), at, F.lit("; likely source: "), F.array_join("culprit", ", "),
                 F.lit("; affects "), count, F.lit(" channel(s)")),
    ).otherwise(
        F.concat(F.lit("coincident level shift across "), count, F.lit(" channels at ~row "), at, F.lit(" (source unclear)"))
    )
    joint = _finding(
        cl.filter(~single), F.when(known, "high").otherwise("medium"), "regime_change_event", detail, 2, 0, 0,
        F.col("cluster"), onset_row=F.col("onset"), culprit=F.col("culprit"), affected=F.col("affected"),
    )
    return shifts.unionByName(joint)


def _resolve(df: DataFrame, spec: str) -> str | None:
    """Column by index string or exact name."""
    cols = [c for c in df.columns if c != ROW]
    if spec.isdecimal() and int(spec) < len(cols):
        return cols[int(spec)]
    return spec if spec in cols else None


# ---------------------------------------------------------------- everything


def health_check(
    o: Ordered,
    channels: Sequence[str],
    time_col: str | None = None,
    lineage: Mapping[str, Sequence[str]] | None = None,
    ordered: bool = True,
) -> DataFrame:
    """All findings, most severe first: time gaps, then per channel, then level-shift events."""
    return check(o, channels, time_col, lineage, ordered).findings


@dataclass(frozen=True)
class Checked:
    """Findings, all outlier runs behind them, and the indexed channels as they were written for the check."""

    findings: DataFrame
    runs: DataFrame
    rows: Ordered


def check(
    o: Ordered,
    channels: Sequence[str],
    time_col: str | None = None,
    lineage: Mapping[str, Sequence[str]] | None = None,
    ordered: bool = False,
) -> Checked:
    """The findings with what they rest on, for reports that show rows as well.

    The indexed channels are written once to the shared folder, as are the outlier runs: every
    detector then scans columns instead of sorting the table again.
    """
    channels = list(channels)
    o = stage_rows(o, *dict.fromkeys([*([time_col] if time_col else []), *channels]))
    # four independent groups of jobs: submitted together, so that one's last tasks overlap the next
    with ThreadPoolExecutor(4) as pool:
        submit = lambda job: pool.submit(copy_context().run, job)
        gaps = submit(lambda: local_copy(time_gaps(o, time_col)) if time_col else None)
        per_channel = submit(lambda: local_copy(channel_facts(o, channels)))
        levels = channel_levels(o, channels)
        joined = submit(lambda: stage(outlier_runs(o, channels, levels)))
        shifts = submit(lambda: events(o, channels, changepoints(o, channels, levels), lineage))
        g, f, runs, parts = gaps.result(), per_channel.result(), joined.result(), [shifts.result()]
    parts += [dead(f), frozen(f), missing(f), regimes(runs), glitches(runs)]
    if g is not None:
        detail = F.format_string("%d gap(s), ~%.0fs of samples missing", F.col("n_gaps"), F.bround("lost", 0))
        parts.append(
            _finding(g, "medium", "time_gaps", detail, 0, 0, column=F.lit(time_col), first_gap_row=F.col("first_gap_row"))
        )
    found = reduce(DataFrame.unionByName, parts)
    found = found.orderBy(*[f.split(" ")[0] for f in ORDER.split(", ")]) if ordered else found
    return Checked(found, runs, o)


FINDING_COLUMNS = [f.split(" ")[0] for f in FINDING.split(", ")]
