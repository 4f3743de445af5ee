"""Tables behind the plot and the quality report."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions import fx
from strandline.functions.times import epoch_seconds
from strandline.operators import reduce as red
from strandline.operators import qc, stats, windows
from strandline.operators.derive import map_series
from strandline.operators.qc import FINDING_COLUMNS, GLITCH_ROWS
from strandline.operators.rows import log_y
from strandline.plans.layout import ROW
from strandline.plans.ordering import Ordered, order_rows
from strandline.plans.staging import stage_rows

SIGNIFICANT = ["changepoint", "regime_change_event", "glitch", "outlier_regime"]
OVERVIEW_COLUMNS, STACK_ABOVE, FLAGGED_SHOWN, FLAGGED_COLUMNS = 8, 3, 50, 8
X_PAD, Y_PAD, ROBUST_MIN = 0.03, 0.05, 20


def transform(o: Ordered, x: str, y: str, kind: str = "none", **params) -> DataFrame:
    """One named series transform written back to `y`.

    none, moving_average (window 5), derivative, integral, normalize (kind), abs, log, sqrt,
    resample (points 500, method linear).
    """
    if kind == "none":
        return o.df
    if kind == "moving_average":
        return windows.moving_average(o, y, params.get("window", 5), y)
    if kind == "derivative":
        return windows.derivative(o, x, y, y)
    if kind == "integral":
        return windows.integral(o, x, y, y)
    if kind == "normalize":
        return windows.normalize(o, y, y, params.get("kind", "minmax"))
    if kind in ("abs", "log", "sqrt"):
        return map_series(o.df, kind, y)
    if kind == "resample":
        g = red.resample(o, x, y, params.get("points", 500), params.get("method", "linear"))
        return g.select(*o.by, F.col("k").alias(ROW), F.col("x").alias(x), F.col("y").alias(y))
    raise ValueError(f"unknown transform {kind}")


def plot_series(
    o: Ordered,
    x: str,
    ys: Sequence[str],
    transform_kind: str = "none",
    rows: tuple[int | None, int | None] = (None, None),
    x_window: tuple[float | None, float | None] = (None, None),
    y_log: bool = False,
    downsample: str = "minmax",
    width: int = 900,
    layout: str = "overlay",
    **params,
) -> DataFrame:
    """The points a plot draws: (panel, series, row_idx, x, y) per y column.

    Transform, finite pairs, row and x window, log10, then reduction to about 2 * width points, only
    when a series has more than 4 * width.  `stacked` gives each series its own panel; `normalized`
    scales each to its own full range.  The indexed columns are written once for the scans of all series; only a
    series that lost rows is numbered again.
    """
    width = min(max(width, 200), 2000)
    budget = 2 * width
    parts = []
    base = o.with_df(o.df.select(ROW, epoch_seconds(o.df, x).alias("x"), *[F.col(c).alias(f"_y{i}") for i, c in enumerate(ys)]))
    base = stage_rows(base)
    for i, name in enumerate(ys):
        d = transform(base.with_df(base.df.select(ROW, "x", F.col(f"_y{i}").cast("double").alias("y"))), "x", "y", transform_kind, **params)
        d = d.select(F.col(ROW).alias("_old"), fx.finite(F.col("x")).alias("x"), fx.finite(F.col("y")).alias("y"))
        if rows[0] is not None:
            d = d.filter(F.col("_old") >= rows[0])
        if rows[1] is not None:
            d = d.filter(F.col("_old") < rows[1])
        if x_window[0] is not None:
            d = d.filter(F.col("x") >= float(x_window[0]))
        if x_window[1] is not None:
            d = d.filter(F.col("x") <= float(x_window[1]))
        d = d.filter("x is not null and y is not null")
        if y_log:
            d = log_y(d, "y")
        n = d.count()
        if downsample != "none" and n > 2 * budget:
            if n == o.n and transform_kind != "resample":
                s = Ordered(d.withColumnRenamed("_old", ROW), n, (), o.layout)
            else:
                s = order_rows(d, "_old", n=n, layout=o.layout)
                s = s.with_df(s.df.drop("_old"))
            pts = red.lttb(s, "x", "y", budget).drop("pick") if downsample == "lttb" else red.minmax_envelope(s, "x", "y", width)
        else:
            pts = d.withColumnRenamed("_old", ROW)
        pts = pts.select(F.lit(i if layout == "stacked" else 0).alias("panel"), F.lit(name).alias("series"), ROW, "x", "y")
        if layout == "normalized":
            # the scale is the full series' range, not the reduced points'
            ends = d.agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
            pts = pts.join(F.broadcast(ends), how="inner")
            span = F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-12))
            pts = pts.withColumn("y", (F.col("y") - F.col("lo")) / span).drop("lo", "hi")
        parts.append(pts)
    return reduce(DataFrame.unionByName, parts)


def plot_bounds(points: DataFrame, robust: bool = False) -> DataFrame:
    """View per panel: x padded 3 % over all panels, y padded 5 %, optionally 1st-99th percentile."""
    xs = points.agg(F.min("x").alias("a"), F.max("x").alias("b"))
    pad = F.greatest((F.col("b") - F.col("a")) * X_PAD, F.lit(1e-9))
    xs = xs.select((F.col("a") - pad).alias("x_min"), (F.col("b") + pad).alias("x_max"))
    ys = points.groupBy("panel").agg(F.min("y").alias("mn"), F.max("y").alias("mx"), F.count("y").alias("n"))
    if robust:
        q = stats.percentiles(points, "y", {"q1": 0.01, "q99": 0.99}, ("panel",)).drop("n")
        ys = ys.join(q, "panel", "left")
    else:
        ys = ys.withColumn("q1", F.col("mn")).withColumn("q99", F.col("mx"))
    use = (F.col("n") >= ROBUST_MIN) & (F.col("q99") > F.col("q1"))
    lo = F.when(use, F.col("q1")).when(F.col("mx") > F.col("mn"), F.col("mn")).otherwise(0.0)
    hi = F.when(use, F.col("q99")).when(F.col("mx") > F.col("mn"), F.col("mx")).otherwise(1.0)
    ys = ys.select("panel", lo.alias("lo"), hi.alias("hi"))
    pad = F.greatest((F.col("hi") - F.col("lo")) * Y_PAD, F.lit(1e-9))
    return ys.select("panel", (F.col("lo") - pad).alias("y_min"), (F.col("hi") + pad).alias("y_max")).join(
        F.broadcast(xs), how="inner"
    )


# ---------------------------------------------------------------- report


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def verdict(findings: DataFrame) -> DataFrame:
    """One row (verdict_class, verdict_text) from the severity counts."""
    def n(s: str) -> Column:
        return F.count(F.when(F.col("severity") == s, 1))

    c = findings.agg(n("high").alias("h"), n("medium").alias("m"), n("low").alias("l"))
    total = F.col("h") + F.col("m") + F.col("l")
    parts = F.array_compact(
        F.array(
            *[
                F.when(F.col(k) > 0, F.concat(F.col(k).cast("string"), F.lit(f" {w}")))
                for k, w in (("h", "High"), ("m", "Medium"), ("l", "Low"))
            ]
        )
    )
    # The wording of the verdict.
    text = F.concat(
        total.cast("string"), F.lit(" finding"), F.when(total == 1, "").otherwise("s"), F.lit(": "), F.array_join(parts, ", ")
    )
    cls = F.when(total == 0, "clean").when(F.col("h") > 0, "high").when(F.col("m") > 0, "medium").otherwise("low")
    return c.select(
        cls.alias("verdict_class"), F.when(total == 0, "No issues found — clean.").otherwise(text).alias("verdict_text")
    )


def location() -> Column:
    """Where a finding sits, as text; NULL when it names no row."""
    shown = F.transform(
        F.slice("rows", 1, 5), lambda r: F.concat(r["start"].cast("string"), F.lit("–"), r["end"].cast("string"))
    )
    text = F.concat(F.lit("rows "), F.array_join(shown, ", "))
    more = F.concat(text, F.lit(" (+"), (F.size("rows") - 5).cast("string"), F.lit(" more)"))
    return (
        F.when(F.col("row").isNotNull(), F.concat(F.lit("row "), F.col("row").cast("string")))
        .when(F.col("onset_row").isNotNull(), F.concat(F.lit("onset row "), F.col("onset_row").cast("string")))
        .when(F.col("first_gap_row").isNotNull(), F.concat(F.lit("first gap at row "), F.col("first_gap_row").cast("string")))
        .when(F.size("rows") > 5, more)
        .when(F.size("rows") > 0, text)
    )


def overview_columns(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[str | None, list[str], str]:
    """x (first time column, else first numeric), up to 8 numeric y's, and the layout."""
    times = [f.name for f in df.schema if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
    numbers = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name != ROW]
    x = times[0] if times else (numbers[0] if numbers else None)
    ys = [c for c in columns if c in numbers] if columns is not None else numbers[:OVERVIEW_COLUMNS]
    return x, ys, "stacked" if len(ys) > STACK_ABOVE else "overlay"


def focused_plots(findings: DataFrame, x: str, numeric: Sequence[str], max_plots: int = 6, has_overview: bool = True) -> DataFrame:
    """One plot per column named by a significant finding, most severe first: (column, kind, caption)."""
    room = max(min(max(max_plots, 1), 20) - int(has_overview), 0)
    name = F.coalesce("column", F.get("affected", F.lit(0)))
    at = F.coalesce("row", "onset_row", F.get("rows", F.lit(0))["start"])
    d = findings.filter(F.col("kind").isin(SIGNIFICANT)).withColumn("column", name)
    d = d.filter(F.col("column").isin(list(numeric)) & (F.col("column") != x))
    keys = ["rank", "phase", "position", "part", "at"]
    first = F.row_number().over(Window.partitionBy("column").orderBy(*keys))
    d = d.withColumn("_at", at).withColumn("_rn", first).filter("_rn = 1")
    caption = F.concat(
        F.col("kind"), F.lit(" — "), F.col("column"),
        F.coalesce(F.concat(F.lit(" (row ~"), F.col("_at").cast("string"), F.lit(")")), F.lit("")),
    )
    return d.orderBy(*keys).limit(room).select("column", "kind", caption.alias("caption"))


RANGE_PIECE = 1 << 16


def _marked(findings: DataFrame, runs: DataFrame | None, cap: int | None = None) -> DataFrame:
    """Rows of all findings.  Findings show the first ranges of a glitch only; `runs` has all of them."""
    spans = findings.select(F.explode("rows").alias("r")).select("r.start", "r.end")
    if runs is not None:
        named = findings.filter("kind = 'glitch'").select("column")
        short = runs.filter(F.col("count") <= GLITCH_ROWS).join(named, "column", "left_semi")
        spans = spans.unionByName(short.select("start", "end"))
    if cap:
        spans = spans.withColumn("end", F.least("end", F.col("start") + (cap - 1)))
    # a long range is cut in pieces before it is expanded, so that no row holds it as an array
    pieces = spans.select("end", F.explode(F.sequence("start", "end", F.lit(RANGE_PIECE).cast("long"))).alias("at"))
    ranges = pieces.select(F.explode(F.sequence("at", F.least("end", F.col("at") + (RANGE_PIECE - 1)))).alias(ROW))
    single = findings.select(F.explode(F.array_compact(F.array("row", "onset_row", "first_gap_row"))).alias(ROW))
    return ranges.unionByName(single).distinct()


def flagged_rows(findings: DataFrame, runs: DataFrame | None) -> DataFrame:
    """Distinct rows named by any finding, ranges expanded; `runs` are the outlier runs (None: no channel was checked for them)."""
    return _marked(findings, runs)


def flagged_columns(findings: DataFrame) -> DataFrame:
    names = F.array_compact(F.concat(F.array("column"), F.coalesce("affected", F.array().cast("array<string>"))))
    return findings.select(F.explode(names).alias("column")).distinct()


def written(rows: Ordered | None, o: Ordered, names: Sequence[str | None]) -> Ordered:
    """`rows`, some columns of `o` that were written with their index, where they hold all that is named."""
    return rows if rows is not None and all(n in rows.df.columns for n in names) else o


def first_flagged(
    o: Ordered, findings: DataFrame, runs: DataFrame | None, shown: int = FLAGGED_SHOWN, rows: Ordered | None = None
) -> DataFrame:
    """The first 50 flagged rows with up to 8 flagged columns (6 numeric ones when none is named).

    A range can only contribute its first 50 rows, so long ones are not expanded.  `rows` may have columns of `o`
    that are written already (see `qc.check`).
    """
    names = [r.column for r in flagged_columns(findings).orderBy("column").limit(len(o.df.columns)).collect()]
    names = [c for c in names if c in o.df.columns][:FLAGGED_COLUMNS]
    if not names:
        names = [f.name for f in o.df.schema if isinstance(f.dataType, T.NumericType) and f.name != ROW][:6]
    top = _marked(findings, runs, shown).orderBy(ROW).limit(shown)
    return written(rows, o, names).df.select(ROW, *names).join(F.broadcast(top), ROW, "left_semi").orderBy(ROW)


def qc_report(
    o: Ordered, channels: Sequence[str], time_col: str | None = None, lineage=None, max_plots: int = 6
) -> dict[str, DataFrame]:
    """The report's tables: summary, findings, severity counts, verdict, plots, flagged rows.

    One check serves all of them; rows and plots of its channels are read from what it has written.
    """
    checked = qc.check(o, channels, time_col, lineage)
    found = checked.findings
    x, ys, layout = overview_columns(o.df.drop(ROW), channels)
    summary = stats.dataset_summary(o.df.drop(ROW), time_col)
    keys = ["rank", "phase", "position", "part", "at"]
    return {
        "summary": summary,
        "findings": found.withColumn("location", location()).orderBy(*keys).select(*FINDING_COLUMNS, "location"),
        "severity_counts": severity_counts(found),
        "verdict": verdict(found),
        "overview": plot_series(written(checked.rows, o, [x, *ys]), x, ys, layout=layout),
        "plots": focused_plots(found, x, channels, max_plots),
        "flagged": first_flagged(o, found, checked.runs, rows=checked.rows),
    }


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    for name, t in tables.items():
        t.write.mode("errorifexists").parquet(f"{path}/{name}")
