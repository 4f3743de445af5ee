"""Data-quality queries on the event stream with faults planted by row number."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import qc
from strandline.operators.stats import named
from strandline.plans import report
from strandline.queries.registry import EV, ROW, events, query, rounded, um

CHANNELS = ["value", "flat", "zeros", "stuck", "spiky", "holes", "raw_a", "calibrated_a", "late"]

# channel: (Spark expression text over value, row_idx and n; the same as SQL)
PLANTED = {
    "value": "value",
    "flat": "CAST(5 AS DOUBLE)",
    "zeros": "CASE WHEN row_idx % 50 = 0 THEN value ELSE CAST(0 AS DOUBLE) END",
    "stuck": "CASE WHEN row_idx >= floor(n / 4) AND row_idx < floor(n / 4) + floor(n / 10) THEN CAST(1.5 AS DOUBLE) ELSE value END",
    "spiky": "CASE WHEN row_idx % 997 IN (5, 7) OR (row_idx >= floor(n / 3) AND row_idx < floor(n / 3) + 20) THEN CAST(1000000 AS DOUBLE) ELSE value END",
    "holes": "CASE WHEN row_idx % 10 <> 3 THEN value END",
    "raw_a": "value / 100 + CASE WHEN row_idx > n * 0.52 THEN 50 ELSE 0 END",
    "calibrated_a": "value / 140 + CASE WHEN row_idx > n * 0.52 + 3 THEN 35 ELSE 0 END",
    "late": "value / 100 - CASE WHEN row_idx > n * 0.81 THEN 40 ELSE 0 END",
}

FAULTY = f"{EV}, q AS (SELECT event_id, ts, x, row_idx, n, " + ", ".join(f"({sql})::double AS {c}" for c, sql in PLANTED.items()) + " FROM ev)"
LONG = FAULTY + ", long AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {i} AS position, row_idx, n, {c} AS v FROM q" for i, c in enumerate(CHANNELS)
) + ")"


def faulty(spark, d):
    o = events(spark, d)
    base = o.df.select("event_id", "ts", ROW, "value", F.lit(o.n).alias("n"))
    return o.with_df(base.selectExpr("ts", ROW, *[f"CAST({sql} AS DOUBLE) AS {c}" for c, sql in PLANTED.items()]))


# ---------------------------------------------------------------- detectors in SQL

GAPS = (
    ", dt AS (SELECT row_idx, x - lag(x) OVER (ORDER BY row_idx) AS dt FROM q), "
    f"dm AS (SELECT {um('dt', 'dt > 0')} AS m FROM dt), "
    "gaps AS (SELECT count(*) AS n_gaps, sum(dt - m) AS lost, min(row_idx) - 1 AS first_gap_row FROM dt, dm WHERE dt > 3 * m AND dt > m + 1e-6)"
)
RUNLEN = (
    ", fr AS (SELECT *, CASE WHEN row_idx > 0 AND v IS NOT DISTINCT FROM lag(v) OVER w THEN 0 ELSE 1 END AS f FROM long WINDOW w AS (PARTITION BY \"column\" ORDER BY row_idx)), "
    "ru AS (SELECT *, sum(f) OVER (PARTITION BY \"column\" ORDER BY row_idx) AS run FROM fr), "
    "rl AS (SELECT \"column\", max(c) AS longest_run FROM (SELECT \"column\", run, count(*) AS c FROM ru GROUP BY 1, 2) GROUP BY 1), "
    "cf AS (SELECT \"column\", any_value(position) AS position, count(*) AS n, count(v) AS n_finite, count(*) FILTER (v = 0) AS n_zero, "
    "count(v) = count(*) AND min(v) = max(v) AS constant, any_value(longest_run) AS longest_run FROM long JOIN rl USING (\"column\") GROUP BY 1)"
)
OUT = (
    f", md AS (SELECT \"column\", count(v) AS c, {um('v')} AS med FROM long GROUP BY 1), "
    f"dv AS (SELECT \"column\", abs(v - med) AS dv FROM long JOIN md USING (\"column\") WHERE v IS NOT NULL), "
    f"ma AS (SELECT \"column\", {um('dv')} AS mad FROM dv GROUP BY 1), "
    "ol AS (SELECT l.\"column\", position, row_idx FROM long l JOIN md USING (\"column\") JOIN ma USING (\"column\") "
    "WHERE c >= 20 AND mad > 0 AND v IS NOT NULL AND abs(v - med) / (1.4826 * mad) > 10), "
    "og AS (SELECT *, CASE WHEN row_idx - lag(row_idx) OVER w <= 3 THEN 0 ELSE 1 END AS f FROM ol WINDOW w AS (PARTITION BY \"column\" ORDER BY row_idx)), "
    "oi AS (SELECT *, sum(f) OVER (PARTITION BY \"column\" ORDER BY row_idx) AS run FROM og), "
    "rn AS (SELECT \"column\", position, min(row_idx) AS start, max(row_idx) AS \"end\", count(*) AS count FROM oi GROUP BY \"column\", position, run)"
)
CP = (
    ", k AS (SELECT any_value(n) AS n, least(greatest(any_value(n) // 200, 8), 40) AS k FROM q), "
    "sg AS (SELECT l.\"column\", position, floor(((row_idx + 1) * k - 1) / l.n)::bigint AS s, v FROM long l, k), "
    f"sm AS (SELECT \"column\", position, s, {um('v')} AS med FROM sg GROUP BY 1, 2, 3), "
    "sd AS (SELECT \"column\", s, abs(v - med) AS dv FROM sg JOIN sm USING (\"column\", s) WHERE v IS NOT NULL), "
    f"sa AS (SELECT \"column\", s, {um('dv')} AS mad FROM sd GROUP BY 1, 2), "
    f"ns AS (SELECT \"column\", greatest(({um('mad')}) * 1.4826, 1e-9) AS noise FROM sa GROUP BY 1), "
    "jm AS (SELECT \"column\", position, s, med, lag(med) OVER (PARTITION BY \"column\" ORDER BY s) AS m0 FROM sm), "
    "fj AS (SELECT \"column\", any_value(position) AS position, min(s) AS s, arg_min(m0, s) AS m0, arg_min(med, s) AS m1 FROM jm JOIN ns USING (\"column\") WHERE abs(med - m0) > 6 * noise GROUP BY 1), "
    "fw AS (SELECT fj.*, n, (s - 1) * n // k AS lo, (s + 1) * n // k AS hi, least(greatest(((s + 1) * n // k - (s - 1) * n // k) // 6, 5), 300) AS win FROM fj, k), "
    "tr AS (SELECT f.\"column\", a.row_idx, avg(b.v) AS m FROM fw f JOIN long a ON a.\"column\" = f.\"column\" AND a.row_idx >= lo AND a.row_idx < hi "
    "JOIN long b ON b.\"column\" = f.\"column\" AND b.row_idx <= a.row_idx AND b.row_idx >= greatest(a.row_idx - win, lo) GROUP BY 1, 2), "
    "cps AS (SELECT f.position, f.\"column\", coalesce(min(row_idx) FILTER (CASE WHEN m1 >= m0 THEN m >= (m0 + m1) * 0.5 ELSE m <= (m0 + m1) * 0.5 END), any_value((lo + hi) // 2)) AS onset, "
    "any_value(m1 - m0) AS shift FROM fw f LEFT JOIN tr USING (\"column\") GROUP BY 1, 2)"
)
CLUSTER = (
    ", cl AS (SELECT *, sum(f) OVER (ORDER BY onset, position) AS cluster FROM (SELECT *, CASE WHEN onset <= lag(onset) OVER (ORDER BY onset, position) + (SELECT greatest(n // 50, 20) FROM k) THEN 0 ELSE 1 END AS f FROM cps)), "
    "ce AS (SELECT cluster, min(onset) AS onset, count(*) AS members, list(\"column\" ORDER BY onset, position) AS affected, arg_min(shift, struct_pack(o := onset, p := position)) AS shift, "
    "list(\"column\" ORDER BY onset, position) FILTER (starts_with(\"column\", 'raw')) AS named FROM cl GROUP BY 1), "
    # the one raw channel at clusters without a named source
    f"sr AS (SELECT cluster, ce.onset, row_idx >= ce.onset AS after, v FROM ce, k, long WHERE named IS NULL AND \"column\" = 'raw_a' AND NOT list_contains(affected, 'raw_a') AND ce.onset > 0 AND ce.onset < k.n "
    "AND row_idx >= ce.onset - greatest(k.n // 50, 30) AND row_idx < ce.onset + greatest(k.n // 50, 30)), "
    f"s1 AS (SELECT cluster, after, {um('v')} AS med FROM sr GROUP BY 1, 2), "
    f"s2 AS (SELECT cluster, after, {um('dv')} AS mad FROM (SELECT cluster, after, abs(v - med) AS dv FROM sr JOIN s1 USING (cluster, after)) GROUP BY 1, 2), "
    "s3 AS (SELECT cluster, abs(max(med) - min(med)) / greatest(1.4826 * max(mad), 1e-9) AS ratio FROM s1 JOIN s2 USING (cluster, after) GROUP BY 1 HAVING count(*) = 2), "
    "ev2 AS (SELECT ce.*, coalesce(named, CASE WHEN ratio > 5 THEN ['raw_a'] END, []) AS culprit FROM ce LEFT JOIN s3 USING (cluster))"
)

FINDINGS = (
    ", fi AS (SELECT 'medium' AS severity, 'time_gaps' AS kind, 'ts' AS \"column\", NULL::bigint AS row, NULL::bigint AS range_start, NULL::bigint AS range_end, first_gap_row, NULL::bigint AS onset_row, NULL::varchar AS culprit, NULL::varchar AS affected, "
    "n_gaps || ' gap(s), ~' || round(lost)::bigint || 's of samples missing' AS detail FROM gaps WHERE n_gaps > 0 UNION ALL "
    "SELECT 'high', 'dead', \"column\", NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN constant THEN 'single distinct value (dead/constant)' ELSE round(100.0 * n_zero / n_finite)::bigint || '% zero' END FROM cf WHERE n_finite > 0 AND (constant OR n_zero / n_finite > 0.95) UNION ALL "
    "SELECT 'medium', 'frozen', \"column\", NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'stuck for ' || longest_run || ' consecutive rows' FROM cf WHERE NOT constant AND longest_run > greatest(n * 0.05, 30) UNION ALL "
    "SELECT 'medium', 'missing', \"column\", NULL, NULL, NULL, NULL, NULL, NULL, NULL, printf('%.1f', 100.0::double * (n - n_finite) / n) || '% missing (' || (n - n_finite) || ' rows)' FROM cf WHERE (n - n_finite) / n > 0.05 UNION ALL "
    "SELECT 'medium', 'outlier_regime', \"column\", NULL, start, \"end\", NULL, NULL, NULL, NULL, count || ' consecutive out-of-range samples (a regime, not a glitch)' FROM rn WHERE count > 4 UNION ALL "
    "SELECT 'high', 'glitch', \"column\", NULL, min(start), list_sort(list(\"end\"))[least(10, count(*))], NULL, NULL, NULL, NULL, sum(count)::bigint || ' isolated out-of-range sample(s)' FROM rn WHERE count <= 4 GROUP BY \"column\" UNION ALL "
    "SELECT 'medium', 'changepoint', affected[1], onset, NULL, NULL, NULL, NULL, NULL, NULL, 'median shifts ' || printf('%.4f', shift) || ' at ~row ' || onset FROM ev2 WHERE members = 1 AND len(list_filter(culprit, lambda c: NOT list_contains(affected, c))) = 0 UNION ALL "
    "SELECT CASE WHEN len(culprit) > 0 THEN 'high' ELSE 'medium' END, 'regime_change_event', NULL, NULL, NULL, NULL, NULL, onset, array_to_string(culprit, ','), array_to_string(affected, ','), "
    "CASE WHEN len(culprit) > 0 THEN 'level shift at ~row ' || onset || '; likely source: ' || array_to_string(culprit, ', ') || '; affects ' || members || ' channel(s)' "
    "ELSE 'coincident level shift across ' || members || ' channels at ~row ' || onset || ' (source unclear)' END FROM ev2 WHERE NOT (members = 1 AND len(list_filter(culprit, lambda c: NOT list_contains(affected, c))) = 0))"
)
ALL = LONG + GAPS + RUNLEN + OUT + CP + CLUSTER + FINDINGS


def _flat(found):
    return found.select(
        "severity", "kind", "column", "row", F.get("rows", F.lit(0))["start"].alias("range_start"),
        F.array_max(F.transform("rows", lambda r: r["end"])).alias("range_end"), "first_gap_row", "onset_row",
        F.array_join("culprit", ",").alias("culprit"), F.array_join("affected", ",").alias("affected"), "detail",
    )


@query("health_check", f"WITH {ALL} SELECT * FROM fi")
def health_check(spark, d):
    return _flat(qc.health_check(faulty(spark, d), CHANNELS, "ts"))


@query("time_gaps", f"WITH {FAULTY}{GAPS} SELECT n_gaps, round(lost, 3) AS lost, first_gap_row FROM gaps WHERE n_gaps > 0")
def time_gaps(spark, d):
    return rounded(qc.time_gaps(events(spark, d), "ts"), 3, "lost")


@query("channel_faults", f"WITH {LONG}{RUNLEN} SELECT \"column\", position, n, n_finite, n_zero, constant, longest_run FROM cf")
def channel_faults(spark, d):
    return qc.channel_facts(faulty(spark, d), CHANNELS)


@query("dead_channels", f"WITH {ALL} SELECT \"column\", detail FROM fi WHERE kind = 'dead'")
def dead_channels(spark, d):
    return qc.dead(qc.channel_facts(faulty(spark, d), CHANNELS)).select("column", "detail")


@query("frozen_and_missing_channels", f"WITH {ALL} SELECT kind, \"column\", detail FROM fi WHERE kind IN ('frozen', 'missing')")
def frozen_missing(spark, d):
    f = qc.channel_facts(faulty(spark, d), CHANNELS)
    return qc.frozen(f).unionByName(qc.missing(f)).select("kind", "column", "detail")


@query("robust_outliers", f"WITH {LONG}{OUT} SELECT \"column\", position, row_idx FROM ol")
def robust_outliers(spark, d):
    return qc.outliers(faulty(spark, d), CHANNELS)


@query("outlier_runs", f"WITH {LONG}{OUT} SELECT \"column\", position, start, \"end\", count FROM rn")
def outlier_runs(spark, d):
    return qc.outlier_runs(faulty(spark, d), CHANNELS)


@query("glitches_and_regimes", f"WITH {ALL} SELECT kind, \"column\", detail FROM fi WHERE kind IN ('glitch', 'outlier_regime')")
def glitches_regimes(spark, d):
    runs = qc.outlier_runs(faulty(spark, d), CHANNELS)
    return qc.glitches(runs).unionByName(qc.regimes(runs)).select("kind", "column", "detail")


@query(
    "segment_levels",
    f"WITH {LONG}{CP} SELECT \"column\", s AS segment, round(med, 6) AS median, round(mad, 6) AS mad FROM sm JOIN sa USING (\"column\", s)",
)
def segment_levels(spark, d):
    out, _ = qc.segment_levels(faulty(spark, d), CHANNELS)
    return rounded(named(out, CHANNELS), 6, "median", "mad").select("column", "segment", "median", "mad")


@query("changepoints", f"WITH {LONG}{CP} SELECT position, \"column\", onset, round(shift, 6) AS shift FROM cps")
def changepoints(spark, d):
    return rounded(qc.changepoints(faulty(spark, d), CHANNELS), 6, "shift")


@query("shift_events", f"WITH {LONG}{CP}{CLUSTER} SELECT onset, array_to_string(culprit, ',') AS culprit, array_to_string(affected, ',') AS affected FROM ev2")
def shift_events(spark, d):
    o = faulty(spark, d)
    e = qc.events(o, CHANNELS, qc.changepoints(o, CHANNELS))
    return e.select(
        F.coalesce("onset_row", "row").alias("onset"),
        F.array_join(F.coalesce("culprit", F.array()), ",").alias("culprit"),
        F.array_join(F.coalesce("affected", F.array("column")), ",").alias("affected"),
    )


@query(
    "lineage_events",
    f"WITH {LONG}{CP}{CLUSTER} SELECT onset, array_to_string(CASE WHEN list_contains(affected, 'late') THEN list_concat(culprit, ['holes', 'flat']) ELSE culprit END, ',') AS culprit FROM ev2 "
    "WHERE members > 1 OR list_contains(affected, 'late')",
)
def lineage_events(spark, d):
    o = faulty(spark, d)
    e = qc.events(o, CHANNELS, qc.changepoints(o, CHANNELS), {"late": ["holes", "2", "nowhere"]})
    return e.filter("kind = 'regime_change_event'").select(F.col("onset_row").alias("onset"), F.array_join("culprit", ",").alias("culprit"))


# ---------------------------------------------------------------- report tables


@query("severity_counts", f"WITH {ALL} SELECT severity, count(*) AS n FROM fi GROUP BY 1")
def severity_counts(spark, d):
    return report.severity_counts(qc.health_check(faulty(spark, d), CHANNELS, "ts", ordered=False))


@query(
    "verdict",
    f"WITH {ALL}, c AS (SELECT count(*) AS t, count(*) FILTER (severity = 'high') AS h, count(*) FILTER (severity = 'medium') AS m FROM fi) "
    "SELECT CASE WHEN h > 0 THEN 'high' ELSE 'medium' END AS verdict_class, t || ' findings: ' || h || ' High, ' || m || ' Medium' AS verdict_text FROM c",
)
def verdict(spark, d):
    return report.verdict(qc.health_check(faulty(spark, d), CHANNELS, "ts", ordered=False))


@query(
    "finding_locations",
    f"WITH {ALL}, g AS (SELECT \"column\", count(*) AS c, 'rows ' || string_agg(start || '–' || \"end\", ', ' ORDER BY start) FILTER (i <= 5) || CASE WHEN least(count(*), 10) > 5 THEN ' (+' || (least(count(*), 10) - 5) || ' more)' ELSE '' END AS t "
    "FROM (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY start) AS i FROM rn WHERE count <= 4) GROUP BY 1) "
    "SELECT kind, fi.\"column\", CASE WHEN row IS NOT NULL THEN 'row ' || row WHEN onset_row IS NOT NULL THEN 'onset row ' || onset_row WHEN first_gap_row IS NOT NULL THEN 'first gap at row ' || first_gap_row "
    "WHEN kind = 'glitch' THEN t WHEN range_start IS NOT NULL THEN 'rows ' || range_start || '–' || range_end END AS location FROM fi LEFT JOIN g ON g.\"column\" = fi.\"column\" AND kind = 'glitch'",
)
def finding_locations(spark, d):
    found = qc.health_check(faulty(spark, d), CHANNELS, "ts", ordered=False)
    return found.select("kind", "column", report.location().alias("location"))


FLAGGED = (
    ", fl AS (SELECT row AS row_idx FROM fi WHERE row IS NOT NULL UNION SELECT onset_row FROM fi WHERE onset_row IS NOT NULL UNION SELECT first_gap_row FROM fi WHERE first_gap_row IS NOT NULL "
    "UNION SELECT unnest(range(start, \"end\" + 1)) FROM rn)"
)


@query("flagged_rows", f"WITH {ALL}{FLAGGED} SELECT row_idx FROM fl")
def flagged_rows(spark, d):
    checked = qc.check(faulty(spark, d), CHANNELS, "ts")
    return report.flagged_rows(checked.findings, checked.runs)


@query("first_flagged", f"WITH {ALL}{FLAGGED} SELECT q.row_idx, calibrated_a, flat, holes, late, raw_a, spiky, stuck, ts FROM q JOIN (SELECT * FROM fl ORDER BY row_idx LIMIT 50) USING (row_idx)")
def first_flagged(spark, d):
    o = faulty(spark, d)
    checked = qc.check(o, CHANNELS, "ts")
    return report.first_flagged(o, checked.findings, checked.runs, rows=checked.rows)


PLACES = "[" + ", ".join(f"'{c}'" for c in CHANNELS) + "]"
PLOTS = (
    ", pa AS (SELECT kind, coalesce(\"column\", split_part(affected, ',', 1)) AS c, coalesce(row, onset_row, range_start) AS place, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS rk, "
    "CASE WHEN kind IN ('glitch', 'outlier_regime') THEN 1 ELSE 2 END AS ph, CASE kind WHEN 'outlier_regime' THEN 3 WHEN 'glitch' THEN 4 ELSE 0 END AS part "
    "FROM fi WHERE kind IN ('changepoint', 'regime_change_event', 'glitch', 'outlier_regime')), "
    f"pb AS (SELECT *, CASE WHEN ph = 1 THEN list_position({PLACES}, c) ELSE place END AS pos FROM pa), "
    "pc AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY rk, ph, pos, part, place) AS i FROM pb), "
    "pl AS (SELECT c AS \"column\", kind, kind || ' — ' || c || coalesce(' (row ~' || place || ')', '') AS caption FROM pc WHERE i = 1 ORDER BY rk, ph, pos, part, place LIMIT 5)"
)


@query("focused_plots", f"WITH {ALL}{PLOTS} SELECT * FROM pl")
def focused_plots(spark, d):
    found = qc.health_check(faulty(spark, d), CHANNELS, "ts", ordered=False)
    return report.focused_plots(found, "ts", CHANNELS)


@query(
    "report_overview",
    f"WITH {LONG}, fin AS (SELECT \"column\", position, row_idx, x, v, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY \"column\") AS m "
    "FROM long JOIN (SELECT row_idx, x FROM q) USING (row_idx) WHERE v IS NOT NULL WINDOW w AS (PARTITION BY \"column\" ORDER BY row_idx)), "
    "bk AS (SELECT *, floor(((i + 1) * 900 - 1) / m)::bigint AS b FROM fin WHERE m > 3600), "
    "ex AS (SELECT \"column\", list_distinct([arg_min(i, struct_pack(v := v, r := i)), arg_max(i, struct_pack(v := v, r := -i))]) AS l FROM bk GROUP BY \"column\", b), "
    "pk AS (SELECT \"column\", unnest(l) AS i FROM ex) "
    "SELECT position AS panel, \"column\" AS series, i AS row_idx, x, round(v, 9) AS y FROM pk JOIN fin USING (\"column\", i) UNION ALL "
    "SELECT position, \"column\", row_idx, x, round(v, 9) FROM fin WHERE m <= 3600",
)
def report_overview(spark, d):
    o = faulty(spark, d)
    x, ys, layout = report.overview_columns(o.df.drop(ROW), CHANNELS)
    return rounded(report.plot_series(o, x, ys, layout=layout), 9, "y")


@query(
    "qc_report",
    f"WITH {ALL}{FLAGGED}{PLOTS}, c AS (SELECT count(*) AS t, count(*) FILTER (severity = 'high') AS h, count(*) FILTER (severity = 'medium') AS m FROM fi) "
    "SELECT 'severity' AS part, severity AS item, count(*)::varchar AS value FROM fi GROUP BY 2 UNION ALL "
    "SELECT 'verdict', CASE WHEN h > 0 THEN 'high' ELSE 'medium' END, t || ' findings: ' || h || ' High, ' || m || ' Medium' FROM c UNION ALL "
    "SELECT 'finding', kind || ' ' || coalesce(\"column\", affected), detail FROM fi UNION ALL "
    "SELECT 'plot', \"column\", caption FROM pl UNION ALL "
    "SELECT 'flagged', row_idx::varchar, '' FROM (SELECT * FROM fl ORDER BY row_idx LIMIT 50)",
)
def qc_report(spark, d):
    """The report's tables under one another."""
    t = report.qc_report(faulty(spark, d), CHANNELS, "ts")
    named_ = F.coalesce("column", F.array_join("affected", ","))
    parts = [
        t["severity_counts"].select(F.lit("severity").alias("part"), F.col("severity").alias("item"), F.col("n").cast("string").alias("value")),
        t["verdict"].select(F.lit("verdict"), "verdict_class", "verdict_text"),
        t["findings"].select(F.lit("finding"), F.concat("kind", F.lit(" "), named_), "detail"),
        t["plots"].select(F.lit("plot"), "column", "caption"),
        t["flagged"].select(F.lit("flagged"), F.col(ROW).cast("string"), F.lit("")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
