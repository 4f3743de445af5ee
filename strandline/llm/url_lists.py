"""URL filters as a temporal join with dated lists.

A list entry says that a pattern was put on or taken off a list at some time.  Entries become validity
intervals, and every capture is evaluated against the intervals that hold at its fetch time.  Patterns are
domains (with all subdomains) and prefixes (a host and whole path segments).  A URL has few patterns
that could match it, so the search is an equality join on the pattern; intervals are cut at slices of time, and
the slice is part of the join key, so that a pattern with a long history or very many captures is spread over its slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import positional
from strandline.plans.staging import stage

SLICE = 90


def host(url: Column) -> Column:
    """Lower-case host without user, port and final dot; empty if there is none."""
    authority = F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    return F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.?(:[0-9]*)?\s*$", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def candidates(url: Column) -> Column:
    """(kind, pattern) of every domain and prefix entry that would match the URL."""
    h = host(url)
    labels = F.split(h, r"\.")
    last = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, last), ".").alias("pattern")))
    segments = F.filter(F.split(path(url), "/"), lambda s: s != "")
    many = F.sequence(F.lit(0), F.size(segments))
    prefixes = F.transform(many, lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat_ws("/", F.array(h), F.slice(segments, 1, i)).alias("pattern")))
    return F.when(h != "", F.concat(domains, prefixes))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, pattern, since, until) from entries (list, kind, pattern, action, at); `until` is null while open.

    Actions are add and remove.  Of entries at the same time an add wins; repeated adds and removes change nothing, and so
    does a remove before any add.  Rows with a null in any of the columns are no entries.
    """
    keys = ["list", "kind", "pattern"]
    known = entries.select(*keys, "action", "at").dropna().filter(F.col("action").isin("add", "remove"))
    states = known.groupBy(*keys, "at").agg(F.max((F.col("action") == "add").cast("int")).alias("on"))
    order = Window.partitionBy(*keys).orderBy("at")
    changes = states.withColumn("was", F.coalesce(F.lag("on").over(order), F.lit(0))).filter("on <> was")
    spans = changes.withColumn("until", F.lead("at").over(order)).filter("on = 1")
    return spans.select(*keys, F.col("at").alias("since"), "until")


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched_at", width: int = SLICE) -> DataFrame:
    """The captures, whole and with all their columns, with `lists` (sorted names of lists that the URL was on at its
    fetch time) and `n_entries` (active entries that match it).

    Times are whole numbers, of days for instance; an entry holds from its time on, up to but not
    including the next remove.  A null or hostless URL or a null time matches nothing.  Equal captures are
    evaluated once and each keeps its row.  Empty tables on either side give no matches.  Captures may have columns
    of any names but `lists` and `n_entries`, which are replaced.
    """
    captures = captures.drop("lists", "n_entries")
    columns = captures.columns
    captures, name = positional(captures)
    url, at = name[url], name[at]
    probe = F.xxhash64(F.coalesce(F.col(url), F.lit("")))
    asked = captures.select(F.col(url).alias("_url"), F.col(at).cast("long").alias("_at")).dropna().distinct()
    asked = asked.select("_url", "_at", F.floor(F.col("_at") / width).alias("_slice"), F.explode(candidates(F.col("_url"))).alias("c"))
    asked = asked.select("_url", "_at", "_slice", "c.kind", "c.pattern")
    ends = captures.agg(F.min(F.col(at).cast("long")).alias("_low"), F.max(F.col(at).cast("long")).alias("_high"))
    spans = intervals(entries).select("list", "kind", "pattern", F.col("since").cast("long"), F.col("until").cast("long"))
    spans = spans.crossJoin(F.broadcast(ends))  # one row: no slice beyond the captures' times is needed
    lo, hi = F.greatest("since", "_low"), F.least(F.coalesce(F.col("until") - 1, F.col("_high")), F.col("_high"))
    spans = spans.filter(lo <= hi).withColumn("_slice", F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width))))
    spans = stage(spans.select("list", "kind", "pattern", "since", "until", "_slice"))
    met = asked.join(spans, ["kind", "pattern", "_slice"]).filter((F.col("since") <= F.col("_at")) & (F.col("until").isNull() | (F.col("_at") < F.col("until"))))
    verdict = met.groupBy("_url", "_at").agg(F.array_sort(F.collect_set("list")).alias("_lists"), F.count(F.lit(1)).alias("_n"))
    verdict = stage(verdict.withColumn("_probe", F.xxhash64("_url")))
    named = captures.withColumn("_probe", probe)
    same = (named["_probe"] == verdict["_probe"]) & (named[url] == verdict["_url"]) & (named[at].cast("long") == verdict["_at"])
    out = named.join(verdict, same, "left").select(*[named[c] for c in named.columns if c != "_probe"], "_lists", "_n")
    out = out.withColumn("lists", F.coalesce("_lists", F.array().cast("array<string>"))).withColumn("n_entries", F.coalesce("_n", F.lit(0))).drop("_lists", "_n")
    return out.toDF(*columns, "lists", "n_entries")
