"""Helpers shared by the operators: text identity, staged rows, gapless numbers, connected components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.plans.staging import stage

ROWS_PER_BUCKET = 250_000


def whole_text(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def text_key(name: str = "text") -> Column:
    """16 bytes that stand for the whole text; null and empty texts share one."""
    return F.unhex(F.md5(whole_text(name)))


def id_text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def positional(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with its columns named c0, c1, ..., and the new name of each, so that no column clashes with an operator's own."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def fold(name: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id counts as an empty text."""
    return F.crc32(id_text(name)) % parts


def staged_with_uid(df: DataFrame, uid: str = "_uid") -> DataFrame:
    """Written once to the shared folder with a row id, so that the id stays the same for every later reader."""
    return stage(df.withColumn(uid, F.monotonically_increasing_id()))


def numbered(df: DataFrame, group: str, out: str, uid: str = "_uid") -> DataFrame:
    """Adds gapless numbers from 0 within each group, in buckets of the row id, so that no task holds a group.

    `df` must be staged with a unique `uid`, and `group` must have few values by its meaning (shards,
    lengths up to a capacity): their counts come to the driver and decide the buckets of each.  The
    numbers of a bucket start after the rows of the group's earlier buckets.
    """
    spark = df.sparkSession
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).collect()
    target = min(ROWS_PER_BUCKET, max(64, sum(r["_n"] for r in sizes) // 1024))
    plan = spark.createDataFrame([(r[0], -(-r[1] // target)) for r in sizes], f"`{group}` {df.schema[group].dataType.simpleString()}, _buckets int")
    dealt = df.join(F.broadcast(plan), group)
    dealt = dealt.withColumn("_bucket", F.pmod(F.xxhash64(uid), F.col("_buckets")).cast("int")).drop("_buckets")
    keys = [group, "_bucket"]
    counts = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = dealt.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(uid)) - 1)
    return rows.join(offsets, keys).withColumn(out, (F.col("_i") + F.col("_before")).cast("long")).drop("_i", "_before", "_bucket")


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over the edges, for every node that has one.

    Alternates large-star and small-star rounds (Kiveris et al. 2014) until nothing changes.  Each round is
    two aggregations with map-side partial minima and two joins that adaptive execution may split, so a node
    with very many neighbours needs no task of its own.  Each round is written to the shared folder.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e, state = _kept(e)
    for _ in range(max_rounds):
        # large-star: the larger neighbours of a node point to the smallest of its neighbourhood
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small-star: a node and its smaller neighbours point to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s"))
        e, now = _kept(small.select("s.u", "s.v").filter("u <> v").distinct())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _kept(e: DataFrame) -> tuple[DataFrame, tuple]:
    e = stage(e)
    r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % (1 << 40)).alias("h")).collect()[0]
    return e, (r.n, r.h)
