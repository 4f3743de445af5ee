"""The registered queries opN_<name>: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import conversations, decontam, embeddings, langid, language_model, licenses, negatives, packing, sharding, simhash, suffix_dedup, toxicity, url_lists
from strandline.llm.common import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_byte_language")
def op1(spark, d):
    docs = table(spark, d, "documents").withColumn("held_out", fold("doc_id", 3) == 1)
    net = langid.fit(docs.filter(~F.col("held_out")))
    return langid.identify(docs, net, ["doc_id", "held_out"])


# The tables have no fetch times and no lists; both follow by rule from the pages' ids and hosts.
HOSTS = (
    "p AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host, "
    "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, (page_id * 37) % 1461 AS fetched_at FROM pages), "
    "d AS (SELECT DISTINCT 'ads' AS list, 'domain' AS kind, host AS pattern FROM p UNION SELECT DISTINCT 'malware', 'domain', regexp_replace(host, '^[^.]*\\.', '') FROM p "
    "UNION SELECT DISTINCT 'spam', 'prefix', host || '/' || split_part(path, '/', 2) FROM p WHERE split_part(path, '/', 2) <> ''), "
    "k AS (SELECT *, ('0x' || substr(md5(pattern), 1, 6))::INT AS h FROM d WHERE pattern <> '')"
)
URL_SQL = (
    f"WITH {HOSTS}, i AS (SELECT list, kind, pattern, h % 700 AS since, h % 700 + 150 AS until FROM k WHERE list = 'ads' AND h % 3 = 0 "
    "UNION ALL SELECT list, kind, pattern, h % 700 + 300, NULL FROM k WHERE list = 'ads' AND h % 3 = 0 "
    "UNION ALL SELECT list, kind, pattern, h % 900, h % 900 + 400 FROM k WHERE list = 'malware' AND h % 5 = 0 "
    "UNION ALL SELECT list, kind, pattern, h % 1000, NULL FROM k WHERE list = 'spam' AND h % 4 = 0), "
    "m AS (SELECT page_id, list FROM p JOIN i ON since <= fetched_at AND (until IS NULL OR fetched_at < until) AND CASE kind WHEN 'domain' "
    "THEN host = pattern OR ends_with(host, '.' || pattern) ELSE host || path = pattern OR starts_with(host || path, pattern || '/') END) "
    "SELECT p.page_id, fetched_at, coalesce((SELECT string_agg(DISTINCT list, ',' ORDER BY list) FROM m WHERE m.page_id = p.page_id), '') AS lists, "
    "(SELECT count(*) FROM m WHERE m.page_id = p.page_id) AS n_entries FROM p"
)


def dated_entries(captures: DataFrame) -> DataFrame:
    h, first = url_lists.host(F.col("url")), F.element_at(F.split(url_lists.path(F.col("url")), "/"), 2)
    kinds = [("ads", "domain", h), ("malware", "domain", F.regexp_replace(h, r"^[^.]*\.", "")), ("spam", "prefix", F.when(first != "", F.concat(h, F.lit("/"), first)))]
    keys = F.explode(F.array(*[F.struct(F.lit(a).alias("list"), F.lit(b).alias("kind"), c.alias("pattern")) for a, b, c in kinds])).alias("k")
    k = captures.select(keys).select("k.*").filter("pattern <> ''").distinct()
    k = k.withColumn("h", F.conv(F.substring(F.md5("pattern"), 1, 6), 16, 10).cast("int"))
    # an add repeated while its entry holds, and a remove without an add, change nothing
    rules = [("ads", 3, 700, "add", 0), ("ads", 3, 700, "add", 40), ("ads", 3, 700, "remove", 150), ("ads", 3, 700, "remove", 200), ("ads", 3, 700, "add", 300),
             ("malware", 5, 900, "add", 0), ("malware", 5, 900, "remove", 400), ("spam", 4, 1000, "remove", -5), ("spam", 4, 1000, "add", 0)]
    when = lambda name, part, span, action, after: F.when((F.col("list") == name) & (F.col("h") % part == 0), F.struct(F.lit(action).alias("action"), (F.col("h") % span + after).cast("long").alias("at")))
    events = F.explode(F.array_compact(F.array(*[when(*r) for r in rules]))).alias("e")
    return k.select("list", "kind", "pattern", events).select("list", "kind", "pattern", "e.action", "e.at")


@query("op2_dated_url_lists", URL_SQL)
def op2(spark, d):
    captures = table(spark, d, "pages").select("page_id", "url", ((F.col("page_id") * 37) % 1461).alias("fetched_at"))
    out = url_lists.evaluate(captures, dated_entries(captures))
    return out.select("page_id", "fetched_at", F.array_join("lists", ",").alias("lists"), "n_entries")


@query("op3_radix_repeats")
def op3(spark, d):
    return suffix_dedup.remove_repeats(table(spark, d, "documents"), counted=50)


@query("op4_qgram_decontamination")
def op4(spark, d):
    bench = decontam.load_benchmark(table(spark, d, "benchmark"))
    return decontam.contaminated(table(spark, d, "documents"), bench)


@query("op5_weak_toxicity")
def op5(spark, d):
    docs = table(spark, d, "documents").withColumn("held_out", fold("doc_id", 5) == 0)
    model, _ = toxicity.fit(docs, table(spark, d, "labels"), fold("doc_id", 5) != 0)
    return toxicity.score(docs, model, ["doc_id", "held_out"])


@query("op6_license_votes")
def op6(spark, d):
    return licenses.scan(table(spark, d, "documents"))


SHARDS = 8


@query("op7_rendezvous_shards")
def op7(spark, d):
    out = sharding.assign_shards(table(spark, d, "documents"), [1.0] * SHARDS)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query("op8_simhash_multi_index")
def op8(spark, d):
    return simhash.near_duplicates(table(spark, d, "documents")).select("doc_id", "fingerprint", "component_id")


@query("op9_matched_packing")
def op9(spark, d):
    return packing.pack(table(spark, d, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"))


@query("op10_projection_forest")
def op10(spark, d):
    return embeddings.near_duplicates(table(spark, d, "embeddings"))


@query("op11_deleted_interpolation")
def op11(spark, d):
    return language_model.score(table(spark, d, "documents"), fold("doc_id", 5) != 1)


NEGATIVES_SQL = (
    "WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, "
    "list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL "
    "AND list_count(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)), "
    "s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score "
    "FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0), "
    "p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same "
    "QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5) "
    "SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank, "
    "other_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same "
    "AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score "
    "QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) <= 3"
)


@query("op12_subset_sum_negatives", NEGATIVES_SQL)
def op12(spark, d):
    i = F.col("vec_id")
    label = F.when(i % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return negatives.mine(table(spark, d, "embeddings"), i % 50 == 0, label=label)


@query("op13_prefix_doubled_repair")
def op13(spark, d):
    fixed = conversations.repair(conversations.damaged(table(spark, d, "conversations")), present=F.col("present"))
    out = fixed.report.join(conversations.digests(fixed.rows), "ck", "left")
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
