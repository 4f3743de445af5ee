"""Sharding by weighted rendezvous hashing of a stable record key.

Every (key, shard) pair has its own hash u in (0, 1); a record goes to the shard with the largest
ln(u) / weight.  A pair's hash depends on nothing else, so one more shard takes records only into itself, and
a shard holds a share of the records in proportion to its weight.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import id_text, numbered, staged_with_uid, whole_text

HEX_DIGITS = 13


def pair_hash(key: Column, shard: int) -> Column:
    """A number in (0, 1) from 52 bits of the md5 of key and shard."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f"#{shard}"))), 1, HEX_DIGITS)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**HEX_DIGITS)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key among len(weights) shards; equal scores go to the later shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("shards need positive weights")
    scores = [F.struct((F.log(pair_hash(key, i)) / float(w)).alias("s"), F.lit(i).alias("i")) for i, w in enumerate(weights)]
    return F.array_max(F.array(*scores))["i"]


def assign_shards(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text", grown_weight: float = 1.0) -> DataFrame:
    """Returns the key, `size` (UTF-8 bytes plus 1), `text_crc32`, `law`, `shard`, `slot` (gapless from 0 within the
    shard) and `grown_shard` (with one more shard).

    Only these narrow columns are written, once, before the slots are numbered.  A null key hashes as an
    empty text, so its rows share a shard; a null text has size 1 and crc 0.  Repeated rows get slots of
    their own.  An empty table gives no rows.  Other columns are ignored.
    """
    k = id_text(key)
    slim = docs.select(
        key,
        (F.octet_length(whole_text(text)) + 1).cast("long").alias("size"),
        F.crc32(whole_text(text)).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(k, weights).alias("shard"),
        rendezvous(k, [*weights, grown_weight]).alias("grown_shard"),
    )
    return numbered(staged_with_uid(slim), "shard", "slot").drop("_uid")
