"""Licence places and shards recomputed in plain Python, with very long texts."""

import hashlib
import math
import random
import re

import pytest

from strandline.llm import licenses, sharding

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, score double, h long, template int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    bits = ["GNU General Public License", "gnu general", "public license", "Apache License", "apache", "CC-BY", "cc by-nc", "MIT License", "mit", "license", "é", "x1", "\n", ";", "gnu general public", "ımit", "(mit)license"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(120)]
    texts += [None, "", "...", " ".join(f"w{i}" for i in range(150_000)) + " mit license", texts[3], texts[3]]
    return [*enumerate(texts), (None, "mit license"), (None, None), (2, texts[2])]


def brute(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")))
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_places_match_plain_search(spark, rows):
    df = spark.createDataFrame([(i, t, 0.5, 1, 2) for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(df).collect()), key=str)
    assert got == sorted(((i, *brute(t)) for i, t in rows), key=str)
    for r in licenses.scan(df).collect():
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(filter(None, r.labels.split(",")))))


def shard_of(key, weights):
    scores = []
    for i, w in enumerate(weights):
        u = (int(hashlib.md5(f"{key}#{i}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
        scores.append((math.log(u) / w, i))
    return max(scores)[1]


@pytest.mark.parametrize("weights", [[1.0] * 8, [1.0, 2.5, 0.5]])
def test_shards_match_plain_hashing(spark, rows, weights):
    df = spark.createDataFrame([(i, t, 0.5, 1, 2) for i, t in rows], SCHEMA)
    for r in sharding.assign_shards(df, weights).collect():
        key = "" if r.doc_id is None else str(r.doc_id)
        assert (r.shard, r.grown_shard) == (shard_of(key, weights), shard_of(key, [*weights, 1.0]))
