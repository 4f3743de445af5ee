"""Text operators against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from public_tokenizers import path as tokenizer_path
from pyspark.sql import functions as F

from strandline.llm import decontam, langid, licenses, packing, queries, sharding, simhash, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, fp long, _text string, _tkey string, score double, n_chars long"
BASE = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "x", "y", 0.5, 3) for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    long = " ".join(word() for _ in range(3000))
    texts = [None, "", " ", "é", BASE, BASE, BASE + " end", BASE.upper(), long, long.replace(" a", " b", 40), "the " * 200, "the " * 150 + BASE]
    texts += ["licensed under the MIT License", "cc by", "x cc by-nc cc by", "ünï cöde " * 30, long[4000:6000] + " " + BASE]
    out = [(i, t, "en") for i, t in enumerate(texts)]
    return [*out, out[4], (None, BASE, None), (None, None, None)]


def test_sharding_law_slots_and_sizes(spark, rows):
    got = sharding.assign_shards(table(spark, rows), [1.0] * 8).collect()
    assert len(got) == len(rows)
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert all(r.grown_shard in (r.shard, 8) for r in got)
    want = sorted((-1 if i is None else i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert sharding.assign_shards(table(spark, []), [1.0, 2.0]).count() == 0


def test_rendezvous_follows_weights(spark):
    got = spark.range(20000).select(sharding.rendezvous(F.col("id").cast("string"), [1.0, 3.0]).alias("s")).groupBy("s").count().collect()
    share = {r.s: r["count"] / 20000 for r in got}
    assert abs(share[1] - 0.75) < 0.02


def brute_repeats(texts, t):
    bodies = [(x or "").encode() for x in texts]
    count = {}
    for b in bodies:
        for i in range(len(b) - t + 1):
            count[b[i : i + t]] = count.get(b[i : i + t], 0) + 1
    out = []
    for b in bodies:
        cover = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - t + 1):
            if count[b[i : i + t]] > 1:
                cover[i : i + t] = True
        kept = np.frombuffer(b, dtype=np.uint8)[~cover].tobytes()
        out.append((len(b), int(cover.sum()), int((np.diff(np.concatenate(([0], cover.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("threshold,radices", [(50, (4, 8)), (30, (2, 2, 4))])
def test_repeats_match_brute_force(spark, rows, threshold, radices):
    got = suffix_dedup.remove_repeats(table(spark, rows), ["doc_id"], threshold, radices).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    want = [(i, *b) for (i, _, _), b in zip(rows, brute_repeats([t for _, t, _ in rows], threshold), strict=True)]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_repeats_of_random_small_alphabets(spark):
    rng = random.Random(9)
    texts = []
    for _ in range(60):
        parts = [rng.choice(["ab" * 20, "abc" * 15, "x" * 50, "".join(rng.choice("ab") for _ in range(40))]) for _ in range(4)]
        texts.append("".join(parts)[: rng.randint(0, 160)])
    got = suffix_dedup.remove_repeats(table(spark, [(i, t, None) for i, t in enumerate(texts)]), ["doc_id"], 24, (2, 4)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute_repeats(texts, 24)


def test_without_repeats_keeps_columns_and_nulls(spark, rows):
    docs = table(spark, rows)
    got = suffix_dedup.without_repeats(docs, 50, (4, 8), size="n_chars")
    assert got.columns == docs.columns and got.count() == len(rows)
    by = {r.doc_id: r for r in got.filter("doc_id is not null").collect()}
    assert by[0].text is None and by[1].text == "" and by[4].text == ""
    assert by[3].text == "é" and by[3].n_chars == 1 and by[3].fp == 1
    assert suffix_dedup.without_repeats(table(spark, [])).count() == 0


def test_repeats_of_fifty_words_go_however_short(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    passage = " ".join(word() for _ in range(55))
    short = " ".join(word() for _ in range(49))
    assert len(passage) < 400
    own = [" ".join(word() for _ in range(30)) for _ in range(6)]
    spaced = passage.replace(" ", "\n ")
    texts = [f"{own[0]} é {passage} {own[1]}", f"{own[2]} {spaced} {own[3]}", f"{own[4]} {short} {own[5]}", f"{own[5]} {short} {own[4]}", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = dict(suffix_dedup.without_repeats(docs, words=50).collect())
    assert got == {0: f"{own[0]} é  {own[1]}", 1: f"{own[2]}  {own[3]}", 2: texts[2], 3: texts[3], 4: None}


def brute_word_repeats(texts, words):
    bodies = [(x or "").encode().split() for x in texts]
    count = {}
    for b in bodies:
        for i in range(len(b) - words + 1):
            count[tuple(b[i : i + words])] = count.get(tuple(b[i : i + words]), 0) + 1
    out = []
    for b in bodies:
        cover = np.zeros(len(b), dtype=int)
        for i in range(len(b) - words + 1):
            if count[tuple(b[i : i + words])] > 1:
                cover[i : i + words] = 1
        out.append((int(cover.sum()), int((np.diff(np.concatenate(([0], cover))) == 1).sum())))
    return out


@pytest.mark.parametrize("words,radices", [(50, (4, 8)), (12, (2, 4)), (6, (2, 2))])
def test_counted_words_match_brute_force(spark, rows, words, radices):
    rng = random.Random(words)
    few = [" ".join(rng.choice(["a", "bb", "c\n"]) for _ in range(rng.randint(0, 3 * words))) for _ in range(40)]
    more = [*rows, *((100 + i, t, None) for i, t in enumerate(few))]
    got = suffix_dedup.remove_repeats(table(spark, more), counted=words, word_radices=radices).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    texts = [t for _, t, _ in more]
    want = [(i, *b, *w) for (i, _, _), b, w in zip(more, brute_repeats(texts, 400), brute_word_repeats(texts, words), strict=True)]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_query_tells_of_passages_over_fifty_words(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    passage = " ".join(word() for _ in range(55))
    assert len(passage) < 400
    own = [" ".join(word() for _ in range(120)) for _ in range(4)]
    texts = [f"{own[0]} {passage} {own[1]}", f"{passage} {own[2]}", own[3], None, "few words"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op3_radix_repeats"](spark, str(tmp_path)).orderBy("doc_id")
    assert got.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert [tuple(r)[1:5] for r in got.collect()] == brute_repeats(texts, 400)
    assert [(r.n_words_repeated, r.n_word_spans) for r in got.collect()] == [(55, 1), (55, 1), (0, 0), (0, 0), (0, 0)]


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_matches_brute_force(spark, rows):
    got = simhash.near_duplicates(table(spark, rows)).collect()
    assert len(got) == len(rows)
    have = sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint) for r in got)
    assert have == sorted((-1 if i is None else i, f"{brute_fingerprint(t):016x}") for i, t, _ in rows)


@pytest.mark.parametrize("hot", [200, 3])
def test_links_connect_what_brute_force_connects(spark, hot):
    rng = np.random.default_rng(2)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = [s ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for s in seeds for k in (0, 1, 2, 3, 3, 5)]
    center = np.uint64(1 << 40)  # many fingerprints share a half
    flips += [center ^ np.uint64(1 << b) for b in range(30)] + [center ^ np.uint64((1 << b) | (1 << (b + 2))) for b in range(20)]
    fps = np.unique(np.array([*flips, 0, 2**64 - 1], dtype=np.uint64)).astype(np.int64)
    pairs = simhash.links(spark.createDataFrame([(int(f),) for f in fps], "fp long"), hot=hot).collect()
    assert all(bin((p.a ^ p.b) & (2**64 - 1)).count("1") <= 3 for p in pairs)

    def groups(edges):
        parent = {int(f): int(f) for f in fps}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            parent[root(int(a))] = root(int(b))
        return {frozenset(x for x in parent if root(x) == r) for r in {root(x) for x in parent}}

    true = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if np.bitwise_count(np.uint64(a) ^ np.uint64(b)) <= 3]
    assert groups([(p.a, p.b) for p in pairs]) == groups(true)


def test_one_of_each_keeps_one_row_of_a_group(spark, rows):
    docs = table(spark, rows)
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    found = [(r.doc_id, r.text) for r in got.collect()]
    assert len(found) == len(set(found))
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(brute_fingerprint(t), []).append(i)
    assert len(found) <= len(groups) and (None, BASE) in found and (8, dict((i, t) for i, t, _ in rows)[8]) in found
    assert simhash.one_of_each(table(spark, [])).count() == 0


def test_decontamination_finds_edited_items_and_leaves_the_rest(spark):
    item = "What is the airspeed velocity of an unladen swallow, and does it carry a coconut by the husk over the sea?"
    edited = item.replace("airspeed", "air speed").replace("coconut", "cocanut")
    far = item.replace("e", "o").replace("a", "i")
    docs = table(spark, [(1, "so: " + item.upper() + " yes", None), (2, "x\n" + edited, None), (3, far, None), (4, None, None), (5, "", None), (6, "the sea " * 300, None), (2, "x\n" + edited, None)])
    items = spark.createDataFrame([(10, item), (11, None), (12, ""), (None, "zzq"), (13, "zq")], "item_id long, text string")
    bench = decontam.load_benchmark(items)
    got = sorted((r.doc_id, r.item_id, r.edits) for r in decontam.contaminated(docs, bench).collect())
    assert got == [(1, 10, 0), (2, 10, 2), (2, 10, 2)]
    assert sorted(r.doc_id for r in decontam.clean(docs, bench).collect()) == [3, 4, 5, 6]
    assert decontam.contaminated(docs, decontam.load_benchmark(items.limit(0))).count() == 0


@pytest.mark.parametrize("most_bytes", [8 << 20, 60])
def test_decontamination_with_ids_of_any_kind(spark, most_bytes):
    text = {"a'1": "the quick brown fox jumps over the lazy dog and runs away", "b": "seventeen grey geese fly south over the frozen lake", None: "an item that has no id at all but a text of its own"}
    items = spark.createDataFrame([(k, t) for k, t in text.items()] + [("e", ""), (None, None)], "item_id string, text string")
    long = "filler words " * 100_000
    rows = [(i, t) for i, t in enumerate(text.values())] + [(3, long + text["b"] + long), (4, long), (5, text["b"] + " x " + text["a'1"])]
    docs = spark.createDataFrame([(i, t, 0.5, 7) for i, t in rows], "doc_id long, text string, item_id double, edits int")
    bench = decontam.load_benchmark(items, most_bytes=most_bytes)
    assert (len(bench) > 1) == (most_bytes == 60)
    found = decontam.contaminated(docs, bench, ["doc_id", "item_id", "edits"])
    assert found.columns == ["doc_id", "doc_item_id", "doc_edits", "item_id", "match_start", "match_end", "edits"]
    assert sorted(((r.doc_id, r.item_id) for r in found.collect()), key=str) == [(0, "a'1"), (1, "b"), (2, None), (3, "b"), (5, "a'1"), (5, "b")]
    assert [r.doc_id for r in decontam.clean(docs, bench).collect()] == [4]


def brute_edits(p, t):
    prev = [0] * (len(t) + 1)
    for i in range(1, len(p) + 1):
        cur = [i]
        for j in range(1, len(t) + 1):
            cur.append(min(prev[j - 1] + (p[i - 1] != t[j - 1]), prev[j] + 1, cur[j - 1] + 1))
        prev = cur
    return min(prev)


def test_alignment_matches_brute_force():
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    hits = 0
    for _ in range(150):
        p = letters(rng.randint(5, 50)).strip() or "a"
        q = list(p)
        for _ in range(rng.randint(0, 4)):
            j = rng.randrange(len(q))
            q[j] = rng.choice(["", rng.choice("abcdefgh"), q[j] + "z"])
        bench = decontam.Benchmark.of([0], [p], q=3, rate=0.15)
        text = letters(rng.randint(0, 30)) + "".join(q) + letters(rng.randint(0, 30))
        least, found = brute_edits(bench.texts[0], decontam.normal(text)), bench.matches(text)
        assert bool(found) == (least <= bench.edits[0])
        if found:
            hits += 1
            assert min(f[3] for f in found) == least
    assert hits > 50


def test_license_places_and_labels(spark, rows):
    got = {r.doc_id: r for r in licenses.scan(table(spark, [r for r in rows if r[0] is not None])).collect()}
    assert (got[12].n_base, got[12].first_word, got[12].base_labels, got[12].labels) == (1, 3, "mit", "mit")
    assert (got[14].n_base, got[14].first_word, got[14].last_word) == (2, 1, 4)
    assert (got[0].n_words, got[0].n_base, got[0].first_word, got[0].labels, got[0].score) == (0, 0, None, "", 0.0)
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    assert all(got[i].n_words == len(word.findall((t or "").lower())) for i, t, _ in rows if i is not None)
    notice = "Redistribution and use in source and in binary forms, with or without modification, are permitted provided that these following conditions are met."
    extra = licenses.scan(table(spark, [(1, notice, None), (2, "Licensed under CC BY-NC 4.0.", None), (2, "Licensed under CC BY-NC 4.0.", None), (3, "Kelvin cc by", None)])).collect()
    assert [r.labels for r in sorted(extra, key=lambda r: r.doc_id)][:3] == ["bsd-text", "cc-by,cc-by-nc-4.0", "cc-by,cc-by-nc-4.0"]
    assert licenses.scan(table(spark, [])).count() == 0


def test_packing_round_trip(spark, rows):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    some = [r for r in rows if r[0] is not None][:17] + [(99, "a <|endoftext|> b", None)]
    got = packing.pack(table(spark, some), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"), capacity=64).toPandas()
    for i, t, _ in some:
        ids = np.array([*full.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        own = got[got.doc_id == i].sort_values("piece")
        assert own.length.sum() == len(ids) and own.piece.tolist() == list(range(len(own))) and (own.length.iloc[1:] == 64).all()
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s.offset.to_numpy() == np.concatenate(([0], s.length.cumsum().to_numpy()[:-1]))).all() and s.length.sum() <= 64
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 64) + 1
    assert packing.pack(table(spark, []), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken")).count() == 0


def test_plan_places_every_piece_once():
    rng = random.Random(1)
    for _ in range(30):
        cap = rng.choice([10, 30, 100])
        hist = {rng.randint(1, cap - 1): rng.randint(1, 50) for _ in range(rng.randint(0, 20))}
        plan = packing.plan_sequences(dict(hist), cap)
        used = {}
        for contents, n in plan:
            assert sum(size * k for size, k in contents) <= cap
            assert sum(k for size, k in contents if 3 * size > cap) <= 2
            for size, k in contents:
                used[size] = used.get(size, 0) + n * k
        assert used == hist


def test_language_of_windows_and_the_unknown(spark):
    words = {"xx": "lorem ipsum dolor sit amet", "yy": "schnell übung größe weiß straße"}
    rng = random.Random(4)
    body = lambda lang: " ".join(rng.choice(words[lang].split()) for _ in range(rng.randint(3, 200)))
    docs = table(spark, [(i, body(("xx", "yy")[i % 2]), ("xx", "yy")[i % 2]) for i in range(200)])
    net = langid.fit(docs, epochs=8)
    extra = table(spark, [(900, None, None), (901, "12 34 !!", None), (902, "", None), (903, body("yy"), None), (903, body("yy") * 50, None), (904, "weiß", None)])
    got = langid.identify(docs.union(extra), net, ["doc_id", "lang"]).collect()
    known = [r for r in got if r.lang]
    assert np.mean([r.lang == r.lang_pred for r in known]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (900, 901, 902)} == {"und"}
    assert {r.lang_pred for r in got if r.doc_id == 903} == {"yy"}
    assert langid.fit(docs.limit(0)) is None
    assert {r.lang_pred for r in langid.identify(extra, None).collect()} == {"und"}


def test_fast_maxima_agree_with_plain_ones():
    rng = np.random.default_rng(0)
    win = rng.integers(0, 256, (20, 64), dtype=np.uint8)
    net = langid.train(win, ["a", "b"] * 10, epochs=1, widths=(2, 3, 4, 5))
    assert np.allclose(net.fast_maxima(win), net.maxima(win)[0], atol=1e-4)


def test_toxicity_learns_words_and_word_parts(spark):
    rng = random.Random(6)
    filler = ["lorem", "ipsum", "dolor", "amet", "sed", "magna", "aliqua", "tempor"]

    def text(toxic):
        w = [rng.choice(filler) for _ in range(rng.randint(5, 60))]
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["zorgish", "zorgle", "zorgam"])
        return " ".join(w)

    docs = [(i, text(i % 4 == 0), None) for i in range(1200)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(900)] + [(5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    frame = table(spark, [*docs, (5000, None, None), (5001, "", None), (3, docs[3][1], None)])
    model, voters = toxicity.fit(frame, labels, F.lit(True))
    got = {r.doc_id: r for r in toxicity.score(frame, model).collect()}
    held = [(int(i % 4 == 0), got[i].predicted) for i, _, _ in docs[900:]]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values()) and got[5000].predicted == 0
    assert voters.correlations.shape[0] == len(voters.weights)
    kept = toxicity.reject(frame, model)
    assert kept.columns == frame.columns and 280 < 1203 - kept.count() < 320
    nothing, _ = toxicity.fit(frame, labels.limit(0), F.lit(True))
    assert toxicity.reject(frame, nothing).count() == 1203


def test_fixed_voters_speak():
    assert sum(toxicity.votes("You are a pathetic loser!!")) >= 4 and sum(toxicity.votes("a calm text")) == 0
