"""URL lists, vectors, components and the pipeline."""

import math
import random

import numpy as np
import pytest

import corpus_pipeline
from strandline.llm import embeddings, url_lists
from strandline.llm.common import components


def test_intervals_from_dated_entries(spark):
    e = [("a", "domain", "x.org", "add", 5), ("a", "domain", "x.org", "add", 7), ("a", "domain", "x.org", "remove", 9), ("a", "domain", "x.org", "remove", 11),
         ("a", "domain", "x.org", "add", 20), ("a", "domain", "x.org", "remove", 20), ("b", "prefix", "x.org/p", "remove", 1), ("b", "prefix", "x.org/p", None, 3), (None, "domain", "y", "add", 1)]
    df = spark.createDataFrame(e, "list string, kind string, pattern string, action string, at long")
    got = sorted(tuple(r) for r in url_lists.intervals(df).collect())
    assert got == [("a", "domain", "x.org", 5, 9), ("a", "domain", "x.org", 20, None)]


def test_captures_are_judged_at_their_time(spark):
    entries = spark.createDataFrame(
        [("ads", "domain", "x.org", "add", 100), ("ads", "domain", "x.org", "remove", 400), ("spam", "prefix", "y.org/a", "add", -10), ("spam", "domain", "x.org", "add", 350)],
        "list string, kind string, pattern string, action string, at long",
    )
    rows = [(1, "https://www.X.org/a", 99), (2, "https://www.x.org:8080/a?u=1", 100), (3, "http://u@x.org.", 399), (4, "http://notx.org/", 200), (5, "http://y.org/a/b", 5),
            (6, "http://y.org/ab", 5), (7, None, 5), (8, "http://x.org", None), (9, "x.org/a", 200), (2, "https://www.x.org:8080/a?u=1", 100), (10, "", 1), (11, "http://x.org/" + "s/" * 500, 9999)]
    captures = spark.createDataFrame([(i, u, t, "k") for i, u, t in rows], "id long, url string, fetched_at long, _probe string")
    out = url_lists.evaluate(captures, entries)
    assert out.columns == ["id", "url", "fetched_at", "_probe", "lists", "n_entries"]
    got = sorted((r.id, ",".join(r.lists), r.n_entries) for r in out.collect())
    want = {2: ("ads", 1), 3: ("ads,spam", 2), 5: ("spam", 1), 11: ("spam", 1)}
    assert got == sorted((i, *want.get(i, ("", 0))) for i, _, _ in rows)
    assert url_lists.evaluate(captures, entries.limit(0)).filter("n_entries > 0").count() == 0
    assert url_lists.evaluate(captures.limit(0), entries).count() == 0


def test_components_match_union_find(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (7, 2000), (2000, 7)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [1024, 16])
def test_vectors_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(40, 16))
    x = np.concatenate([c + rng.normal(scale=0.08, size=(int(k), 16)) for c, k in zip(centers, rng.integers(1, 12, 40), strict=True)])
    x = np.concatenate([x, x[:30], x[:5] * 3.0]).tolist()
    odd = [None, [], [0.0] * 16, [math.nan] * 16, [None] + [1.0] * 15, [math.inf] + [0.0] * 15, [1.0, 2.0], [1e-200] * 16, [1e200] * 16]
    rows = [(i, v, 0, "z") for i, v in enumerate([*x, *odd])] + [(3, x[3], 0, "z")]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, hash string"), leaf=60).collect()
    ok = [(r[0], np.array(r[1]) / max(abs(e) for e in r[1])) for r in rows if r[0] < len(x) or r[0] >= len(x) + 7]
    ids, m = [i for i, _ in ok], np.stack([v / np.linalg.norm(v) for _, v in ok])
    s = m @ m.T >= 0.95
    parent = list(range(len(ids)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in zip(*np.nonzero(s), strict=True):
        r, t = root(a), root(b)
        parent[max(r, t, key=lambda k: ids[k])] = min(r, t, key=lambda k: ids[k])
    true = int(s.sum()) - len(ids)
    assert len(got) == len(rows)
    assert 0.9 * true <= sum(r.n_links for r in got) <= true
    best = {}
    for k, i in enumerate(ids):
        best[i] = min(ids[q] for q in range(len(ids)) if root(q) == root(k))
    assert np.mean([r.component_id == best.get(r.vec_id, r.vec_id) for r in got]) > 0.9
    assert all(r.n_links == 0 and r.kept for r in got if len(x) <= r.vec_id < len(x) + 7)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


@pytest.mark.parametrize("mean", [0.975, 0.962])
def test_a_hot_third_of_distinct_near_copies_keeps_its_links(mean):
    rng = np.random.default_rng(6)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    n = 100_000
    hot = unit(unit(rng.normal(size=(1, 64))) + math.sqrt(1 / mean - 1) * unit(rng.normal(size=(n // 3, 64))))
    x = np.concatenate([hot, unit(rng.normal(size=(n - len(hot), 64)))])
    forest = embeddings.grow(x[rng.choice(n, 5000, replace=False)], n)
    some = hot[:1000]
    leaves = [set() for _ in some]
    for i, *leaf in zip(*(c.tolist() for c in forest.leaves(some)), strict=True):
        leaves[i].add(tuple(leaf))
    a, b = np.nonzero(np.triu(some @ some.T >= 0.95, 1))
    assert np.mean([not leaves[p].isdisjoint(leaves[q]) for p, q in zip(a.tolist(), b.tolist(), strict=True)]) > 0.99


def test_a_hot_group_counts_every_link_once(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 100)
    rng = np.random.default_rng(7)
    hot = rng.normal(size=32) + rng.normal(scale=0.16, size=(600, 32))
    x = np.concatenate([hot, rng.normal(size=(600, 32))])
    got = embeddings.near_duplicates(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>"), leaf=60).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    links = np.array([r.n_links for r in sorted(got)])
    assert want.sum() > 100_000
    assert (links <= want).all() and links.sum() >= 0.999 * want.sum()


def test_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert embeddings.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in embeddings.near_duplicates(spark.createDataFrame([(4, None)], schema)).collect()] == [(4, 0, 4, True)]


def test_stages_in_order_with_the_columns_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "best_fit_packing"]
    before = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf)
        assert after.columns == docs.columns
        before = spark.createDataFrame(after.collect(), docs.schema)
    ids = {r.doc_id for r in before.collect()}
    assert ids and ids < {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()} == ids


def test_stages_on_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_vectors_of_every_length_link_among_their_own(spark):
    rng = np.random.default_rng(6)
    base = [rng.normal(size=n) for n in (2, 3, 3, 5)]
    rows = [(i, (b * s).tolist()) for i, (b, s) in enumerate([(base[0], 1), (base[1], 1), (base[2], 1), (base[3], 1), (base[0], 2), (base[1], 3), (base[3], 0.5), (base[3], 7)])]
    rows += [(8, []), (9, None), (10, [0.0, 0.0]), (11, (-base[0]).tolist()), (None, None)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = {0: (1, 0), 1: (1, 1), 2: (0, 2), 3: (2, 3), 4: (1, 0), 5: (1, 1), 6: (2, 3), 7: (2, 3), None: (0, None)} | {i: (0, i) for i in (8, 9, 10, 11)}
    cos = abs(float(base[1] @ base[2]) / np.linalg.norm(base[1]) / np.linalg.norm(base[2]))
    assert cos < 0.95
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
    assert len(got) == len(rows) and all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def test_forest_is_as_large_as_its_nodes():
    x = np.random.default_rng(2).normal(size=(4000, 16))
    forest = embeddings.grow(x, 10**9, trees=2)
    assert sum(len(nodes) for levels in forest.thresholds for nodes, _ in levels) <= 2 * len(x)
    who, tree, leaf = forest.leaves(x[:50], spill=0.0)
    assert len(who) == 100 and leaf.min() >= 1
