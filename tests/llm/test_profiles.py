"""One document of each group of near copies, by several fingerprints and whole texts."""

import random

import numpy as np
import pytest

from strandline.llm import profiles

SCHEMA = "doc_id long, text string, fp long, node long, _t string"


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    base = [" ".join(word() for _ in range(rng.randint(150, 500))) for _ in range(60)]
    out = list(enumerate(base))
    for i, t in enumerate(base[:40]):
        w = t.split()
        for j in rng.sample(range(len(w)), len(w) // 100 + (1 if i % 2 else 0)):
            w[j] = word()
        out.append((1000 + i, " ".join(w)))
    out += [(2000 + i, " ".join([*base[i].split()[: len(base[i].split()) // 2], *(word() for _ in range(150))])) for i in range(40, 60)]  # half alike
    out += [(3000, None), (3001, ""), (3002, " \n"), (3003, "one two"), (3004, "one two"), (3005, "One two"), (3006, "x " * 60_000), (3007, "x " * 60_000 + "y")]
    return [*out, out[3], out[3], (None, base[5]), (None, None)]


def test_near_copies_go_and_others_stay(spark, rows):
    df = spark.createDataFrame([(i, t, 1, 2, "c") for i, t in rows], SCHEMA).repartition(3)
    out = profiles.one_of_each_profile(df)
    assert out.columns == df.columns
    kept = {(r.doc_id, r.text) for r in out.collect()}
    assert out.count() == len(kept)
    ids = {i for i, _ in kept}
    text = dict(rows)
    # every text that goes is like one that goes or stays; unlike texts all stay
    gone = [i for i, _ in rows if i not in ids and i is not None]
    assert all(any(j != i and len(shingles(t) & shingles(text[i])) >= 0.8 * len(shingles(t) | shingles(text[i])) for j, t in rows) for i in gone if i < 3006)
    assert all(2000 + i in ids and i in ids for i in range(40, 60))
    assert sum(1000 + i in ids for i in range(40)) <= 14  # about a word in a hundred changed: J of 0.9 and more
    # the last two differ in one of 60,000 shingles: equal in all fingerprints, though not as sets
    assert len({3003, 3004, 3005} & ids) == 1 and len({3006, 3007} & ids) == 1
    assert len([r for r in kept if not (r[1] or "").split()]) == 1
    assert profiles.one_of_each_profile(df.limit(0)).count() == 0


def test_jaccard_is_of_sets_of_whole_texts():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (" ".join(rng.choice(list("abc"), rng.integers(0, 12))) for _ in range(2))
        x, y = shingles(a), shingles(b)
        assert profiles.jaccard(a, b, 5) == pytest.approx(len(x & y) / len(x | y) if x | y else 1.0)
