"""Conversation repair against plain search over all edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from strandline.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string, cost long, block long, present string"
SPACE = re.compile("[\x20\x09-\x0d]+")
AFTER = {"": "u", "s": "u", "u": "a", "a": "u"}


def damage(rows):
    out = []
    for c, t, role, text in rows:
        r = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if r == 1 else re.sub("[.!?]", "", text) if r == 2 else text
        role = "user" if r == 4 else role
        out += [] if r == 0 else [(c, t, role, text)] * (2 if r == 3 else 1)
    return out


def judge(rows):
    """One conversation's expected report and digest."""
    same = lambda r: hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), same(r)))
    turns = {r[1] for r in rows if r[1] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    faults, seen = [], set()
    for _, _, role, text in rows:
        bare = SPACE.sub("", text)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))

    @lru_cache(None)
    def best(i, state, room):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if room:
            to = AFTER[state]
            found.append(_then(3, "I", ({"u": "user:", "a": "assistant:"}[to],), best(i, to, room - 1)))
        if i < len(rows):
            _, _, role, text = rows[i]
            found.append(_then(4, "D", (), best(i + 1, state, 3)))
            if faults[i] not in ("blank", "duplicate"):
                more, to = 3 * (faults[i] == "truncated"), AFTER[state]
                if initials[i] == to or (state == "" and initials[i] == "s"):
                    found.append(_then(more, "K", (f"{role}:{text}",), best(i + 1, initials[i], 3)))
                found.append(_then(3 + more, "R", ({"u": "user:", "a": "assistant:"}[to] + text,), best(i + 1, to, 3)))
        found = [f for f in found if f]
        return min(found) if found else None

    cost, audit, lines = best(0, "", 3)
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def _then(cost, letter, lines, rest):
    return rest and (cost + rest[0], letter + rest[1], lines + rest[2])


def ours(df, **sizes):
    fixed = cv.repair(cv.damaged(df), present=F.col("present"), **sizes)
    out = fixed.report.join(cv.digests(fixed.rows), "ck", "left").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)))
    return sorted(map(tuple, out.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    say = lambda: rng.choice(["Hello.", "why?", "cut off", "", " \t", "ünd!", "Hi there. ", "so it is.\n\x0b", "x" * 2000 + "."])
    out = []
    for c in range(150):
        for t in range(rng.randrange(1, 12)):
            role = ("user", "assistant")[t % 2] if rng.random() < 0.7 else rng.choice(["system", "user", "assistant", "tool", "User", None, "", "unknown"])
            out.append((c, t if rng.random() < 0.9 else rng.choice([None, 40, t + 3]), role, say() if rng.random() < 0.95 else None))
    out += [(500, t, ("user", "assistant")[t % 2] if t % 7 else "system", f"part {t}" + rng.choice([".", "?", ""])) for t in range(90)]
    out += [(501, 3, "user", "same.")] * 30 + [(502, None, None, None), (503, 0, "assistant", "Only this."), (504, -5, "system", "Rules.")]
    out += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Yes?"), (None, None, "user", "Hi.")] + out[:5]
    return out


@pytest.mark.parametrize("block,fan", [(1024, 1024), (4, 3), (7, 2)])
def test_repairs_match_plain_search(spark, rows, block, fan):
    df = spark.createDataFrame([(*r, 7, 7, "x") for r in rows], SCHEMA)
    by = {r[0]: [] for r in rows}
    for r in damage(rows):
        by[r[0]].append(r)
    want = sorted(((c, *judge(tuple(v))) for c, v in by.items()), key=str)
    assert ours(df, block=block, fan=fan) == want


def test_nothing_to_repair(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert ours(df) == []
    gone = next(t for t in range(1000) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(9, gone, "user", "Hi.", 1, 1, "x")], SCHEMA)
    assert ours(df) == [(9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
