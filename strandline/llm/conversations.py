"""Repair of conversation structure: the cheapest edits, and among those the least audit text.

A repaired conversation has the role initials `(s?(ua)+)?`.  Rows are kept (free), given the role that the
pattern wants (3), or deleted (4; blank and duplicate rows must be); empty user or assistant rows may be inserted
anywhere (3); a truncated row that stays costs 3 more.  The pattern is an automaton of four states, so a row is a
4 x 4 matrix of costs and a run of rows a product of such matrices in the (min, +) algebra.

A cost pass gives every node (place, state) its cheapest cost to the end.  The arcs that reach it are the optimal
ones; each arc is ranked by its letter, then by audits of 2, 4, 8, ... letters, joining its rank with the rank of the
arc as far ahead as the rank looks, and doubling that pointer.  Different arcs of a node have different letters,
so the arc ahead is always one, and the lowest rank at the entry picks the least path, which the doubled
pointers then list.

A conversation is cut into blocks of rows, so no task holds a long one: blocks of long conversations first give
their matrices, a scan over blocks, in levels of bounded fan-out, gives the cost behind each block, then the
state that enters it.  Only the digest of a conversation's whole text, a sequential hash by its definition,
walks through a conversation in one task, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.plans.blocks import over_blocks
from strandline.plans.layout import ROW
from strandline.plans.ordering import join_sized, order_rows
from strandline.plans.staging import stage

WHITE = " \t\n\x0b\x0c\r"
BLOCK = 1024
FAN = 1024
RATES = {"rerole": 3, "delete": 4, "insert": 3, "truncated": 3}

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
INITIALS = "sua"  # codes 1, 2, 3, the states they lead to; 0 for any other
NEXT = np.array([USER, USER, ASSISTANT, USER])  # the row that the pattern takes next
LEGAL = np.zeros((STATES, 4), dtype=bool)  # by state and initial
for _state, _code in ((START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)):
    LEGAL[_state, _code] = True
ROLE = np.array([None, None, "user", "assistant"], dtype=object)
LETTERS = np.array(list("DIKR"))
DELETE, INSERT, KEEP, REROLE = range(4)
INF = 1 << 60


@dataclass(frozen=True)
class Repaired:
    """`report`: a row for each conversation; `rows`: the repaired rows, ordered by (block, seq) within `ck`."""

    report: DataFrame
    rows: DataFrame


def conversation_key(conv: Column) -> Column:
    """A text that stands for the id, the null id included."""
    return F.when(conv.isNull(), F.lit("")).otherwise(F.concat(F.lit("c"), conv.cast("string")))


# ---------------------------------------------------------------- one block


class Units:
    """Blocks of rows side by side, longest first: costs to the end, optimal arcs and least paths."""

    def __init__(self, sizes: np.ndarray, must: np.ndarray, late: np.ndarray, code: np.ndarray, last: np.ndarray, tail: np.ndarray):
        """`tail` (units, states, variants): the cost behind each block for every state; `last` blocks end the text."""
        self.sizes, self.units = sizes, len(sizes)
        self.first = np.cumsum(sizes + 1) - (sizes + 1)  # node place of each unit
        places = int((sizes + 1).sum())
        self.row = np.zeros(places, dtype=np.int64)  # the row consumed at each place, -1 at the end of a unit
        self.row[:] = -1
        inner = np.ones(places, dtype=bool)
        inner[self.first + sizes] = False
        self.row[inner] = np.arange(len(must))
        self.must, self.late, self.code, self.last, self.tail = must, late, code, last, tail
        self.cost = np.full((places, STATES, tail.shape[2]), INF, dtype=np.int64)
        self._solve()

    def _closed(self, base: np.ndarray) -> np.ndarray:
        """With rows inserted at the place: user before assistant and the other way round, then the two openings."""
        out = base.copy()
        out[:, USER] = np.minimum(base[:, USER], base[:, ASSISTANT] + RATES["insert"])
        out[:, ASSISTANT] = np.minimum(base[:, ASSISTANT], base[:, USER] + RATES["insert"])
        for s in (START, SYSTEM):
            out[:, s] = np.minimum(base[:, s], out[:, USER] + RATES["insert"])
        return np.minimum(out, INF)

    def _row_arcs(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(delete, keep, rerole) costs by state at places that consume a row."""
        r, after = self.row[at], self.cost[at + 1]
        stay = np.where(self.must[r], INF, RATES["truncated"] * self.late[r])[:, None, None]
        legal = LEGAL[:, self.code[r]].T[:, :, None]
        keep = np.where(legal, stay + np.take_along_axis(after, self.code[r][:, None, None], 1), INF)
        return after + RATES["delete"], keep, stay + RATES["rerole"] + after[:, NEXT]

    def _solve(self) -> None:
        end = self.first + self.sizes
        self.cost[end] = np.where(self.last[:, None, None], self._closed(self.tail), self.tail)
        for back in range(1, int(self.sizes.max(initial=0)) + 1):
            at = end[: np.searchsorted(-self.sizes, -back, side="right")] - back
            self.cost[at] = self._closed(np.minimum.reduce(self._row_arcs(at)))

    def entry(self) -> np.ndarray:
        """(units, states, variants): the cost of each block and what follows it, by entering state."""
        return self.cost[self.first]

    def paths(self, entering: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The least optimal path of each unit from its entering state: (unit, letter, place) of every arc in order, and
        the state in which each unit ends as a fourth array."""
        places, cost = len(self.row), self.cost[:, :, 0]
        arc = np.full((places, STATES, 4), INF, dtype=np.int64)
        inner = np.flatnonzero(self.row >= 0)
        for letter, c in zip((DELETE, KEEP, REROLE), self._row_arcs(inner), strict=True):
            arc[inner, :, letter] = c[:, :, 0]
        open_end = np.ones(places, dtype=bool)
        open_end[(self.first + self.sizes)[~self.last]] = False
        arc[open_end, :, INSERT] = RATES["insert"] + cost[open_end][:, NEXT]
        optimal = (arc == cost[:, :, None]) & (cost < INF)[:, :, None]
        state = np.arange(STATES)
        head = np.zeros((places, STATES, 4), dtype=np.int64)
        here = np.arange(places)[:, None] * STATES
        after = np.minimum(here + STATES, (places - 1) * STATES)
        head[:, :, DELETE], head[:, :, INSERT], head[:, :, REROLE] = after + state, here + NEXT, after + NEXT
        head[inner, :, KEEP] = after[inner] + self.code[self.row[inner]][:, None]
        # optimal arcs become the nodes that are ranked; the one after the last stands for the end
        node = np.flatnonzero(optimal.any(axis=2))
        flags = optimal.reshape(-1, 4)
        least = np.full(places * STATES, -1)
        least[node] = flags[node].argmax(axis=1)
        arcs = np.flatnonzero(optimal.reshape(-1))
        index = np.full(places * STATES * 4 + 1, len(arcs))
        index[arcs] = np.arange(len(arcs))
        target = head.reshape(-1)[arcs]
        ahead = np.append(index[np.where(least[target] >= 0, target * 4 + least[target], -1)], len(arcs))
        rank = np.append(arcs % 4 + 1, 0)
        hops = [ahead]
        while (hops[-1][:-1] < len(arcs)).any():
            rank = np.unique(rank * (len(arcs) + 6) + rank[hops[-1]], return_inverse=True)[1]
            hops.append(hops[-1][hops[-1]])
        # the entering node's arc of the lowest rank, then the arcs that the doubled pointers give
        enter = (self.first * STATES + entering)[:, None] * 4 + np.arange(4)
        choice = np.where(flags[self.first * STATES + entering], rank[index[enter]], len(arcs) + 6).argmin(axis=1)
        any_arc = flags[self.first * STATES + entering].any(axis=1)
        path = np.where(any_arc, index[enter[np.arange(self.units), choice]], len(arcs))[:, None]
        for hop in hops:
            path = np.concatenate([path, hop[path]], axis=1)
        unit, step = np.nonzero(path < len(arcs))
        taken = arcs[path[unit, step]]
        final = entering.copy()
        final[unit] = head.reshape(-1)[taken] % STATES  # later steps overwrite earlier ones
        return unit, taken % 4, taken // (4 * STATES), final


def _units(rows: pd.DataFrame, sizes: np.ndarray, last: np.ndarray, tail: np.ndarray) -> Units:
    return Units(sizes, rows["must"].to_numpy(dtype=bool), rows["late"].to_numpy(dtype=np.int64), rows["code"].to_numpy(dtype=np.int64), last, tail)


FINISHED = np.array([0, INF, INF, 0], dtype=np.int64)


def _whole_units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows in frames that never cut a block."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        if held:
            pdf = pd.concat([held.pop(), pdf], ignore_index=True)
        tail = (pdf["ck"] == pdf["ck"].iloc[-1]) & (pdf["block"] == pdf["block"].iloc[-1])
        cut = len(pdf) - int(tail.sum())
        held = [pdf.iloc[cut:]]
        if cut:
            yield pdf.iloc[:cut]
    yield from held


def _classes(pdf: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Blocks of alike length together, longest first: their rows, sizes and first rows."""
    pdf = pdf.reset_index(drop=True)
    new = (pdf["ck"] != pdf["ck"].shift()) | (pdf["block"] != pdf["block"].shift())
    first = np.flatnonzero(new.to_numpy())
    sizes = np.diff(np.append(first, len(pdf)))
    kind = np.frexp(sizes)[1]
    for k in np.unique(kind):
        pick = np.flatnonzero(kind == k)
        pick = pick[np.argsort(-sizes[pick], kind="stable")]
        n = sizes[pick]
        rows = np.repeat(first[pick] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        yield pdf.iloc[rows].reset_index(drop=True), n, np.cumsum(n) - n


def _block_matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in _whole_units(batches):
        for rows, sizes, first in _classes(pdf):
            leaving = np.where(np.eye(STATES, dtype=bool), 0, INF)  # one variant for each leaving state
            u = _units(rows, sizes, np.zeros(len(sizes), dtype=bool), np.broadcast_to(leaving, (len(sizes), STATES, STATES)))
            yield pd.DataFrame({"ck": rows["ck"].iloc[first], "block": rows["block"].iloc[first], "m": list(u.entry().reshape(-1, STATES * STATES))})


def _block_maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each block a matrix that is 0 where the least path from a state leaves, transposed for the way forward."""
    for pdf in _whole_units(batches):
        for rows, sizes, first in _classes(pdf):
            u = _units(rows, sizes, rows["last"].to_numpy(dtype=bool)[first], np.stack(rows["tail"].iloc[first])[:, :, None])
            m = np.full((len(sizes), STATES, STATES), INF, dtype=np.int64)
            for s in range(STATES):
                final = u.paths(np.full(len(sizes), s))[3]
                m[np.arange(len(sizes)), final, s] = 0
            yield pd.DataFrame({"ck": rows["ck"].iloc[first], "block": rows["block"].iloc[first], "m": list(m.reshape(-1, STATES * STATES))})


def _block_edits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All edits of each block in order; its audit and cost ride on its first edit."""
    for pdf in _whole_units(batches):
        for rows, sizes, first in _classes(pdf):
            tail = np.stack(rows["tail"].iloc[first])[:, :, None]
            entering = rows["entering"].to_numpy(dtype=np.int64)[first]
            u = _units(rows, sizes, rows["last"].to_numpy(dtype=bool)[first], tail)
            unit, letter, place, _ = u.paths(entering)
            if not len(unit):
                continue
            row = u.row[place]
            used = letter != INSERT
            uid = rows["uid"].to_numpy()[np.where(used, row, 0)]
            # the state before each edit names the role of an inserted or changed row
            code = u.code[np.where(used, row, 0)]
            state = np.zeros(len(unit), dtype=np.int64)
            begins = np.flatnonzero(np.diff(unit, prepend=-1))
            now = entering.copy()
            seq = np.arange(len(unit)) - np.repeat(begins, np.diff(np.append(begins, len(unit))))
            for t in range(int(seq.max()) + 1):
                at = np.flatnonzero(seq == t) if t else begins
                state[at] = now[unit[at]]
                now[unit[at]] = np.where(letter[at] == DELETE, now[unit[at]], np.where(letter[at] == KEEP, code[at], NEXT[now[unit[at]]]))
            price = np.array([RATES["delete"], RATES["insert"], 0, RATES["rerole"]])[letter] + np.where((letter == KEEP) | (letter == REROLE), RATES["truncated"] * u.late[np.where(used, row, 0)], 0)
            text = LETTERS[letter]
            ends = np.append(begins[1:], len(unit))
            audit, cost = np.full(len(unit), None, dtype=object), np.zeros(len(unit), dtype=np.int64)
            audit[begins] = ["".join(text[a:b]) for a, b in zip(begins, ends, strict=True)]
            cost[begins] = np.add.reduceat(price, begins)
            changed = (letter == INSERT) | (letter == REROLE)
            yield pd.DataFrame(
                {
                    "ck": rows["ck"].to_numpy()[first][unit], "block": rows["block"].to_numpy()[first][unit], "seq": seq,
                    "uid": uid, "used": used, "letter": text,
                    "new_role": np.where(changed, ROLE[NEXT[state]], None), "audit": audit, "cost": cost,
                }
            )


# ---------------------------------------------------------------- blocks of long conversations


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), INF)


def _products(pdf: pd.DataFrame, fan: int) -> pd.DataFrame:
    """The product of up to `fan` neighbouring matrices."""
    out = None
    for m in pdf.sort_values("block")["m"]:
        m = np.asarray(m, dtype=np.int64).reshape(STATES, STATES)
        out = m if out is None else _product(out, m)
    return pd.DataFrame({"ck": [pdf["ck"].iloc[0]], "block": [pdf["block"].iloc[0] // fan], "m": [out.reshape(-1)]})


def _behind(pdf: pd.DataFrame) -> pd.DataFrame:
    """The vector behind each of up to `fan` matrices, given the one behind them all."""
    pdf = pdf.sort_values("block", ascending=False)
    v, out = np.asarray(pdf["v"].iloc[0], dtype=np.int64), []
    for m in pdf["m"]:
        out.append(v)
        v = np.minimum((np.asarray(m, dtype=np.int64).reshape(STATES, STATES) + v).min(axis=1), INF)
    return pd.DataFrame({"ck": pdf["ck"], "block": pdf["block"], "v": out})


def _scan(matrices: DataFrame, behind: np.ndarray, blocks: int, fan: int) -> DataFrame:
    """(ck, block, v): the product of all later matrices with the vector `behind` a conversation's last block.

    Levels of `fan` blocks: products of groups are scanned first, then each group from what lies behind it.
    """
    group = F.floor(F.col("block") / fan).cast("long")
    last = F.array(*[F.lit(int(x)) for x in behind]).cast("array<long>")
    if blocks <= fan:
        known = matrices.withColumn("v", last)
    else:
        tops = stage(matrices.groupBy("ck", group.alias("_g")).applyInPandas(lambda pdf: _products(pdf, fan), "ck string, block long, m array<long>"))
        up = _scan(tops, behind, -(-blocks // fan), fan).select("ck", F.col("block").alias("_g"), "v")
        known = matrices.withColumn("_g", group).join(up, ["ck", "_g"]).drop("_g")
    return stage(known.groupBy("ck", group.alias("_g")).applyInPandas(_behind, "ck string, block long, v array<long>"))


# ---------------------------------------------------------------- whole tables


def _sorted_units(rows: DataFrame) -> DataFrame:
    return rows.repartition("ck", "block").sortWithinPartitions("ck", "block", ROW)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None, block: int = BLOCK, fan: int = FAN) -> Repaired:
    """Repaired conversations, and per conversation id: gaps, blank, duplicate, truncated, illegal, cost, audit.

    Rows are taken by turn, nulls first; rows of one turn by role, then by a hash of role and text.  A row's first
    fault counts: blank, duplicate (role and text seen before), truncated (the last character that is no white
    space is none of `.!?`).  Null roles and texts count as one space, the null id is a conversation of its own.
    Rows where `present` is not true only lend their id: a conversation without other rows has zeros and an empty
    audit.  Each of repeated rows is a row.  An empty table gives no rows.  Other columns are ignored.
    """
    kept = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    s = rows.select(
        conversation_key(F.col(conv)).alias("ck"), F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"), kept.alias("present"),
    )
    s = stage(s.withColumn("uid", F.monotonically_increasing_id()))
    shown = F.col("present")
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    first = F.substring("role", 1, 1)
    narrow = s.filter(shown).select(
        "ck", "uid", F.col("turn").isNotNull().alias("has_turn"), F.coalesce("turn", F.lit(0)).alias("turn"), "role",
        F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")).alias("same"),
        (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("open_end"),
        F.coalesce(F.element_at(F.create_map(*[x for i, c in enumerate(INITIALS, 1) for x in (F.lit(c), F.lit(i))]), first), F.lit(0)).alias("code"),
    )
    o = order_rows(narrow, ["has_turn", "turn", "role", "same", "uid"], "ck")
    o = o.with_df(o.df.drop("has_turn", "turn"))
    placed = stage(over_blocks(o, 1, 0, lambda w: {"before": F.lag("code").over(w)}))
    # the first of equal rows is known by its place, so no join meets all of them in one key
    once = placed.groupBy("ck", "role", "same").agg(F.min(ROW).alias(ROW)).select("ck", ROW, F.lit(True).alias("new"))
    again = F.col("new").isNull()
    pair = [(a, b) for a in range(1, STATES) for b in range(1, STATES) if LEGAL[a, b] and a != START]
    fits = F.lit(False)
    for a, b in pair:
        fits = fits | ((F.col("before") == a) & (F.col("code") == b))
    judged = placed.join(once, ["ck", ROW], "left").select(
        "ck", ROW, "uid", "code", F.col("blank"), (~F.col("blank") & again).alias("duplicate"),
        (~F.col("blank") & ~again & F.col("open_end")).alias("late"), (F.col("before").isNotNull() & ~fits).alias("illegal"),
    )
    judged = stage(judged.withColumn("must", F.col("blank") | F.col("duplicate")).withColumn("block", F.floor(F.col(ROW) / block).cast("long")))
    faults = judged.groupBy("ck").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c)).alias(c) for c in ("blank", "duplicate", "late", "illegal")])
    faults = stage(faults)
    long = faults.filter(F.col("n") > block).select("ck", "n")
    longest = long.agg(F.max("n")).collect()[0][0]
    finished = F.array(*[F.lit(int(x)) for x in FINISHED]).cast("array<long>")
    plain = lambda d: d.withColumn("last", F.lit(True)).withColumn("tail", finished).withColumn("entering", F.lit(START))
    if longest is None:
        ready = plain(judged)
    else:
        sized = join_sized(judged, long, ["ck"])
        cut = sized.filter("n is not null").withColumn("last", F.col("block") == F.floor((F.col("n") - 1) / block)).drop("n")
        ready = plain(sized.filter("n is null").drop("n")).unionByName(_joined_blocks(cut, -(-longest // block), fan))
    edits = stage(_sorted_units(ready).mapInPandas(_block_edits, "ck string, block long, seq long, uid long, used boolean, letter string, new_role string, audit string, cost long"))
    pieces = F.sort_array(F.collect_list(F.when(F.col("audit").isNotNull(), F.struct("block", "audit"))))
    audits = edits.groupBy("ck").agg(F.sum("cost").alias("cost"), F.array_join(F.transform(pieces, lambda p: p["audit"]), "").alias("audit"))
    number = lambda c: c.cast("decimal(38,0)")
    seen = F.when(shown, F.col("turn"))
    span = number(F.max(seen)) - number(F.min(seen)) + 1 - F.count_distinct(seen)
    every = s.groupBy("ck").agg(F.first("conv").alias("conv"), F.coalesce(span.try_cast("long"), F.lit(0)).alias("gaps"))
    zero = lambda c, name: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(name)
    report = every.join(faults, "ck", "left").join(audits, "ck", "left").select(
        "ck", F.col("conv").alias("conv_id"), "gaps", zero("blank", "blank"), zero("duplicate", "duplicate"), zero("late", "truncated"),
        zero("illegal", "illegal"), zero("cost", "cost"), F.coalesce("audit", F.lit("")).alias("audit"),
    )
    stay = edits.filter("letter <> 'D'").select("ck", "block", "seq", "letter", "new_role", F.when(F.col("used"), F.col("uid")).alias("uid"))
    source = s.select("uid", "role", "text")
    held = stay.filter("uid is not null").join(source, "uid").select("ck", "block", "seq", "letter", F.coalesce("new_role", "role").alias("role"), "text")
    added = stay.filter("uid is null").select("ck", "block", "seq", "letter", F.col("new_role").alias("role"), F.lit("").alias("text"))
    return Repaired(report, held.unionByName(added))


def _joined_blocks(cut: DataFrame, blocks: int, fan: int) -> DataFrame:
    """Rows of long conversations with the cost behind their block and the state that enters it."""
    matrices = stage(_sorted_units(cut).mapInPandas(_block_matrices, "ck string, block long, m array<long>"))
    closed = Units(np.array([0]), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64), np.array([True]), FINISHED[None, :, None]).entry()[0, :, 0]
    behind = _scan(matrices, closed, blocks, fan)
    # a last block ends in the finished states and closes itself
    own_end = F.array(*[F.lit(int(x)) for x in FINISHED]).cast("array<long>")
    cut = cut.join(behind, ["ck", "block"]).withColumn("tail", F.when(F.col("last"), own_end).otherwise(F.col("v"))).drop("v")
    maps = stage(_sorted_units(cut).mapInPandas(_block_maps, "ck string, block long, m array<long>"))
    # forward is backward over reversed blocks and transposed matrices
    turned = maps.withColumn("block", F.lit(blocks - 1) - F.col("block"))
    start = np.where(np.arange(STATES) == START, 0, INF)
    enters = _scan(turned, start, blocks, fan).select("ck", (F.lit(blocks - 1) - F.col("block")).alias("block"), (F.array_position("v", F.lit(0).cast("long")) - 1).cast("int").alias("entering"))
    return cut.join(enters, ["ck", "block"])


def digests(rows: DataFrame) -> DataFrame:
    """(ck, sha256): of each conversation's `role:text` lines in order, newline-joined.

    Rows stream through a task sorted by conversation; it holds one batch, whatever a conversation's length.
    """
    lines = rows.select("ck", "block", "seq", F.concat("role", F.lit(":"), "text").cast("binary").alias("line"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, h = None, None
        for pdf in batches:
            out = []
            for ck, line in zip(pdf["ck"], pdf["line"], strict=True):
                if ck == now:
                    h.update(b"\n")
                else:
                    if now is not None:
                        out.append((now, h.hexdigest()))
                    now, h = ck, hashlib.sha256()
                h.update(line)
            yield pd.DataFrame(out, columns=["ck", "sha256"])
        if now is not None:
            yield pd.DataFrame([(now, h.hexdigest())], columns=["ck", "sha256"])

    return lines.repartition("ck").sortWithinPartitions("ck", "block", "seq").mapInPandas(walk, "ck string, sha256 string")


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Planted faults by crc32 of `conv:turn` modulo 20: 0 drops a row (present = false), 1 empties its text, 2 removes
    its sentence ends, 3 repeats it, 4 makes its role user.  Nulls count as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    r = F.crc32(F.concat(space(conv), F.lit(":"), space(turn))) % 20
    d = rows.select(F.col(conv), F.col(turn), space(role).alias(role), space(text).alias(text), r.alias("_r"))
    r = F.col("_r")
    d = d.withColumn(text, F.when(r == 1, "").when(r == 2, F.translate(F.col(text), ".!?", "")).otherwise(F.col(text)))
    d = d.withColumn(role, F.when(r == 4, "user").otherwise(F.col(role))).withColumn("present", r != 0)
    return d.withColumn("_copy", F.explode(F.when(r == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_r", "_copy")
