"""Cheapest repair of conversations' turn structure, and of the cheapest the least audit.

A repaired conversation's role initials have the form ``(s?(ua)+)?``. Rows are kept, given another
role, or deleted, and empty rows may be inserted. What was accepted so far is one of four states,
so a repair is a path through nodes (row, state), and every letter of an audit is an arc.

A cost DP from the end on gives each node the cost still to come; arcs that lose nothing are the
optimal ones. Nodes are then ranked by their least audit of 1, 2, 4, ... letters: the rank of twice
the length is the rank of a pair, a node's own and that of the node its pointer leads to, and the
pointer goes there twice as far. Ranks choose each node's arc, and the doubled pointers mark the path.

Rows are numbered in one global order and cut into stretches of a fixed number of rows, so a
conversation may have any length. Where one goes on in the next stretch, costs between the states
at both ends are a small matrix and chosen paths a small map; both are put together by doubling, too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunestrata.llm.common import written
from tunestrata.operators.joins import per_key

#: Rows of a stretch.
STRETCH = 4096
# White space, sentence ends, costs.
SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1

_NONE = 1 << 40  # the cost of what cannot be
START, SYSTEM, USER, ASSISTANT = range(4)  # states: what the last accepted row was
_NEXT = np.array([USER, USER, ASSISTANT, USER])  # the state after a row of the role that is due
_KEPT = np.array([[SYSTEM, -1, -1, -1], [USER, USER, -1, USER], [-1, -1, ASSISTANT, -1], [-1] * 4])  # by initial: s, u, a, other
_LETTERS = np.array(["D", "I", "K", "R"])
BLANK, DUPLICATE, CUT = 1, 2, 3
_MASK = (1 << 33) - 1


# ---- one stretch -------------------------------------------------------------


def _settled(e: int, s: int, u: int, a: int) -> tuple[int, int, int, int]:
    """Costs to come once rows may be inserted first."""
    u, a = min(u, INSERT + a), min(a, INSERT + u)
    return min(e, INSERT + u), min(s, INSERT + u), u, a


def costs(initials: list[int], faults: list[int], end: tuple[int, ...] | None) -> list[tuple[int, ...]]:
    """Cost to come by row and state; the last entry is the end's: the given one, or a conversation's."""
    after = _settled(0, _NONE, _NONE, 0) if end is None else tuple(end)
    found = [after]
    for initial, fault in zip(reversed(initials), reversed(faults), strict=True):
        e, s, u, a = after
        best = [DELETE + e, DELETE + s, DELETE + u, DELETE + a]
        if fault not in (BLANK, DUPLICATE):
            more = TRUNCATED if fault == CUT else 0
            for state in range(4):
                best[state] = min(best[state], REROLE + more + after[_NEXT[state]])
                kept = _KEPT[initial][state]
                if kept >= 0:
                    best[state] = min(best[state], more + after[kept])
        after = _settled(*(min(b, _NONE) for b in best))
        found.append(after)
    return found[::-1]


def between(initials: list[int], faults: list[int]) -> list[int]:
    """The cost of going through the rows from each state to each state, row by row."""
    to = [costs(initials, faults, tuple(0 if s == t else _NONE for s in range(4)))[0] for t in range(4)]
    return [min(to[t][s], _NONE) for s in range(4) for t in range(4)]


class Arcs:
    """The optimal arcs of several runs of rows, their nodes ranked by audit.

    ``runs`` holds ``(initials, faults, end)``; every run gets a last place for its end. Node ``4 * place
    + state``. At a node no two arcs have one letter, so pointers are single.
    """

    def __init__(self, runs: list[tuple[list[int], list[int], tuple[int, ...] | None]]):
        self.first = np.cumsum([0, *(len(r[0]) + 1 for r in runs)])[:-1]
        cost = np.array([c for r in runs for c in costs(*r)], np.int64)
        places = len(cost)
        real, open_end = np.ones(places, bool), np.zeros(places, bool)
        initial, fault = np.full(places, 3), np.zeros(places, np.int64)
        for at, (initials, faults, end) in zip(self.first, runs, strict=True):
            initial[at : at + len(initials)], fault[at : at + len(faults)] = initials, faults
            real[at + len(initials)], open_end[at + len(initials)] = False, end is not None
        below = np.minimum(np.arange(places) + 1, places - 1)
        more = np.where(fault == CUT, TRUNCATED, 0)
        may_stay = real & (fault != BLANK) & (fault != DUPLICATE)
        state = np.tile(np.arange(4), (places, 1))
        due, kept = _NEXT[state], _KEPT[initial]
        here, under = 4 * np.arange(places)[:, None], 4 * below[:, None]
        flat = cost.ravel()
        options = [  # in the order of their letters: target, its cost, whether it can be
            (under + state, DELETE, real[:, None]),
            (here + due, INSERT, ~open_end[:, None]),
            (under + np.maximum(kept, 0), more[:, None], may_stay[:, None] & (kept >= 0)),
            (under + due, REROLE + more[:, None], may_stay[:, None]),
        ]
        self.target = np.stack([np.broadcast_to(t, cost.shape).ravel() for t, _, _ in options])
        self.open = np.stack([((cost == price + flat[t]) & can & (cost < _NONE)).ravel() for t, price, can in options])
        self.rank = self._ranked()
        size = int(self.rank.max(initial=0)) + 1
        key = np.where(self.open, (np.arange(4)[:, None] + 1) * size + self.rank[self.target], 5 * size)
        self.letter = key.argmin(axis=0)
        self.ends = ~self.open.any(axis=0)
        nodes = np.arange(len(flat))
        self.step = np.where(self.ends, nodes, self.target[self.letter, nodes])

    def _ranked(self) -> np.ndarray:
        """Ranks by whole audits, from ranks by 1, 2, 4, ... letters."""
        nodes = np.arange(self.open.shape[1])
        letter, ends = self.open.argmax(axis=0), ~self.open.any(axis=0)
        rank = np.where(ends, 0, letter + 1)
        leads = np.where(ends, nodes, self.target[letter, nodes])
        while True:
            _, rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + rank[leads], return_inverse=True)
            if (leads[leads] == leads).all():
                return rank
            leads = leads[leads]

    def leads(self, entries: np.ndarray) -> np.ndarray:
        """The node at which the path of each entry ends."""
        jump = self.step
        while (jump[jump] != jump).any():
            jump = jump[jump]
        return jump[entries]

    def paths(self, entries: np.ndarray) -> np.ndarray:
        """The nodes with a letter on the paths from the entries, in the order of the audits."""
        steps = np.full(len(self.step), -1, np.int64)
        steps[entries] = 0
        marked, jump, far = np.unique(entries), self.step, 1
        while len(marked):
            new = jump[marked]
            fresh = steps[new] < 0
            if not fresh.any() and (jump[jump] == jump).all():
                break
            steps[new[fresh]] = steps[marked[fresh]] + far
            marked, jump, far = np.flatnonzero(steps >= 0), jump[jump], 2 * far
        found = np.flatnonzero((steps >= 0) & ~self.ends)
        return found[np.lexsort((steps[found], found // 4))]


def _runs(rows: pd.DataFrame) -> tuple[pd.DataFrame, list[tuple[int, int, bool, bool]]]:
    """A stretch's own rows in order, and its runs of one conversation: start, stop, whether a run
    goes on from the stretch before, and whether it goes on in the next. One row of each neighbour is there."""
    rows = rows.sort_values("pos")
    home = rows["pos"].to_numpy() // STRETCH
    mine = rows["at"].to_numpy() == home
    keys = rows["key"].to_numpy()
    if not mine.any():  # the row of a neighbour alone
        return rows[mine], []
    before, own, after = keys[rows["at"].to_numpy() > home], keys[mine], keys[rows["at"].to_numpy() < home]
    cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    runs = [
        (int(a), int(b), a == 0 and len(before) > 0 and before[0] == own[0], b == len(own) and len(after) > 0 and after[0] == own[-1])
        for a, b in zip(cuts, np.r_[cuts[1:], len(own)], strict=True)
    ]
    return rows[mine], runs


def _keyed(keys: list[str], rows: pd.DataFrame, m: list[list[int]]) -> pd.DataFrame:
    at = int(rows["at"].iloc[0]) if len(rows) else 0
    return pd.DataFrame({"key": pd.Series(keys, dtype=object), "at": at, "m": pd.Series(m, dtype=object)})


def _open_costs(rows: pd.DataFrame) -> pd.DataFrame:
    own, runs = _runs(rows)
    initials, faults, keys = own["initial"].tolist(), own["fault"].tolist(), own["key"].tolist()
    found = []
    for a, b, goes_on_from, goes_on in runs:
        if goes_on:
            found.append((keys[a], between(initials[a:b], faults[a:b])))
        elif goes_on_from:
            last = costs(initials[a:b], faults[a:b], None)[0]
            found.append((keys[a], [x for s in range(4) for x in (last[s], _NONE, _NONE, _NONE)]))
    return _keyed([k for k, _ in found], rows, [m for _, m in found])


def _ending(ends: pd.DataFrame) -> dict[str, tuple[int, ...]]:
    return {k: tuple(int(x) for x in end) for k, end in zip(ends["key"], ends["ending"], strict=True)}


def _open_paths(rows: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
    if not len(rows):
        return _keyed([], rows, [])
    own, runs = _runs(rows)
    initials, faults, keys = own["initial"].tolist(), own["fault"].tolist(), own["key"].tolist()
    ending = _ending(ends)
    open_runs = [(a, b) for a, b, _, goes_on in runs if goes_on]
    arcs = Arcs([(initials[a:b], faults[a:b], ending[keys[a]]) for a, b in open_runs]) if open_runs else None
    maps = [(arcs.leads(4 * at + np.arange(4)) % 4).tolist() for at in arcs.first] if arcs else []
    return _keyed([keys[a] for a, _ in open_runs], rows, maps)


def _edits(rows: pd.DataFrame, info: pd.DataFrame) -> pd.DataFrame:
    """For every row: its letter, the role it gets, and roles inserted before and behind it."""
    own, runs = _runs(rows) if len(rows) else (rows, [])
    if not runs:
        return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("pos", "letter", "given", "pre", "post")})
    initials, faults, keys = own["initial"].tolist(), own["fault"].tolist(), own["key"].tolist()
    entry = dict(zip(info["key"], info["entry"], strict=True))
    ending = _ending(info)
    arcs = Arcs([(initials[a:b], faults[a:b], ending[keys[a]] if goes_on else None) for a, b, _, goes_on in runs])
    begin = np.array([entry[keys[a]] if goes_on_from else START for a, _, goes_on_from, _ in runs], np.int64)
    nodes = arcs.paths(4 * arcs.first + begin)
    n = len(own)
    letter, given, pre, post = np.full(n, "", object), np.full(n, "", object), [""] * n, [""] * n
    row_of = np.full(len(arcs.step) // 4, -1)
    last_of = np.full(len(arcs.step) // 4, -1)
    for at, (a, b, _, _) in zip(arcs.first, runs, strict=True):
        row_of[at : at + b - a] = np.arange(a, b)
        last_of[at + b - a] = b - 1
    for node in nodes.tolist():
        place, kind = node // 4, arcs.letter[node]
        role = "u" if _NEXT[node % 4] == USER else "a"
        row = row_of[place]
        if kind == 1 and row >= 0:
            pre[row] += role
        elif kind == 1:
            post[last_of[place]] += role
        else:
            letter[row], given[row] = _LETTERS[kind], role if kind == 3 else ""
    texts = {"letter": letter, "given": given, "pre": pre, "post": post}
    return pd.DataFrame({"pos": own["pos"].to_numpy()} | {c: pd.Series(list(v), dtype=object) for c, v in texts.items()})


# ---- between stretches --------------------------------------------------------


def _cheapest(first: Column, then: Column) -> Column:
    """The least costs over two stretches, from those over each."""
    return F.array(
        *(F.least(*(first[4 * s + r] + then[4 * r + t] for r in range(4)), F.lit(_NONE)) for s in range(4) for t in range(4))
    )


def _composed(first: Column, then: Column) -> Column:
    return F.transform(first, lambda state: then[state.cast("int")])


def _doubled(parts: DataFrame, rounds: int, step: int, joined) -> DataFrame:
    """``key, at, m`` with ``m`` put together over all stretches from ``at`` on in the direction of ``step``."""
    for k in range(rounds):
        other = parts.select(F.col("key"), (F.col("at") - step * (1 << k)).alias("at"), F.col("m").alias("other"))
        both = joined(F.col("m"), F.col("other")) if step > 0 else joined(F.col("other"), F.col("m"))
        m = F.when(F.col("other").isNull(), F.col("m")).otherwise(both).alias("m")
        parts = written(parts.join(other, ["key", "at"], "left").select("key", "at", m), "conversation-doubling")
    return parts


# ---- the operator -------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, key, turn, role, text`` after the damage; nulls count as one space, in the hashed key too."""
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = conversations.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(" ")).alias("key"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        (F.crc32(name.cast("binary")) % 20).alias("kind"),
    ).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "key",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


def _placed(rows: DataFrame) -> DataFrame:
    """The rows with ``pos``: their number in the order of conversation, turn (nulls first), role, text.

    A range sort deals out even a conversation that holds most rows; equal rows part by where they are read.
    """
    order = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("row")]
    stored = written(
        rows.withColumn("row", F.monotonically_increasing_id())
        .orderBy(*order)
        .drop("row")
        .withColumns({"slice": F.spark_partition_id(), "spot": F.monotonically_increasing_id().bitwiseAND(F.lit(_MASK))}),
        "conversation-rows",
    )
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = stored.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))  # one row for each slice of the sort
    shifts = shifts.select("slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    return stored.join(F.broadcast(shifts), "slice").withColumn("pos", F.col("shift") + F.col("spot")).drop("slice", "spot", "shift")


def _marked(placed: DataFrame) -> DataFrame:
    """``pos, key, turn, initial, fault`` of every row, without its text."""
    tail = F.rtrim("text", F.lit(SPACE))
    light = placed.select(
        "pos", "key", "turn", "role", F.sha2("text", 256).alias("digest"), (tail == "").alias("blank"),
        (~F.contains(F.lit(ENDS), F.right(tail, F.lit(1)))).alias("cut"),
    )
    first = per_key(light.where("not blank"), ["key", "role", "digest"], F.min("pos").alias("pos")).select("pos", F.lit(True).alias("new"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("new").isNull(), DUPLICATE).when(F.col("cut"), CUT).otherwise(0)
    begins = F.substring("role", 1, 1)
    initial = F.when(begins == "s", 0).when(begins == "u", 1).when(begins == "a", 2).otherwise(3)
    return light.join(first, "pos", "left").select("pos", "key", "turn", initial.alias("initial"), fault.alias("fault"))


def _edited(light: DataFrame) -> DataFrame:
    """``pos, letter, given, pre, post`` of every row of ``light`` (stored)."""
    at, spot = F.floor(F.col("pos") / STRETCH).cast("bigint"), F.col("pos") % STRETCH
    seen = F.array_compact(F.array(at, F.when(spot == 0, at - 1), F.when(spot == STRETCH - 1, at + 1)))
    dealt = light.select("pos", "key", "initial", "fault", F.explode(seen).alias("at"))
    parts = written(dealt.groupBy("at").applyInPandas(_open_costs, "key string, at bigint, m array<bigint>"), "conversation-costs")
    longest = parts.groupBy("key").agg((F.max("at") - F.min("at") + 1).alias("n")).agg(F.max("n")).first()[0] or 0
    rounds = max(int(longest) - 1, 0).bit_length()
    to_come = _doubled(parts, rounds, 1, _cheapest)
    first_column = F.array(*(F.col("m")[4 * s] for s in range(4)))
    ends = written(to_come.select("key", (F.col("at") - 1).alias("at"), first_column.alias("ending")), "conversation-ends")
    maps = dealt.groupBy("at").cogroup(ends.groupBy("at")).applyInPandas(_open_paths, "key string, at bigint, m array<bigint>")
    maps = _doubled(written(maps, "conversation-paths"), rounds, -1, _composed)
    entries = maps.select("key", (F.col("at") + 1).alias("at"), F.col("m")[START].cast("bigint").alias("entry"))
    info = written(ends.join(entries, ["key", "at"], "full"), "conversation-borders")
    info = info.withColumns({"entry": F.coalesce("entry", F.lit(START).cast("bigint")), "ending": F.coalesce("ending", F.array_repeat(F.lit(0).cast("bigint"), 4))})
    edits = dealt.groupBy("at").cogroup(info.groupBy("at")).applyInPandas(_edits, "pos bigint, letter string, given string, pre string, post string")
    return edits


_RESULT = pa.schema(
    [("key", pa.string()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())]
)


class _Conversation:
    """Running figures and the running digest of one conversation; no text is kept."""

    def __init__(self, key: str):
        self.key, self.cost, self.illegal, self.faults = key, 0, 0, [0, 0, 0, 0]
        self.low = self.high = self.turn = self.initial = None
        self.turns, self.audit, self.digest, self.empty = 0, [], hashlib.sha256(), True

    def line(self, role: str, text: str = "") -> None:
        self.digest.update(("" if self.empty else "\n").encode() + f"{role}:".encode() + text.encode())
        self.empty = False

    def row(self, turn: int | None, role: str, text: str, initial: int, fault: int, letter: str, given: str, pre: str, post: str) -> None:
        if turn is not None:
            self.turns += turn != self.turn
            self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
        if self.initial is not None:
            self.illegal += (self.initial, initial) not in ((0, 1), (1, 2), (2, 1))
        self.initial = initial
        self.faults[fault] += 1
        self.cost += INSERT * (len(pre) + len(post)) + {"D": DELETE, "R": REROLE, "K": 0}[letter] + (TRUNCATED if fault == CUT and letter != "D" else 0)
        self.audit.append("I" * len(pre) + letter + "I" * len(post))
        names = {"u": "user", "a": "assistant"}
        for inserted in pre:
            self.line(names[inserted])
        if letter != "D":
            self.line(names.get(given, role), text)
        for inserted in post:
            self.line(names[inserted])

    def figures(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.key, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order, conversations one after the other."""
    now, done = None, []
    for batch in batches:
        for key, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now.key != key:
                done += [now.figures()] if now else []
                now = _Conversation(key)
            now.row(*row)
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(_RESULT.names, d, strict=True)) for d in done], schema=_RESULT)
            done = []
    if now:
        yield pa.RecordBatch.from_pylist([dict(zip(_RESULT.names, now.figures(), strict=True))], schema=_RESULT)


def repaired(conversations: DataFrame) -> DataFrame:
    """Damage the rows and repair them; one row for every ``conv_id`` of ``conversations``:
    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Nulls in role and text count as one space, so a null text is blank and a null role fits nowhere;
    null ids are one conversation. Rows of one turn follow each other by role and text. Repeated
    rows are rows like others. A conversation of which no row is left has zeros, an empty audit and
    the digest of no text; an empty table gives an empty result. Other columns are ignored.

    A conversation of any length is solved in stretches. Only its digest is made in one task, from
    rows in order as they come by, since a SHA-256 cannot be put together from parts; its audit, one
    letter an edit, is one value of the result.
    """
    placed = _placed(damaged(conversations))
    light = written(_marked(placed), "conversation-faults")
    edits = written(_edited(light), "conversation-edits")
    told = (
        placed.select("key", "pos", "turn", "role", "text")
        .join(light.select("pos", "initial", "fault"), "pos")
        .join(edits, "pos")
        .repartition("key")
        .sortWithinPartitions("key", "pos")
        .select("key", "turn", "role", "text", "initial", "fault", "letter", "given", "pre", "post")
        .mapInArrow(_told, "key string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string")
    )
    ids = per_key(conversations, ["conv_id"]).withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(" ")))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return ids.join(told, "key", "left").select(
        "conv_id",
        *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
