"""Conversation repair against a search over all edits."""

from __future__ import annotations

import heapq
import random
import zlib

import numpy as np
import plain

from tunestrata.llm import conversations as cv
from tunestrata.llm.common import read, ship_package

SCHEMA = "conv_id bigint, turn bigint, role string, text string, key string, pos bigint, letter string, at bigint"


def damage(rows):
    """Rows ``(conv, turn, role, text)`` after the damage, by conversation."""
    out = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    for part in out.values():
        part.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def faults(part):
    found, seen = [], set()
    for _, role, text in part:
        tail = text.rstrip(" \t\n\x0b\x0c\r")
        found.append("blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def follows(state, initial):
    """The state after a row, or None: '' at the start, else the last initial."""
    if initial == "s":
        return "s" if state == "" else None
    if initial == "u":
        return "u" if state != "u" else None
    return "a" if initial == "a" and state == "u" else None


def repair(part):
    """Uniform-cost search over (row, state); of equal costs the least audit comes first."""
    marks = faults(part)
    todo, done = [(0, "", 0, "", [])], set()
    while todo:
        cost, audit, i, state, lines = heapq.heappop(todo)
        if i == len(part) and state in ("", "a"):
            return cost, audit, lines
        if (i, state) in done:
            continue
        done.add((i, state))
        options = []
        for role in ("user", "assistant"):
            if (to := follows(state, role[0])) is not None:
                options.append((cv.INSERT, "I", i, to, [f"{role}:"]))
        if i < len(part):
            _, role, text = part[i]
            options.append((3, "D", i + 1, state, []))
            if marks[i] not in ("blank", "duplicate"):
                more = int(marks[i] == "truncated")
                if (to := follows(state, role[:1])) is not None:
                    options.append((more, "K", i + 1, to, [f"{role}:{text}"]))
                for new in ("user", "assistant"):
                    if (to := follows(state, new[0])) is not None:
                        options.append((2 + more, "R", i + 1, to, [f"{new}:{text}"]))
        for price, letter, at, to, more_lines in options:
            heapq.heappush(todo, (cost + price, audit + letter, at, to, lines + more_lines))
    raise AssertionError


def expected(rows):
    out = []
    for conv, part in damage(rows).items():
        marks = faults(part)
        turns = [t for t, *_ in part if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _ in part]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, lines = repair(part)
        out.append((conv, gaps, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"), illegal, cost, audit, plain.sha("\n".join(lines))))
    return sorted(out, key=repr)


def frame(spark, rows):
    ship_package(spark)
    return spark.createDataFrame([(*r, "x", 1, "x", 1) for r in rows], SCHEMA).repartition(5)


def made(seed, conversations, length):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "u", None, ""]
    texts = ["Yes.", "No", " ", "", None, "Why?\n\n", "So it goes! \t", "é。", "a.b", "x\x1c", "\x0b\x0c"]
    return [
        (c, rng.choice([t, t, t, t + 3, None]), rng.choices(roles, [9, 9, 9, 9, 3, 1, 1, 1, 1])[0], rng.choice([*texts, f"t{t}.", f"u{t}!", f"w{t}"]))
        for c in range(conversations)
        for t in range(rng.randint(1, length))
    ]


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_small_conversations(spark):
    rows = made(1, 150, 12) + [(None, 1, "user", "Hi."), (None, None, None, None), (999, 3, "user", "Q."), (999, 3, "user", "Q."), (998, None, "assistant", "z")]
    assert found(cv.repaired(frame(spark, rows))) == expected(rows)


def test_repeated_rows_and_ties(spark):
    rows = made(2, 30, 6) * 2
    assert found(cv.repaired(frame(spark, rows))) == expected(rows)


def test_a_conversation_over_many_stretches(spark):
    rows = [(c, t, r, x) for c, t, r, x in made(3, 3, 40)] + [(7, t, *rx) for t, (_, _, *rx) in enumerate(made(4, 900, 14))]
    assert len(rows) > 5000  # more than one stretch
    assert found(cv.repaired(frame(spark, rows))) == expected(rows)


def test_pieces_of_a_conversation_give_the_whole():
    """Costs and paths over pieces, put together, are those of the whole."""
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(2, 30))
        initials, marks = rng.integers(0, 4, n).tolist(), rng.integers(0, 4, n).tolist()
        cut = int(rng.integers(1, n))
        whole = cv.costs(initials, marks, None)
        assert tuple(whole[cut]) == tuple(cv.costs(initials[cut:], marks[cut:], None)[0])
        m, after = cv.between(initials[:cut], marks[:cut]), whole[cut]
        assert [min(m[4 * s + t] + after[t] for t in range(4)) for s in range(4)] == list(whole[0])
        arcs = cv.Arcs([(initials, marks, None)])
        left, right = cv.Arcs([(initials[:cut], marks[:cut], tuple(after))]), cv.Arcs([(initials[cut:], marks[cut:], None)])
        entry = int(left.leads(np.array([0]))[0]) % 4
        letters = [arcs.letter[arcs.paths(np.array([0]))].tolist(), left.letter[left.paths(np.array([0]))].tolist() + right.letter[right.paths(np.array([entry]))].tolist()]
        assert letters[0] == letters[1]


def test_edges(spark):
    empty = frame(spark, [(1, 1, "user", "a")]).where("false")
    assert found(cv.repaired(empty)) == []
    gone = [(c, 0, "user", "Hi.") for c in range(40)]
    assert any(not part for part in damage(gone).values())
    long = [(5, 1, "user", "word " * 400_000 + "."), (5, 2, "assistant", "y" * 3_000_000)]
    assert found(cv.repaired(frame(spark, gone + long))) == expected(gone + long)


def test_given_table(spark, sf_dir):
    ship_package(spark)
    table = read(spark, sf_dir, "conversations")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert found(cv.repaired(table)) == expected(rows)
