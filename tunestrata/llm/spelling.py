"""Spelling variants: words one edit from a far more frequent word, found by scans of sorted lists.

The vocabulary is sorted and cut into blocks. A block's words are gone through in order with one
banded row of the edit matrix for each word looked for and each letter of the current word; what the
next word shares with the current one (their longest common prefix) keeps its rows. As soon as no
word looked for is within one edit of a prefix, all words that share this prefix are skipped.

One edit leaves the first or the second half of a word as it is. So a word is looked for among the
words that share its first half, and in the list of reversed words among those that share its second.
A block all of whose words share a prefix more than one edit away is skipped without being opened.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunestrata.llm.common import BLOCK, text_or_empty, written
from tunestrata.operators.joins import per_key
from tunestrata.operators.ordering import global_positions

# Letters (as Latin-1 bytes), least length, least count, and what is damaged how often.
_RUN, _OTHER = re.compile(rb"[a-z\xc0-\xff]+"), re.compile(rb"[^a-z\xc0-\xff]")
LEAST_LENGTH, LEAST_COUNT, DAMAGED = 6, 5, 199
#: A form is at least this many times as frequent.
TIMES = 5
#: Words in a block; larger only where there would be more than ``MOST_BLOCKS`` blocks, whose first
#: and last words (cut to ``EDGE`` letters) are broadcast.
BLOCK_WORDS, MOST_BLOCKS, EDGE = 4096, 1 << 16, 64
#: Distinct words a task keeps before it hands on their counts; words looked for at a time in a block.
KEPT_WORDS, AT_A_TIME = 1 << 17, 1 << 16


# ---- the vocabulary -----------------------------------------------------------


def _pieces(letters: bytes) -> Iterator[bytes]:
    """The text in pieces of some ``BLOCK`` bytes that part no run."""
    start = 0
    while start < len(letters):
        cut = _OTHER.search(letters, start + BLOCK)
        end = cut.start() if cut else len(letters)
        yield letters[start:end]
        start = end


def words_of(doc_id: int | None, text: str) -> Iterator[tuple[bytes, int]]:
    """Words of a text with their counts, damaged where the hash says so; Latin-1, a byte a letter.

    What Latin-1 lacks becomes ``?``, which is no letter either, and ``bytes.lower`` changes A-Z alone.
    """
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for piece in _pieces(text.encode("latin-1", "replace").lower()):
        for run, n in Counter(_RUN.findall(piece)).items():
            if len(run) < LEAST_LENGTH:
                continue
            h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
            if h % DAMAGED == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < LEAST_LENGTH:
                    continue
            yield run, n


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter[bytes] = Counter()

    def told() -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in found], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for word, n in words_of(doc_id, text.as_py()):
                found[word] += n
                if len(found) >= KEPT_WORDS:
                    yield told()
                    found.clear()
    if found:
        yield told()


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n`` of every word that occurs often enough in whole texts (``doc_id, text``)."""
    rows = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(_counted, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# ---- sorted lists -------------------------------------------------------------


def _shared(a: str, b: str) -> int:
    return len(commonprefix([a, b]))


def near_in(words: list[str], wanted: list[str]) -> Iterator[tuple[int, int]]:
    """Pairs of places in ``wanted`` and in ``words`` (sorted) that differ by exactly one edit.

    A row holds the distances of a word's first d letters to the first d - 1, d and d + 1 letters of
    the words looked for; 2 stands for 2 and more. Rows lie on a stack, one for each letter.
    """
    codes = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in wanted]
    length = np.array([len(c) for c in codes], np.int64)
    start = np.concatenate([[0], np.cumsum(length + 1)])[:-1]
    flat = np.concatenate([x for c in codes for x in (c, np.zeros(1, np.uint32))]) if codes else np.empty(0, np.uint32)
    everyone = len(wanted) <= AT_A_TIME and set(words) <= set(wanted)
    first = np.full(len(wanted), 2, np.int8), np.zeros(len(wanted), np.int8), np.ones(len(wanted), np.int8)
    stack, out_at, before = [(np.arange(len(wanted)), *first)], None, ""
    for place, word in enumerate(words):
        shared = _shared(before, word)
        before = word
        if out_at is not None and shared >= out_at:
            continue
        out_at = None
        del stack[shared + 1 :]
        for d in range(shared, len(word)):
            who, low, mid, high = stack[-1]
            base, letter = start[who], ord(word[d])
            end = base + length[who]
            new_low = np.minimum(low + (flat[np.minimum(np.maximum(base + d - 1, base), end)] != letter), mid + 1)
            new_mid = np.minimum(np.minimum(mid + (flat[np.minimum(base + d, end)] != letter), high + 1), new_low + 1)
            new_high = np.minimum(high + (flat[np.minimum(base + d + 1, end)] != letter), new_mid + 1)
            near = np.minimum(np.minimum(new_low, new_mid), new_high) <= 1
            who = who[near]
            if len(who) <= everyone:  # none, or only this very word if it is looked for itself
                out_at = d + 1
                break
            stack.append((who, *(np.minimum(x[near], 2).astype(np.int8) for x in (new_low, new_mid, new_high))))
        else:
            who, *rows = stack[-1]
            more = length[who] - len(word)
            for k, row in zip((-1, 0, 1), rows, strict=True):
                for found in who[(more == k) & (row == 1)].tolist():
                    yield found, place


def _prefix_within_one(word: str, prefix: str) -> bool:
    """Whether some prefix of the word is within one edit of ``prefix``."""
    i, n = _shared(word, prefix), len(prefix)
    return i == n or prefix[i + 1 :] in (word[i + 1 : n], word[i : n - 1]) or prefix[i:] == word[i + 1 : n + 1]


def reached(word: str, half: int, firsts: list[str], lasts: list[str]) -> Iterator[int]:
    """Blocks of a sorted list that may hold words near this one that share its first ``half`` letters."""
    start = word[:half]
    low = bisect_left(lasts, start[:EDGE])
    high = bisect_right(firsts, f"{start}\U0010ffff")
    for block in range(low, high):
        if _prefix_within_one(word, commonprefix([firsts[block], lasts[block]])):
            yield block


def _near_pairs(words: DataFrame) -> DataFrame:
    """``word, near, n`` (the near word's count) for every two words one edit apart, both ways."""
    spark = words.sparkSession
    size = max(BLOCK_WORDS, -(-words.count() // MOST_BLOCKS))
    sides = []
    for side, word in enumerate((F.col("word"), F.reverse("word"))):
        placed = global_positions(words.select(word.alias("word"), "n"), [F.col("word")], "place")
        sides.append(placed.select(F.lit(side).alias("side"), F.floor(F.col("place") / size).cast("bigint").alias("block"), "word", "n"))
    members = written(sides[0].unionByName(sides[1]), "sorted-words")
    edges = members.groupBy("side", "block").agg(F.min("word").alias("low"), F.max("word").alias("high"))
    edges = edges.select("side", "block", F.left("low", F.lit(EDGE)).alias("low"), F.left("high", F.lit(EDGE)).alias("high"))
    found = sorted(edges.collect(), key=lambda r: (r["side"], r["block"]))  # at most 2 * MOST_BLOCKS
    bounds = spark.sparkContext.broadcast([([r["low"] for r in found if r["side"] == s], [r["high"] for r in found if r["side"] == s]) for s in (0, 1)])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for side, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                half = len(word) // 2 if side == 0 else len(word) - len(word) // 2
                rows += [(side, block, word) for block in reached(word, half, *bounds.value[side])]
            columns = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.string()), strict=True)], names=["side", "block", "word"])

    def scan(block: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("word", key=lambda s: s.map(lambda w: w.encode("utf-32-be")))
        words, looked = block["word"].tolist(), wanted["word"].tolist()
        pairs = [(at + i, j) for at in range(0, len(looked), AT_A_TIME) for i, j in near_in(words, looked[at : at + AT_A_TIME])] if words else []
        turn = slice(None, None, -1 if len(wanted) and wanted["side"].iloc[0] else 1)
        counts = block["n"].to_numpy()
        return pd.DataFrame(
            {
                "word": pd.Series([looked[i][turn] for i, _ in pairs], dtype=object),
                "near": pd.Series([words[j][turn] for _, j in pairs], dtype=object),
                "n": pd.Series([counts[j] for _, j in pairs], dtype="int64"),
            }
        )

    looked_for = members.select("side", "word").mapInArrow(route, "side int, block bigint, word string")
    pairs = members.groupBy("side", "block").cogroup(looked_for.groupBy("side", "block")).applyInPandas(scan, "word string, near string, n bigint")
    return pairs.distinct()  # a pair may be found from both ends


# ---- variants -----------------------------------------------------------------


def spelling_variants(docs: DataFrame, times: int = TIMES) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of the vocabulary of ``docs``.

    Null and empty texts have no word; a null id counts as an empty one where words are damaged;
    repeated rows count as often as they occur. Other columns are ignored. An empty table gives an
    empty result. From word to form the count grows ``times``-fold, so chains are short, and doubling
    their pointers a few times leads from every word to its root.
    """
    words = written(vocabulary(docs), "vocabulary")
    near = per_key(_near_pairs(words), ["word"], F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), F.col("near"))).alias("best"))
    fits = -F.col("best.less") >= times * F.col("n")
    formed = written(
        words.join(near, "word", "left").select(
            "word",
            F.when(fits, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(fits, -F.col("best.less")).alias("form_n"),
        ),
        "word-forms",
    )
    leads = formed.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = leads.select(F.col("word").alias("root"), F.col("root").alias("further"))
        leads = written(leads.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "word-roots")
        if leads.where("moved").isEmpty():
            break
        leads = leads.drop("moved")
    return formed.join(leads.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
