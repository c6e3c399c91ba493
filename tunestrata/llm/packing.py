"""Packing documents into sequences: shortest pack first over the histogram of lengths.

Encoding cuts every document into full sequences and a remainder, stores one row per piece and
counts the pieces of each length. The histogram (one number per length, so at most ``capacity``
numbers) is packed on the driver: lengths are placed longest first, each into the pattern with
the most room, as many at once as both sides have (Krell et al., 2021). Patterns then meet the
pieces by rank: the r-th piece of a length takes the r-th place that the patterns have for it.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tunestrata.llm.common import text_or_empty, written
from tunestrata.llm.tokens import id_bytes

_PIECES = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "slice", "spot")]
)


def cut_lengths(total: int, capacity: int) -> list[int]:
    """Full sequences first, then what is left."""
    whole, rest = divmod(total, capacity)
    return [capacity] * whole + [rest] * (rest > 0)


def _encoded_pieces(path: str, capacity: int, end_id: int):
    ending = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``spot`` numbers the pieces of one length within the slice, a partition of the input."""
        slice_, seen = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            rows: list[list] = [[] for _ in _PIECES]
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name, ids in zip(names, id_bytes(texts, path), strict=True):
                ids += ending
                total, start = len(ids) // 4, 0
                for length in cut_lengths(total, capacity):
                    crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
                    row = (name, start, length, crc, total, slice_, seen[length])
                    seen[length] += 1
                    start += length
                    for column, value in zip(rows, row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in rows], schema=_PIECES
            )

    return pieces


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple]]:
    """``(count, lengths)`` patterns: how often a sequence of these lengths is made.

    Lengths of a pattern come as ``(length, times)`` pairs, longest first. Every length adds at
    most two patterns, so there are at most twice as many as there are lengths.
    """
    by_room: dict[int, list[tuple[int, tuple]]] = defaultdict(list)
    rooms: list[int] = []  # rooms of open patterns, in order

    def put(room: int, count: int, lengths: tuple) -> None:
        if not by_room[room]:
            bisect.insort(rooms, room)
        by_room[room].append((count, lengths))

    def extended(lengths: tuple, length: int, times: int) -> tuple:
        if lengths and lengths[-1][0] == length:
            return (*lengths[:-1], (length, lengths[-1][1] + times))
        return (*lengths, (length, times))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = rooms[-1] if rooms else 0
            if room < length:
                fit = capacity // length
                if left >= fit:
                    put(capacity - fit * length, left // fit, ((length, fit),))
                if left % fit:
                    put(capacity - left % fit * length, 1, ((length, left % fit),))
                break
            count, lengths = by_room[room].pop()
            if not by_room[room]:
                rooms.pop()
            used = min(count, left)
            if used < count:
                put(room, count - used, lengths)
            put(room - length, used, extended(lengths, length, 1))
            left -= used
    return [pattern for room in by_room.values() for pattern in room]


def places(patterns: list[tuple[int, tuple]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, its places in rank order: first rank, first sequence, and offset of each run.

    A run holds the places at one offset of one pattern; rank and sequence go up together in it.
    """
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    sequence = 0
    for count, lengths in patterns:
        offset = 0
        for length, times in lengths:
            for _ in range(times):
                runs[length].append((taken[length], sequence, offset))
                taken[length] += count
                offset += length
        sequence += count
    return {n: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for n, r in runs.items()}


def packed(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces with ``length, slice, spot``."""
    spark = pieces.sparkSession
    per_slice = pieces.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(per_slice.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-counts")
    totals = starts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most ``capacity`` rows
    found = spark.sparkContext.broadcast(places(pack_histogram({r["length"]: r["n"] for r in totals}, capacity)))

    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        order = np.argsort(lengths, kind="stable")
        values, first = np.unique(lengths[order], return_index=True)
        for value, rows in zip(values, np.split(order, first[1:]), strict=True):
            ranks_from, sequences, offsets = found.value[int(value)]
            run = np.searchsorted(ranks_from, ranks[rows], side="right") - 1
            sequence[rows] = sequences[run] + ranks[rows] - ranks_from[run]
            offset[rows] = offsets[run]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    spot = StructType([StructField("sequence_id", LongType()), StructField("offset", LongType())])
    placed = F.pandas_udf(place, spot)
    ranked = pieces.join(starts.drop("n"), ["length", "slice"])
    ranked = ranked.withColumn("_at", placed("length", F.col("before") + F.col("spot")))
    return ranked.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "_at.sequence_id", "_at.offset"
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Every document is encoded once and ends with ``end_id``; a null or empty text is that id alone.
    Repeated rows are packed as often as they occur; a null id stays null. An empty table gives
    an empty result. Other columns of ``docs`` are ignored.
    """
    encoded = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(
        _encoded_pieces(tokenizer_path, capacity, end_id),
        ", ".join(f"{n} bigint" for n in _PIECES.names),
    )
    return packed(written(encoded, "pieces"), capacity)
