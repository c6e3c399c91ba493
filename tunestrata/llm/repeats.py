"""Repeated passages by a sparse suffix array, sorted by distributed prefix doubling.

A byte goes if a string of 100 bytes that covers it also starts earlier. Strings get names of
doubling length: the name of twice as many bytes is made of the pair of a place's own name and that
at an offset of the length so far (1, 2, 4, ... 64, and 100 from two of 64 at an offset of 36). Spark
sorts places by pairs of names in growing rounds; a place that is alone in its round is unique and
leaves, and where the names of 100 bytes are equal the threshold is passed and all but the first go.

Not every byte takes part in the first round. Of the 69 strings of 32 bytes within a string of 100,
the one with the least name stands for it, wherever the string occurs; consecutive starts with the
least name at one place are a segment, some 35 on average. Round one sorts segments by that name and the
names of the first and the last 100 bytes they hold: segments alone under their least name are
unique, equal ones leave but for the first. Different segments under one least name go on, cut out
of their texts. Round two sorts them by the names of 64 bytes from the place of the least name on, and
up to its end: each of a segment's strings holds one of the two. The last round takes the starts of
what still is not alone one by one.

Places are ordered by document (null ids last), then by place. Rows with one id and different texts
are told apart by 31 bits of a checksum; rows equal in both are one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunestrata.llm.common import text_or_empty
from tunestrata.operators.joins import per_key
from tunestrata.session import discard, settle, shared_path
from tunestrata.sources import checkpoint

#: Bytes of the strings that count, and of those whose least name stands for one; starts per segment at most.
LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1
_HALF = 64
#: Bytes that are named together.
TOGETHER = 1 << 18
_TIE_BITS = 32  # a place is the checksum's 31 bits, then 32 bits of offset
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0xD6E8FEB86659FD93))


# ---- names --------------------------------------------------------------------


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of pairs of names."""
    turned = b >> np.uint64(29)
    turned ^= b
    turned *= _B
    turned += a * _A
    turned ^= turned >> np.uint64(32)
    return turned


def names(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names of the ``GRAM`` and of the ``_HALF`` bytes from each place on."""
    name, size, short = (data.astype(np.uint64) + np.uint64(1)) * _C, 1, None
    while size < _HALF:
        name, size = _paired(name[:-size], name[size:]), 2 * size
        short = name if size == GRAM else short
    return short, name


def _least(name: np.ndarray) -> np.ndarray:
    """The least of ``SPAN`` consecutive names, by doubling as well."""
    size = 1
    while 2 * size <= SPAN:
        name, size = np.minimum(name[:-size], name[size:]), 2 * size
    return np.minimum(name[: len(name) - (SPAN - size)], name[SPAN - size :])


def _parted(short: np.ndarray, at: np.ndarray, cut: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of starts, cut where the first place of the least name changes: so no two strings in a
    segment are equal, since the least name lies elsewhere in each."""
    within = np.lib.stride_tricks.sliding_window_view(short, SPAN)
    cuts, sizes = [], []
    while len(cut):
        first = within[at[cut]].argmin(axis=1) + 1
        size = np.minimum(first, n)
        cuts.append(cut)
        sizes.append(size)
        rest = size < n
        cut, n = (cut + size)[rest], (n - size)[rest]
    cut, n = np.concatenate([*cuts, np.empty(0, np.int64)]), np.concatenate([*sizes, np.empty(0, np.int64)])
    order = np.argsort(cut)
    return cut[order], n[order]


def segments(data: np.ndarray, begin: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """``place, starts, piece, least name, name`` of the segments of pieces of ``data``.

    A piece begins at a place and has a number of starts, each with ``LENGTH`` bytes from there on.
    """
    short, half = names(data)
    whole = _paired(half[: len(half) - (LENGTH - _HALF)], half[LENGTH - _HALF :])
    total = int(starts.sum())
    run = np.arange(total)
    piece = np.repeat(np.arange(len(starts)), starts)
    at = run + np.repeat(begin - (np.cumsum(starts) - starts), starts)
    least = _least(short)[at]
    new = np.ones(total, bool)
    new[1:] = (least[1:] != least[:-1]) | (piece[1:] != piece[:-1])
    new |= (run - np.maximum.accumulate(np.where(new, run, 0))) % SPAN == 0
    cut = np.flatnonzero(new)
    cut, n = _parted(short, at, cut, np.diff(np.r_[cut, total]))
    low = at[cut]
    name = _paired(whole[low], whole[low + n - 1]) + n.astype(np.uint64) * _C
    return low, n, piece[cut], least[cut], name


def _in_turn(found: Iterator[tuple[int, int, bytes, int]], emit: Callable) -> Iterator[pa.RecordBatch]:
    """Pieces ``(row, offset, bytes, starts)`` put together to stretches that are named at once."""
    held, size = [], 0
    for piece in found:
        held.append(piece)
        size += len(piece[2])
        if size >= TOGETHER:
            yield emit(held)
            held, size = [], 0
    if held:
        yield emit(held)


def _laid_out(held: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rows, offsets, parts, starts = zip(*held, strict=True)
    begin = np.cumsum([0, *map(len, parts)])[:-1]
    return np.frombuffer(b"".join(parts), np.uint8), begin, np.array(starts), np.array(rows), np.array(offsets)


def _binary(column: pa.Array) -> pa.Array:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc, tie, text`` to ``least, name, doc, place, n``."""
    for batch in batches:
        ids, ties, texts = batch.column(0), batch.column(1).to_numpy(), _binary(batch.column(2))

        def pieces(texts=texts) -> Iterator[tuple[int, int, bytes, int]]:
            for row, text in enumerate(texts):
                data = memoryview(text.as_py())
                last = len(data) - LENGTH + 1
                for start in range(0, last, TOGETHER):
                    end = min(start + TOGETHER, last)
                    yield row, start, bytes(data[start : end + LENGTH - 1]), end - start

        def emit(held: list, ids=ids, ties=ties) -> pa.RecordBatch:
            data, begin, starts, rows, offsets = _laid_out(held)
            low, n, piece, least, name = segments(data, begin, starts)
            place = (ties[rows[piece]] << _TIE_BITS) + offsets[piece] + low - begin[piece]
            columns = [pa.array(least.view(np.int64)), pa.array(name.view(np.int64)), ids.take(pa.array(rows[piece])), pa.array(place), pa.array(n, pa.int32())]
            return pa.RecordBatch.from_arrays(columns, names=["least", "name", "doc", "place", "n"])

        yield from _in_turn(pieces(), emit)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc, tie, text, loose`` to ``doc, place, n, data``: the bytes of each loose segment."""
    for batch in batches:
        ids, ties, texts, loose = batch.column(0), batch.column(1).to_pylist(), _binary(batch.column(2)), batch.column(3)
        rows, places, sizes, parts, size = [], [], [], [], 0

        def told(ids=ids) -> pa.RecordBatch:
            columns = [ids.take(pa.array(rows)), pa.array(places, pa.int64()), pa.array(sizes, pa.int32()), pa.array(parts, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["doc", "place", "n", "data"])

        for row, (text, spans) in enumerate(zip(texts, loose, strict=True)):
            data = memoryview(text.as_py())
            for at, n in zip(spans.values.field(0).to_pylist(), spans.values.field(1).to_pylist(), strict=True):
                rows.append(row)
                places.append((ties[row] << _TIE_BITS) + at)
                sizes.append(n)
                parts.append(bytes(data[at : at + n - 1 + LENGTH]))
                size += len(parts[-1])
                if size >= 16 * TOGETHER:
                    yield told()
                    rows, places, sizes, parts, size = [], [], [], [], 0
        if rows:
            yield told()


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]]:
    """Rows ``doc, place, n, data, ...`` some at a time: the rows, their bytes put together, where each
    begins, and the names."""
    for batch in batches:
        step = max(1, TOGETHER // (2 * LENGTH))
        for start in range(0, batch.num_rows, step):
            rows = batch.slice(start, step)
            parts = rows.column(3).to_pylist()
            data, begin = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])[:-1]
            yield rows, data, begin, names(data)


def _least_at(short: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return begin + np.lib.stride_tricks.sliding_window_view(short, SPAN)[begin].argmin(axis=1)


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Loose segments to ``name, side, doc, place``: the name of 64 bytes from the least name's place on
    (side 0) where a string of the segment holds them, and of those up to its end (side 1)."""
    for rows, _, begin, (short, half) in _stretches(batches):
        x, n = _least_at(short, begin), rows.column(2).to_numpy()
        for side, there in ((0, x - (begin + n - 1) <= LENGTH - _HALF), (1, x - begin > LENGTH - _HALF)):
            at = x[there] - (GRAM if side else 0)
            some = rows.filter(pa.array(there))
            name = half[at] ^ (_A if side else np.uint64(0))
            columns = [pa.array(name.view(np.int64)), pa.array(np.full(len(at), side), pa.int32()), some.column(0), some.column(1)]
            yield pa.RecordBatch.from_arrays(columns, names=["name", "side", "doc", "place"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Loose segments with the ``sides`` that are left (1 and 2, added up) to ``first, second, doc,
    place``: the pair of names of each start that holds a side that is left."""
    for rows, _, begin, (short, half) in _stretches(batches):
        x, n, sides = _least_at(short, begin), rows.column(2).to_numpy().astype(np.int64), rows.column(4).to_numpy()
        row = np.repeat(np.arange(len(n)), n)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = begin[row] + inside
        goes = np.where(x[row] - at <= LENGTH - _HALF, sides[row] & 1, sides[row] & 2) > 0
        row, inside, at = row[goes], inside[goes], at[goes]
        place = rows.column(1).to_numpy()[row] + inside
        names_of = [pa.array(half[at].view(np.int64)), pa.array(half[at + LENGTH - _HALF].view(np.int64))]
        yield pa.RecordBatch.from_arrays([*names_of, rows.column(0).take(pa.array(row)), pa.array(place)], names=["first", "second", "doc", "place"])


# ---- rounds -------------------------------------------------------------------


def _not_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows those whose first column another row shares; a partition's first and last, too,
    since their like may lie in the neighbouring one."""
    before, waiting, opening = None, None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        like = np.r_[key[0] == before, key[1:] == key[:-1]]  # the row before
        if waiting is not None and like[0]:
            yield waiting
        keep = like | np.r_[like[1:], False]
        keep[0] |= opening
        waiting = None if keep[-1] else batch.slice(batch.num_rows - 1)
        if keep.any():
            yield batch.filter(pa.array(keep))
        before, opening = key[-1], False
    if waiting is not None:
        yield waiting


_LATER = pa.schema([("kind", pa.int32()), ("first", pa.int64()), ("second", pa.int64()), ("doc", pa.int64()), ("place", pa.int64()), ("part", pa.int32())])
_GOES, _HEAD, _TAIL = 0, 1, 2


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by pair of names and place all but the first of each pair; beside them a partition's
    first row, whose like may lie in an earlier one, and the pair of its last (rows that go need no pair)."""
    part = TaskContext.get().partitionId()

    def told(kind: int, rows: pa.RecordBatch) -> pa.RecordBatch:
        n = rows.num_rows
        pair = [pa.nulls(n, pa.int64())] * 2 if kind == _GOES else rows.columns[:2]
        return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), *pair, *rows.columns[2:], pa.array([part] * n, pa.int32())], schema=_LATER)

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        joined = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        if last is None:
            yield told(_HEAD, batch.slice(0, 1))
        first, second = joined.column(0).to_numpy(), joined.column(1).to_numpy()
        same = (first[1:] == first[:-1]) & (second[1:] == second[:-1])
        goes = joined.slice(1).filter(pa.array(same))
        if goes.num_rows:
            yield told(_GOES, goes)
        last = joined.slice(joined.num_rows - 1)
    if last is not None:
        yield told(_TAIL, last)


def _documents(docs: DataFrame) -> DataFrame:
    """``doc, tie, text``; the tie is a checksum of 31 bits."""
    text = text_or_empty()
    return docs.select(F.col("doc_id").alias("doc"), (F.crc32(text.cast("binary")) % F.lit(1 << 31)).alias("tie"), text.alias("text"))


def _same_document(other: str) -> Column:
    return F.col("doc").eqNullSafe(F.col(f"{other}_doc")) & (F.col("tie") == F.col(f"{other}_tie"))


def _per_document(rows: DataFrame, name: str) -> DataFrame:
    """``<name>_doc, <name>_tie, <name>``: all ``place, n`` of a document."""
    tie, offset = F.shiftright("place", _TIE_BITS), F.col("place").bitwiseAND(F.lit((1 << _TIE_BITS) - 1))
    spans = F.collect_list(F.struct(offset.alias("at"), F.col("n").cast("int").alias("n")))
    grouped = rows.groupBy(F.struct(F.col("doc"), tie.alias("tie")).alias("key")).agg(spans.alias(name))
    return grouped.select(F.col("key.doc").alias(f"{name}_doc"), F.col("key.tie").alias(f"{name}_tie"), name)


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc, text, going`` to the result; ``going`` holds starts of strings that go, in runs."""
    for batch in batches:
        rows = []
        for doc, text, spans in zip(batch.column(0).to_pylist(), _binary(batch.column(1)), batch.column(2), strict=True):
            data = text.as_py()
            digest, removed, n_spans, done = hashlib.sha256(), 0, 0, 0
            if spans.is_valid:
                at, n = (spans.values.field(i).to_numpy().astype(np.int64) for i in (0, 1))
                order = np.argsort(at, kind="stable")
                at, end = at[order], np.maximum.accumulate((at + n + LENGTH - 1)[order])
                opens = np.r_[True, at[1:] > end[:-1]]
                lows, highs = at[opens], end[np.r_[opens[1:], True]]
                view = memoryview(data)
                for low, high in zip(lows.tolist(), highs.tolist(), strict=True):
                    digest.update(view[done:low])
                    done = high
                removed, n_spans = int((highs - lows).sum()), len(lows)
                digest.update(view[done:])
            else:
                digest.update(data)
            rows.append((doc, len(data), removed, n_spans, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KEPT.types, strict=True)], schema=_KEPT) if rows else pa.RecordBatch.from_pylist([], schema=_KEPT)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs``.

    Null texts count as empty; texts of less than 100 bytes stay whole; null ids come after all
    others. Rows that repeat id and text are one document and get the same result each. Other columns
    are ignored. An empty table gives an empty result. Every sort is by names and place together, so a
    passage that a third of all documents hold is dealt out over many tasks.
    """
    spark = docs.sparkSession
    texts = _documents(docs)
    paths = {name: shared_path(spark, f"passages-{name}") for name in ("segments", "shared", "firsts", "going", "loose", "later")}
    place = [F.col("doc").asc_nulls_last(), F.col("place")]

    def stored(rows: DataFrame, name: str) -> DataFrame:
        settle(spark)
        return checkpoint(rows, paths[name])

    # Round one: segments under their least name.
    kind = "least bigint, name bigint, doc bigint, place bigint, n int"
    found = stored(texts.select("doc", "tie", "text").mapInArrow(_segments, kind), "segments")
    shared = stored(found.orderBy("least", "name", *place).mapInArrow(_not_alone, kind), "shared")
    discard(spark, paths["segments"])
    first = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "place", "n")).alias("first")
    firsts = per_key(shared, ["least", "name"], first).select("least", "name", "first.doc", "first.place", "first.n")
    firsts = stored(firsts, "firsts")
    listed = firsts.select(F.col("doc").alias("first_doc"), F.col("place").alias("first_place"))
    known = F.col("doc").eqNullSafe(F.col("first_doc")) & (F.col("place") == F.col("first_place"))
    going = stored(shared.join(listed, known, "left_anti").select("doc", "place", "n"), "going")
    discard(spark, paths["shared"])

    # Round two: what is still like something else on one side of the least name.
    several = per_key(firsts, ["least"], F.count(F.lit(1)).alias("several")).where("several > 1")
    loose = _per_document(firsts.join(several, "least", "left_semi"), "loose")
    kind = "doc bigint, place bigint, n int, data binary"
    loose = texts.join(loose, _same_document("loose")).select("doc", "tie", "text", "loose").mapInArrow(_cut_out, kind)
    loose = stored(loose, "loose")
    del found, shared, firsts, listed, several
    discard(spark, paths["firsts"])
    kind = "name bigint, side int, doc bigint, place bigint"
    left = loose.mapInArrow(_sides, kind).orderBy("name", *place).mapInArrow(_not_alone, kind)
    sides = per_key(left, ["doc", "place"], F.bit_or(F.col("side") + 1).alias("sides"))
    sides = sides.select(F.col("doc").alias("first_doc"), F.col("place").alias("first_place"), "sides")

    # Last round: starts one by one.
    pairs = loose.join(sides, known).select("doc", "place", "n", "data", "sides")
    pairs = pairs.mapInArrow(_windows, "first bigint, second bigint, doc bigint, place bigint")
    later = pairs.orderBy("first", "second", *place).mapInArrow(_later, "kind int, first bigint, second bigint, doc bigint, place bigint, part int")
    later = stored(later, "later")
    del loose, left, sides, pairs
    discard(spark, paths["loose"])
    tails = later.where(F.col("kind") == _TAIL).select(*(F.col(c).alias(f"tail_{c}") for c in ("first", "second", "part")))
    heads = later.where(F.col("kind") == _HEAD).join(
        tails, (F.col("first") == F.col("tail_first")) & (F.col("second") == F.col("tail_second")) & (F.col("tail_part") < F.col("part")), "left_semi"
    )
    more = later.where(F.col("kind") == _GOES).unionByName(heads).select("doc", "place", F.lit(1).alias("n"))

    settle(spark)
    spans = _per_document(going.unionByName(more), "going")
    joined = texts.join(spans, _same_document("going"), "left").select("doc", "text", "going")
    return joined.mapInArrow(_kept, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
