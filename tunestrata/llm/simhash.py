"""SimHash near-duplicates by pigeonring filtering.

A fingerprint has 64 bits. Two fingerprints link if at most three differ. Cut a pair's bits into
four segments on a ring: the differences add up to at most 3, so from at least one segment on
every chain of l consecutive segments holds at most ``l * 3 / 4`` differences (the strong form
of the pigeonring principle; the weak form, the pigeonhole, only has l = 1). So that segment is
equal, and the two together differ in one bit at most: one half of the second is equal, too.

Fingerprints therefore meet under eight keys of 24 bits (start of the chain, its segment, one
half of the next), pass the chain test, and only then have all bits compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tunestrata.llm.common import text_or_empty, word_blocks, written
from tunestrata.llm.components import components
from tunestrata.operators.joins import per_key

SEGMENTS, WIDTH = 4, 16
#: Fingerprints of one key that are compared in one task; larger buckets are cut into blocks.
BUCKET_BLOCK = 4096


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8), bitorder="little")
    return bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)


def fingerprint_of(text: str, seed: int = 42, window: int = 3) -> int:
    """The fingerprint of one text as an unsigned number; 0 if it has no word."""
    tail: list[bytes] = []
    counts, total = np.zeros(64, np.int64), 0
    for block in word_blocks(text):
        words = tail + [w.lower() for w in block]  # bytes.lower changes A-Z alone
        tail = words[-(window - 1) :]
        grams = map(b" ".join, zip(*(words[i:] for i in range(window)), strict=False))
        while part := [xxhash.xxh64_intdigest(g, seed) for g in islice(grams, 1 << 16)]:
            counts += _bit_counts(np.array(part, np.uint64))
            total += len(part)
    if not total:
        if not tail:
            return 0
        total = 1
        counts = _bit_counts(np.array([xxhash.xxh64_intdigest(b" ".join(tail), seed)], np.uint64))
    return sum(1 << int(j) for j in np.flatnonzero(2 * counts > total))


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    found = np.array([fingerprint_of(t) for t in texts], np.uint64)
    return pd.Series(found.view(np.int64))


def with_fingerprint(docs: DataFrame, column: str = "text", out: str = "fp") -> DataFrame:
    """Add the fingerprint as a signed bigint. Null texts count as empty (0)."""
    return docs.withColumn(out, _fingerprints(text_or_empty(column)))


def _chain(xor: np.ndarray, start: int, distance: int) -> np.ndarray:
    """Whether chains of 1, 2, ... segments from ``start`` on stay within their share of the budget."""
    ok, total = np.ones(len(xor), bool), np.zeros(len(xor), np.int64)
    for length in range(1, SEGMENTS + 1):
        shift = np.uint64(WIDTH * ((start + length - 1) % SEGMENTS))
        total += np.bitwise_count((xor >> shift) & np.uint64((1 << WIDTH) - 1))
        ok &= total * SEGMENTS <= distance * length
        if not ok.any():
            break
    return ok


def _forest(fps: np.ndarray, start: int, distance: int) -> list[tuple[int, int]]:
    """Links that join up what is linked within a bucket: a search tree for each component.

    All links of a dense group would be quadratic in number; a tree has one less than its nodes.
    """
    links = []
    rest = np.unique(fps)
    while len(rest) > 1:
        stack, rest = [rest[0]], rest[1:]
        while stack and len(rest):
            node = stack.pop()
            xor = rest ^ node
            near = _chain(xor, start, distance)
            near[near] = np.bitwise_count(xor[near]) <= distance
            if near.any():
                links += [(node, other) for other in rest[near]]
                stack += list(rest[near])
                rest = rest[~near]
    return links


def _bucket_links(distance: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; the last bucket of a batch waits for the next batch."""
        keys = np.empty((0, 2), np.int64)
        fps = np.empty(0, np.uint64)

        def emit(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(f):
                return
            first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(axis=1)])
            last = np.r_[first[1:], len(f)]
            found = []
            for i in np.flatnonzero(last - first > 1):
                start = int(k[first[i], 0] >> 25)
                found += _forest(f[first[i] : last[i]], start, distance)
            if found:
                pairs = np.array(found, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

        for batch in batches:
            new = np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            keys = np.concatenate([keys, new])
            fps = np.concatenate([fps, batch.column(2).to_numpy().view(np.uint64)])
            if len(keys):
                same = (keys == keys[-1]).all(axis=1)
                cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
                yield from emit(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
        yield from emit(keys, fps)

    return links


def near_links(fps: DataFrame, distance: int = 3, block: int = BUCKET_BLOCK) -> DataFrame:
    """``a, b``: links between distinct fingerprints that join up all linked ones.

    ``fps`` has one bigint column without repeated values. The links found are true ones, and two
    fingerprints are connected by them exactly if they are by all links. A bucket with more than
    ``block`` fingerprints is cut into blocks, and each pair of its blocks is a task of its own.
    """
    if not 0 <= distance < SEGMENTS:
        raise ValueError(f"the keys hold for distances below {SEGMENTS}")
    (fp,) = fps.columns

    def bits(segment: int, low: int, width: int) -> F.Column:
        at = WIDTH * (segment % SEGMENTS) + low
        return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))

    half = WIDTH // 2
    keys = [
        F.lit((start * 2 + h) << 24).cast("bigint")
        + F.shiftleft(bits(start, 0, WIDTH), half)
        + bits(start + 1, h * half, half)
        for start in range(SEGMENTS)
        for h in range(2)
    ]
    met = fps.select(F.explode(F.array(*keys)).alias("key"), F.col(fp).alias("fp"))
    sizes = per_key(met, ["key"], F.count(F.lit(1)).alias("n")).where("n > 1")
    met = met.join(sizes, "key")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("bigint")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    met = met.withColumn("blocks", blocks).withColumn("mine", mine)
    pair = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1),
        lambda other: F.least("mine", other) * F.col("blocks") + F.greatest("mine", other),
    )
    met = met.select("key", F.explode(pair).alias("pair"), "fp")
    return (
        met.repartition("key", "pair")
        .sortWithinPartitions("key", "pair")
        .mapInArrow(_bucket_links(distance), "a bigint, b bigint")
        .distinct()
    )


def near_groups(docs: DataFrame, id_column: str = "doc_id", distance: int = 3) -> DataFrame:
    """``id, fp, component_id`` for every row of ``docs`` (columns: the id and ``fp``).

    Equal fingerprints are one node; ``component_id`` is the smallest id of all rows whose
    fingerprints are connected. Rows without an id stay and take part; a component without any id
    has a null ``component_id``. Repeated rows come out as often as they go in.
    """
    nodes = written(per_key(docs, ["fp"], F.min(id_column).alias("least")), "fingerprints")
    roots = components(near_links(nodes.select("fp"), distance))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    whole = per_key(placed, ["root"], F.min("least").alias("component_id"))
    named = written(placed.join(whole, "root").select("fp", "component_id"), "components")
    return docs.join(named, "fp").select(id_column, "fp", "component_id")


def simhash_groups(docs: DataFrame, distance: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every document, the whole text read.

    Null and empty texts have fingerprint zero and link like any other. Further columns of
    ``docs`` are ignored. An empty table gives an empty result.
    """
    fps = written(with_fingerprint(docs.select("doc_id", "text")).select("doc_id", "fp"), "document-fingerprints")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return near_groups(fps, "doc_id", distance).select("doc_id", hexed, "component_id")


def keep_one(docs: DataFrame, distance: int = 3) -> DataFrame:
    """The documents with the smallest id of their group; all columns stay as they are.

    Rows that repeat a kept id stay repeated. Rows without an id belong to no group and stay.
    """
    groups = simhash_groups(docs, distance)
    dropped = per_key(groups.where("doc_id != component_id"), ["doc_id"])
    return docs.join(dropped, "doc_id", "left_anti")
