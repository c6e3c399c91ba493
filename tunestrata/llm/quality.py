"""A quality classifier by compression.

Two zstandard dictionaries are made of good and of bad labelled texts. A text that resembles the
good ones packs better with the first: the difference of the two packed sizes, per byte of the
text, becomes a score by a logistic curve fitted on labelled texts that are in no dictionary.

A text is packed whole, in blocks of one size. In a single piece a long text would soon be packed
by what it holds itself, and the dictionaries would say less about it the longer it is.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tunestrata.llm.common import free_name, text_or_empty, written

#: Bytes of one dictionary.
DICTIONARY_BYTES = 4_000_000
#: Where good texts are many more than bad ones, their dictionary may be this many times the other's
#: size, or as large as it gets (None); the curve's texts decide.
RATIOS = (1, 2, 4, None)
LEVEL = 9
BLOCK_BYTES = 4096
HELD_OUT = 2


def fold(doc_id: str = "doc_id") -> Column:
    """``crc32`` of the id as text, modulo 4."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


@dataclass(frozen=True)
class Classifier:
    """Both dictionaries and the curve. Small and immutable; sent to the executors as a broadcast."""

    good: bytes
    bad: bytes
    slope: float = 0.0
    offset: float = 0.0

    @cached_property
    def _packers(self) -> list[zstd.ZstdCompressor]:
        made = []
        for content in (self.good, self.bad):
            words = zstd.ZstdCompressionDict(content or b"\0" * 8, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            made.append(zstd.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=False))
        return made

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_packers"}

    def __setstate__(self, state):
        self.__dict__.update(state)

    def difference(self, text: str) -> float:
        """Packed with the bad dictionary minus packed with the good one, per byte; 0 for no text."""
        data = text.encode()
        if not data:
            return 0.0
        good, bad = self._packers
        view, total = memoryview(data), 0
        for start in range(0, len(view), BLOCK_BYTES):
            block = view[start : start + BLOCK_BYTES]
            total += len(bad.compress(block)) - len(good.compress(block))
        return total / len(data)

    def score(self, text: str) -> float:
        at = max(-500.0, min(500.0, self.offset + self.slope * self.difference(text)))
        return 1 / (1 + math.exp(-at))


def dictionary(texts: Sequence[str], limit: int = DICTIONARY_BYTES) -> bytes:
    """Whole texts one after the other, as many as fit."""
    parts, size = [], 0
    for text in texts:
        data = text.encode()
        if size + len(data) + 1 <= limit:
            parts.append(data)
            size += len(data) + 1
    return b"\n".join(parts)


def logistic_curve(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset by Newton's method, with Platt's smoothed targets and a slight pull to zero."""
    n1, n0 = int(y.sum()), int((1 - y).sum())
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    centre, spread = (float(x.mean()), float(x.std()) or 1.0) if len(x) else (0.0, 1.0)
    design = np.column_stack([(x - centre) / spread, np.ones(len(x))])
    w = np.array([0.0, math.log((n1 + 1) / (n0 + 1))])
    pull = np.diag([1e-3, 1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (target - p) - pull @ w
        curvature = (design * (p * (1 - p))[:, None]).T @ design + pull + 1e-9 * np.eye(2)
        step = np.linalg.solve(curvature, slope)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / spread), float(w[1] - w[0] * centre / spread)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    dictionary_texts: int = 6000,
    curve_texts: int = 3000,
    stretch: int = 8000,
    dictionary_bytes: int = DICTIONARY_BYTES,
    curve_bytes: int = 8_000_000,
) -> Classifier:
    """Learn from rows outside the held-out fold: folds 0 and 1 fill the dictionaries, 3 the curve.

    What is learnt from is a sample, drawn by a hash of the id and bounded by the arguments: texts per
    class for the dictionaries and of both classes for the curve, no more than ``stretch`` characters
    of a text (of a longer one a stretch whose place the id decides), and bytes of each dictionary and
    of the curve's texts. The bounds are met before anything comes to the driver. The sample's ids
    are broadcast to the scan, so no other text is shuffled. Labels other than 0 and 1, null ids and
    ids with two labels are left out; of texts with one id the least counts. Without labels every
    score is one half; with one class alone it is that class's share.
    """
    usable = (
        labels.where("doc_id is not null and quality in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
        .where("quality = other")
        .select("doc_id", "quality", fold().alias("fold"), F.xxhash64("doc_id").alias("spot"))
        .where(F.col("fold") != HELD_OUT)
    )
    parts = [usable.where(f"fold < 2 and quality = {q}").orderBy("spot", "doc_id").limit(dictionary_texts) for q in (0, 1)]
    curve = usable.where("fold = 3").orderBy("spot", "doc_id").limit(curve_texts)
    chosen = parts[0].union(parts[1]).union(curve)
    length = F.length("text")
    start = F.pmod(F.xxhash64("doc_id"), F.greatest(length - stretch + 1, F.lit(1))).cast("int") + 1
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    texts = texts.withColumn("text", F.when(length <= stretch, F.col("text")).otherwise(F.substr("text", start, F.lit(stretch))))
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality", "fold", "spot").agg(F.min("text").alias("text"))
    drawn = written(rows, "labelled-sample")
    sizes = drawn.select("doc_id", "quality", "fold", "spot", (F.octet_length("text") + 1).alias("size")).collect()
    left, wanted = {0: dictionary_bytes, 1: dictionary_bytes, 2: curve_bytes}, []
    for r in sorted(sizes, key=lambda r: (r["spot"], r["doc_id"])):
        part = 2 if r["fold"] == 3 else r["quality"]
        left[part] -= r["size"]
        if left[part] >= 0:
            wanted.append((r["doc_id"],))
    kept = docs.sparkSession.createDataFrame(wanted, drawn.select("doc_id").schema)
    found = sorted(drawn.join(F.broadcast(kept), "doc_id", "left_semi").collect(), key=lambda r: (r["spot"], r["doc_id"]))
    good, bad = ([r["text"] for r in found if r["fold"] < 2 and r["quality"] == q] for q in (1, 0))
    rest = [r for r in found if r["fold"] == 3]
    y = np.array([r["quality"] for r in rest], dtype=np.int64)
    return min(_candidates(good, bad, [r["text"] for r in rest], y), key=lambda c: c[0])[1]


def _candidates(good: Sequence[str], bad: Sequence[str], texts: Sequence[str], y: np.ndarray):
    """``(loss, classifier)`` for each size the good dictionary may have."""
    poor, full = dictionary(bad), dictionary(good)
    for ratio in RATIOS:
        limit = len(poor) * ratio if ratio else DICTIONARY_BYTES
        if ratio and (not poor or limit >= len(full)):
            continue
        fine = dictionary(good, limit) if ratio else full
        plain = Classifier(fine, poor)
        x = np.array([plain.difference(t) for t in texts])
        slope, offset = logistic_curve(x, y)
        at = np.clip(slope * x + offset, -30, 30)
        yield float(np.log1p(np.exp(np.where(y == 1, -at, at))).mean()) if len(x) else 0.0, Classifier(fine, poor, slope, offset)


def with_score(docs: DataFrame, model: Classifier, column: str = "score") -> DataFrame:
    """Add the score of every whole text; null and empty texts get the curve's value at no difference."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(DoubleType())
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series([sent.value.score(t) for t in texts], dtype="float64")

    return docs.withColumn(column, scores(text_or_empty()))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``; other columns are ignored.

    Null texts count as empty. Rows without an id are scored too (``held_out`` false); repeated rows
    stay repeated. An empty table gives an empty result.
    """
    scored = with_score(docs.select("doc_id", "text"), fit(docs, labels))
    held = F.coalesce(fold() == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_likely_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents scored at the threshold or above, all columns as they are.

    Null and empty texts get the curve's value at no difference; rows without an id are judged like
    others, repeated rows stay repeated, and an empty table gives an empty result.
    """
    name = free_name(docs, "_score")
    return with_score(docs, fit(docs, labels), name).where(F.col(name) >= threshold).drop(name)
