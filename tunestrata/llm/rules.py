"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps its measurements and one bit per
failed rule. A policy is a named set of rules: applying or comparing policies, and asking what
each rule takes away, are bit operations on the ledger and never read a text again.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tunestrata.llm.common import free_name, text_or_empty, word_blocks, written

_SPACES = " \t\n\r\x0b\x0c"
_SYMBOLS = "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

#: A rule's place is its bit. New rules go to the end, so that old ledgers stay readable.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "100 * n_symbols > 20 * n_words",
    "repeated_lines": "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines",
    "odd_word_length": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)",
}
BASE = ("few_words", "repeated_windows")
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE,
    "v2": (*BASE, "many_symbols", "repeated_lines", "odd_word_length"),
}
CURRENT = "v2"


def _repeat_words(ids: np.ndarray, n_distinct: int) -> int:
    """Words that lie in a window of three that occurs at least twice."""
    if len(ids) < 3:
        return 0
    _, pairs = np.unique(ids[:-1] * n_distinct + ids[1:], return_inverse=True)
    _, which, times = np.unique(pairs[:-1] * n_distinct + ids[2:], return_inverse=True, return_counts=True)
    again = times[which] > 1
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift : len(ids) - 2 + shift] |= again
    return int(covered.sum())


def measure(text: str) -> tuple[int, ...]:
    """The ``MEASURES`` of a whole text. Words are numbered, so a word of any length costs eight bytes."""
    number: dict[bytes, int] = {}
    parts = [
        np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        for words in word_blocks(text)
    ]
    ids = np.concatenate(parts) if parts else np.empty(0, np.int64)
    lines = [line for line in text.encode().split(b"\n") if line.strip()]
    return (
        len(ids),
        len(text) - sum(map(text.count, _SPACES)),
        sum(map(text.count, _SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        _repeat_words(ids, max(len(number), 1)),
    )


@F.pandas_udf(StructType([StructField(m, LongType()) for m in MEASURES]))
def _measured(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in texts], columns=MEASURES, dtype="int64")


def mask(rules: tuple[str, ...]) -> int:
    order = list(RULES)
    return sum(1 << order.index(rule) for rule in rules)


def failed_rules(at: str = "") -> Column:
    """One bit per failed rule; ``at`` comes before the names of the measurements."""
    failed = F.lit(0)
    for bit, rule in enumerate(RULES.values()):
        placed = re.sub(r"\b[a-z]+_[a-z_]+\b", rf"{at}\g<0>", rule)
        failed = failed.bitwiseOR(F.when(F.expr(placed), F.lit(1 << bit)).otherwise(F.lit(0)))
    return failed.cast("bigint")


def ledger(docs: DataFrame) -> DataFrame:
    """``doc_id``, the measurements, and ``failed``: one bit per rule a document fails.

    A null text has no word. One row per row of ``docs``; other columns are ignored.
    """
    measured = docs.select("doc_id", _measured(text_or_empty()).alias("m")).select("doc_id", "m.*")
    return measured.withColumn("failed", failed_rules())


def passes(policy: str, policies: Mapping[str, tuple[str, ...]] = POLICIES, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(mask(policies[policy]))) == 0


def ablation(rows: DataFrame, policies: Mapping[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """``policy, rule, n_failed, n_only``: documents a rule fails, and those only it keeps out.

    Documents are first counted per mask (at most 2 to the number of rules), so what is compared
    for each policy and rule does not grow with the corpus.
    """
    names = list(RULES)
    cases = F.array(
        *(
            F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(mask(rs)).alias("all"), F.lit(1 << names.index(r)).alias("bit"))
            for p, rs in policies.items()
            for r in rs
        )
    )
    counts = rows.groupBy("failed").agg(F.count(F.lit(1)).alias("n")).withColumn("c", F.explode(cases)).select("failed", "n", "c.*")
    hits = F.col("failed").bitwiseAND(F.col("all"))
    return counts.groupBy("policy", "rule").agg(
        F.coalesce(F.sum(F.when(hits.bitwiseAND(F.col("bit")) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(hits == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_only"),
    )


def policies_compared(docs: DataFrame, policies: Mapping[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """``policy, rule, n_failed, n_only, n_kept``: the ablation beside the documents each policy keeps.

    The ledger is stored once; policies and ablation are read from it. Repeated rows count as often
    as they occur, null and empty texts as documents without a word. An empty table gives an empty result.
    """
    stored = written(ledger(docs), "rule-ledger")
    cases = F.array(*(F.struct(F.lit(p).alias("policy"), passes(p, policies).alias("kept")) for p in policies))
    kept = stored.select(F.explode(cases).alias("c")).groupBy("c.policy").agg(F.count_if("c.kept").alias("n_kept"))
    return ablation(stored, policies).join(kept, "policy")


def judged(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with ``base_failed``, ``kept`` under a policy, and the policy's name.

    One row per row of ``docs``, repeated ones and those without an id too. Null and empty texts have
    no word, so they fail. An empty table gives an empty result.
    """
    base = F.col("failed").bitwiseAND(F.lit(mask(BASE))) != 0
    return (
        ledger(docs)
        .withColumn("base_failed", base)
        .withColumn("kept", ~base & passes(policy))
        .withColumn("policy", F.lit(policy))
    )


def keep_good(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The documents a policy (and always the base rules) lets through, all columns as they are.

    Each row is judged by its own text, where it stands: nothing is joined or shuffled. So repeated
    rows and rows without an id stay or go by themselves; null and empty texts go. An empty table
    gives an empty result.
    """
    name, failed = free_name(docs, "_measured"), free_name(docs, "_failed")
    rows = docs.withColumn(name, _measured(text_or_empty())).withColumn(failed, failed_rules(f"{name}."))
    base = F.col(failed).bitwiseAND(F.lit(mask(BASE))) == 0
    return rows.where(base & passes(policy, failed=failed)).drop(name, failed)
