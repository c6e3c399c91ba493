"""Token counts with a digest cache.

A count belongs to a content and a tokenizer version, named by their SHA-256 digests. Contents
whose pair is not in the cache are encoded, each distinct one once, and added to it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tunestrata.llm.common import text_or_empty
from tunestrata.llm.ledger import Ledger, digests, paths_with, unseen
from tunestrata.llm.tokens import count_tokens, file_digest

COUNTS = "digest binary, version string, n_tokens bigint, n_bytes bigint"


def tokens_of(text: Column, tokenizer_path: str) -> Column:
    @F.pandas_udf(LongType())
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series(count_tokens(texts.tolist(), tokenizer_path), dtype="int64")

    return count(text)


def refresh(docs: DataFrame, cache: Ledger, tokenizer_path: str) -> DataFrame:
    """Encode what the cache lacks and return ``doc_id, digest`` of every row.

    Counts must equal the library's on the text as it is, so the content is normalised in one
    respect only: null is the empty text.
    """
    paths = digests(docs.select("doc_id", text_or_empty().alias("text")))
    version = file_digest(tokenizer_path)
    misses = unseen(docs.select("doc_id", text_or_empty().alias("text")), paths, cache.read(), version)
    cache.append(
        misses.select(
            "digest",
            F.lit(version).alias("version"),
            tokens_of(F.col("text"), tokenizer_path).alias("n_tokens"),
            F.octet_length("text").cast("bigint").alias("n_bytes"),
        )
    )
    return paths


def token_counts(docs: DataFrame, cache: Ledger, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    A null text counts as empty (no token). Repeated rows come out as often as they go in; rows
    without an id stay. An empty table gives an empty result and leaves the cache as it is. Raises
    if the cache has lost a content.
    """
    paths = refresh(docs, cache, tokenizer_path)
    stored = cache.read().where(F.col("version") == file_digest(tokenizer_path))
    return paths_with(paths, stored, ("n_tokens", "n_bytes")).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
