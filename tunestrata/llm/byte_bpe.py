"""Byte-level BPE with the tiktoken library and a local rank file: encode, and decode again."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from tunestrata.llm.common import text_or_empty

#: Characters handed to the library at once.
STRETCH = 1 << 18
#: White space in a row from which the library's matcher is passed by: it keeps a place on its stack
#: for every character of such a run, and gives up at about a million.
LONG_RUN = 100_000

# No match of the pattern goes on from a character that is not white space to a blank or newline,
# and none looks back, so what follows such a place is matched the same with or without what is
# before it. \S of Python never counts white space of the library as text.
_SAFE = re.compile(r"(?<=\S)(?=[ \n])")


@cache
def encoding(rank_file: str, pattern: str):
    import tiktoken

    with open(rank_file, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, size: int = STRETCH) -> Iterator[str]:
    """A long text in parts of at least ``size`` characters, cut where no match can cross.

    A stretch without any such place (no blank or newline after other text) stays whole.
    """
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


@cache
def _long_run(least: int) -> re.Pattern:
    """Runs of what the library takes for white space."""
    return re.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{least},}}")


def encoded_parts(
    text: str, rank_file: str, pattern: str, size: int = STRETCH, long_run: int = LONG_RUN
) -> Iterator[list[int]]:
    """The ids of a text, part by part.

    A run of white space is one match, but for its last character if other text follows: that one
    belongs to the next match. Very long runs are encoded as that one piece.
    """
    encoder, at = encoding(rank_file, pattern), 0
    for run in _long_run(long_run).finditer(text) if len(text) >= long_run else ():
        yield from map(encoder.encode_ordinary, safe_parts(text[at : run.start()], size))
        at = run.end() - (run.end() < len(text))
        yield encoder._encode_single_piece(text[run.start() : at].encode())
    yield from map(encoder.encode_ordinary, safe_parts(text[at:], size))


def encode(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Add ``ids``, the token ids of ``text``. Null texts have none."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([[i for part in encoded_parts(t, rank_file, pattern) for i in part] for t in texts])

    return docs.withColumn("ids", ids(text_or_empty()))


def decode(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Add ``bytes``, what ``ids`` stand for. Ids may end inside a character, so it is not a string."""

    @F.pandas_udf(BinaryType())
    def data(ids: pd.Series) -> pd.Series:
        decoder = encoding(rank_file, pattern)
        return pd.Series([decoder.decode_bytes(list(i)) for i in ids], dtype=object)

    return docs.withColumn("bytes", data(F.coalesce("ids", F.array().cast("array<int>"))))


def digest_round_trip(parts: Iterable[list[int]], decoder) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of the ids written with commas, SHA-256 of the bytes they stand for.

    Both digests take in one part after the other; ids of a very long text never stand in one list.
    """
    n, ids_digest, data_digest = 0, hashlib.sha256(), hashlib.sha256()
    for ids in parts:
        if ids:
            ids_digest.update((("," if n else "") + ",".join(map(str, ids))).encode())
            data_digest.update(decoder.decode_bytes(ids))
            n += len(ids)
    return n, ids_digest.hexdigest(), data_digest.hexdigest()


def round_trip(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row of ``docs``.

    A null text counts as empty: no id, and both digests of nothing. Rows without an id and
    repeated rows stay; other columns are ignored.
    """
    fields = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]

    @F.pandas_udf(StructType(fields))
    def trip(texts: pd.Series) -> pd.DataFrame:
        decoder = encoding(rank_file, pattern)
        rows = [digest_round_trip(encoded_parts(t, rank_file, pattern), decoder) for t in texts]
        return pd.DataFrame(rows, columns=[f.name for f in fields])

    return docs.select("doc_id", trip(text_or_empty()).alias("t")).select("doc_id", "t.*")
