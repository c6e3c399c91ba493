"""Secret scans with an incremental blob ledger, in DataFrame functions alone.

Every version of every file is a blob, named by the SHA-256 of its content. The ledger says which
blobs were scanned under which version of the rules, and what was found. A scan takes only the
pairs of blob and rule version that the ledger lacks, and findings go back to all paths that hold
the blob.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunestrata.llm.common import text_or_empty
from tunestrata.llm.ledger import Ledger, digests, paths_with, unseen

# The base kinds, in the order in which they are listed.
ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
BASE: dict[str, tuple[str, int, int]] = {  # kind: pattern, group that has a least length, that length
    "assign": (ASSIGN, 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),  # the same matches as of runs with their short ones dropped
}
#: Kinds the scan adds: key blocks and tokens with a prefix of their own.
ADDED: dict[str, tuple[str, int, int]] = {
    "pem": (r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----", 0, 0),
    "forge": (r"gh[pousr]_[A-Za-z0-9]{36}", 0, 0),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
}
KINDS = {**BASE, **ADDED}
#: What a text must hold for a pattern to be worth a look; a search for fixed characters is cheap.
_SIGN = {"access": "AKIA", "pem": "-----BEGIN ", "forge": "gh", "jwt": "eyJ"}
#: The rules name their version themselves: another pattern, kind or length is another version.
VERSION = hashlib.sha256(repr(KINDS).encode()).hexdigest()
FINDINGS = (
    "digest binary, version string, n_assign bigint, n_access bigint, n_hex bigint, "
    "base_spans string, spans string"
)
_MATCH = "array<struct<kind:int,i:int,gap:bigint,full:bigint,checked:bigint>>"


def _lengths(parts: Column) -> Column:
    return F.transform(parts, lambda part: F.length(part).cast("bigint"))


def _matches(kind: str) -> Column:
    """Of every match, in order: the length of the text before it since the last one, its own, and
    that of the group with a least length. Behind the last match comes the rest of the text."""
    pattern, group, _ = KINDS[kind]
    full = _lengths(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    checked = full if group == 0 else _lengths(F.regexp_extract_all("text", F.lit(pattern), F.lit(group)))
    parts = F.arrays_zip(_lengths(F.split("text", pattern, -1)).alias("gap"), full.alias("full"), checked.alias("checked"))
    place = list(KINDS).index(kind)
    listed = F.transform(
        parts, lambda m, i: F.struct(F.lit(place).alias("kind"), i.alias("i"), m["gap"].alias("gap"), m["full"].alias("full"), m["checked"].alias("checked"))
    )
    worth = F.col("text").rlike(pattern)
    if kind in _SIGN:
        worth = F.col("text").contains(_SIGN[kind]) & worth
    return F.when(worth, listed.cast(_MATCH)).otherwise(F.array().cast(_MATCH))


def _joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed."""
    names = F.array(*(F.lit(k) for k in KINDS))
    words = F.transform(
        F.array_sort(spans),
        lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string")),
    )
    return F.array_join(words, ",")


def scan(blobs: DataFrame, version: str = VERSION) -> DataFrame:
    """Findings of ``digest, text`` rows, one row a digest: counts of the base kinds, base spans, all spans.

    The text between the matches and the matches themselves, put one after the other, are the text;
    so lengths added up to a match give its start, in code points. They are added up over one row a
    match, in time that grows with the matches; a row of no kind stands for the blob itself.
    """
    blob = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("i"), *(F.lit(0).cast("bigint").alias(c) for c in ("gap", "full", "checked"))))
    found = blobs.select("digest", F.explode(F.concat(blob.cast(_MATCH), *(_matches(kind) for kind in KINDS))).alias("m"))
    found = found.select("digest", "m.*").repartition("digest").dropDuplicates(["digest", "kind", "i"])
    before = Window.partitionBy("digest", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.sum(F.col("gap") + F.coalesce("full", F.lit(0))).over(before)
    least = F.element_at(F.array(*(F.lit(KINDS[k][2]) for k in KINDS)), F.col("kind") + 1)
    fits = (F.col("kind") >= 0) & (F.col("checked") >= F.when(F.col("kind") >= 0, least))
    placed = found.withColumn("stop", stop).withColumns({"start": F.col("stop") - F.col("full"), "fits": F.coalesce(fits, F.lit(False))})
    span, base = F.struct("start", "kind", "stop"), F.col("kind") < len(BASE)
    return placed.groupBy("digest").agg(
        F.lit(version).alias("version"),
        *(F.count_if(F.col("fits") & (F.col("kind") == i)).alias(f"n_{k}") for i, k in enumerate(BASE)),
        _joined(F.collect_list(F.when(F.col("fits") & base, span))).alias("base_spans"),
        _joined(F.collect_list(F.when(F.col("fits"), span))).alias("spans"),
    )


def secret_scan(docs: DataFrame, findings: Ledger, version: str = VERSION) -> DataFrame:
    """Scan what the ledger lacks; return one row per row of ``docs``:
    ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``.

    A null text counts as empty and has no span. Rows without an id and repeated rows stay. Other
    columns are ignored. An empty table gives an empty result. Raises if the ledger has lost a blob.
    """
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    paths = digests(texts)
    findings.append(scan(unseen(texts, paths, findings.read(), version), version))
    columns = ("n_assign", "n_access", "n_hex", "base_spans", "spans")
    return paths_with(paths, findings.read().where(F.col("version") == version), columns).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans"
    )
