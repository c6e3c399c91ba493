"""The operators applied to their tables with production settings, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunestrata.llm import (
    byte_bpe,
    conversations,
    cover_tree,
    oracles,
    packing,
    pii,
    quality,
    repeats,
    rules,
    secrets,
    simhash,
    spelling,
    token_counts,
    warc,
)
from tunestrata.llm.common import read, ship_package
from tunestrata.llm.ledger import Ledger
from tunestrata.session import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def enter(fn: Callable[[SparkSession, str], DataFrame]):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return enter


@query()
def op1_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(read(spark, sf_dir, "documents"))


@query()
def op2_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer)


@query(oracles.RULE_LEDGER)
def op3_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(read(spark, sf_dir, "documents")).drop("n_lines")


@query(oracles.RULE_POLICIES)
def rule_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.policies_compared(read(spark, sf_dir, "documents"))


@query(oracles.SECRET_LEDGER)
def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = Ledger(spark, shared_path(spark, "secret-ledger"), secrets.FINDINGS)
    return secrets.secret_scan(read(spark, sf_dir, "documents"), findings)


@query(oracles.LEDGER_RUNS)
def secret_ledger_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three scans with one ledger: documents, documents and pages, all again; blobs that each worked on."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    findings, before, runs = Ledger(spark, shared_path(spark, "ledger-runs"), secrets.FINDINGS), 0, []
    for run, paths in enumerate((documents, documents.union(pages), documents.union(pages)), 1):
        found = secrets.secret_scan(paths, findings)
        after = findings.read().count()
        runs.append(
            found.agg(F.count(F.lit(1)).alias("n_paths"), F.sum("n_hex").alias("n_hex"), F.count_if(F.col("spans") != "").alias("n_with_secrets"))
            .withColumns({"run": F.lit(run), "n_scanned": F.lit(after - before).cast("bigint")})
        )
        before = after
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


@query(oracles.WARC_CHUNKS)
def op5_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(spark, read(spark, sf_dir, "pages"))


@query()
def op6_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query()
def op7_token_digest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = Ledger(spark, shared_path(spark, "token-counts"), token_counts.COUNTS)
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.token_counts(read(spark, sf_dir, "documents"), cache, tokenizer)


@query()
def op8_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read(spark, sf_dir, "documents"))


@query(oracles.COVER_TREE)
def op9_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.vector_groups(read(spark, sf_dir, "embeddings"))


@query(oracles.TURNED_VECTORS)
def turned_vector_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector beside itself three times as long and turned twice, a little further each time: the
    second turn links with the first, and seldom with the vector itself."""
    e = F.col("embedding").cast("array<double>")

    def turned(rate: float) -> Column:
        return F.transform(e, lambda x, i: x + rate * F.get(e, (i + 1) % F.size(e)))

    versions = F.array(e, turned(0.25), turned(0.45), F.transform(e, lambda x: 3 * x))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(versions).alias("k", "embedding"))
    return cover_tree.vector_groups(rows.select((F.col("vec_id") * 4 + F.col("k")).alias("vec_id"), "embedding"))


@query()
def op10_tiktoken_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank_file = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(read(spark, sf_dir, "documents"), rank_file, public_tokenizers.PATTERN)


@query()
def op11_prefix_doubling_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(read(spark, sf_dir, "conversations"))


@query()
def op12_prefix_doubling_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(read(spark, sf_dir, "documents"))


@query()
def op13_sorted_list_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents"))
