"""Queries ``opN_<name>``: each operator on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lisura.llm import (
    block_search,
    decontamination,
    filter_audit,
    language,
    lm_score,
    manifest,
    ngram_join,
    packing,
    secrets,
    sharding,
    simhash_index,
    stages,
    toxicity,
    url_filter,
)
from lisura.llm.common import fold, table
from lisura.llm.oracles import ORACLES

VOCABULARY = stages.VOCABULARY


def op1_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    found = ngram_join.near_copies(table(spark, folder, "documents"), n=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


def op2_block_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return block_search.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = stages.toxicity_model(docs, table(spark, folder, "labels"))
    scored = toxicity.score(docs, model, ["doc_id"])
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))


def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(table(spark, folder, "documents"))


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Documents (host: their source; no markup or address) and pages in one judgement."""
    docs, pages = table(spark, folder, "documents"), table(spark, folder, "pages")
    taught = docs.where(fold(F.col("doc_id"), 5) != 0).select(F.col("doc_id").alias("id"), "text", "lang")
    languages, model = language.train(taught)
    none = F.lit(None).cast("string")
    texts = docs.select(
        F.lit("documents").alias("table"), "doc_id", F.lit(None).cast("long").alias("page_id"), "text",
        none.alias("declared"), none.alias("address"), F.concat(F.lit("source "), "source").alias("host"),
    )
    raw = language.page_rows(pages).select(
        F.lit("pages").alias("table"), F.lit(None).cast("long").alias("doc_id"), "page_id", "text", "declared", "address", "host")
    return language.identify(texts.unionByName(raw), languages, model, ["table", "doc_id", "page_id"])


#: The rules of the query.
URL_RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]


def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    judged = url_filter.judge(table(spark, folder, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "host_words", "block_odds")


def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.interleave(table(spark, folder, "documents"), shards=40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source",
    )


def op10_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = fold(F.col("doc_id"), 7) == 2
    scored = lm_score.score(docs, docs.where(~held_out), ["doc_id"])
    return scored.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_index.near_copies(table(spark, folder, "documents")).select("doc_id", "fingerprint", "component_id")


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    counts = filter_audit.mask_counts(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return filter_audit.audit(counts)


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    made = manifest.manifest(table(spark, folder, "documents"))
    proof, end = manifest.proof_hash(F.col("path")), manifest.folded(F.col("tampered"), F.col("path"))
    return made.select(
        "doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), end.alias("folded_root"), (end == F.col("root")).alias("verified"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_ngram_jaccard_join, op2_block_search, op3_toxicity, op4_packing, op5_secret_scan, op6_decontamination, op7_language_id, op8_url_filter, op9_sharding, op10_lm_score,
        op11_simhash_dedup, op12_filter_audit, op13_merkle_manifest,
    )
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
