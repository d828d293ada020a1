"""Stages of the corpus pipeline: (spark, docs, folder) in, DataFrame out.

Each stage reads all rows it is given.  All but the last return the columns of
``docs``, whatever they are; a stage names its own columns so that no column
of ``docs`` can clash with them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lisura.llm import decontamination, ngram_join, packing, secrets, toxicity
from lisura.llm.common import checkpoint, fold, share, table

VOCABULARY = "byte_bpe_50k.json"


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Machine:
    """Trained on the labelled documents whose id is not in the held-out fold."""
    known = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    return toxicity.train(texts.where(fold(F.col("id"), 5) != 0), known.where(fold(F.col("id"), 5) != 0))


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that score below one half; null and empty texts stay."""
    model = toxicity_model(docs, table(spark, folder, "labels"))
    held = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    scored = toxicity.score(held, model, ["row"])
    empty = F.coalesce(F.col("row.text").cast("string"), F.lit("")) == ""
    return scored.where(empty | (F.col("score") < 0.5)).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8), the document with the smallest id.

    Documents without words stay.  Null ids come last.  Of rows that repeat
    both id and text, one stays, chosen by a hash of the whole row.
    """
    found = ngram_join.near_copies(docs, n=5, percent=80)
    ident = [F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("text_hash")]
    counted = found.groupBy("group_id", *ident).agg(F.count(F.lit(1)).alias("rows"))
    counted = checkpoint(counted)
    first = counted.where(F.col("group_id").isNotNull()).groupBy("group_id").agg(F.min(F.struct("none", "id", "text_hash")).alias("kept"))
    key = ["none", "id", "text_hash"]
    # What goes, and what stays but stands there more than once, is little; the rest of the rows is not shuffled.
    kept = first.select("kept.*", F.lit(True).alias("stays"))
    judged = checkpoint(counted.join(kept, key, "left").select(
        *key, (F.col("stays").isNull() & F.col("group_id").isNotNull()).alias("goes"), (F.col("rows") > 1).alias("again")))
    rows = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").isNull().alias("none"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), ngram_join.text_hash(F.col("text")).alias("text_hash"),
    )
    special = share(checkpoint(judged.where(F.col("goes") | F.col("again")).select(key)))
    again = share(checkpoint(judged.where(~F.col("goes") & F.col("again")).select(key)))
    once = rows.join(special, key, "left_anti").select("row")
    # By a hash, as some columns (maps) have no order of their own.
    first_row = F.min_by("row", F.sha2(F.to_json("row"), 256)).alias("row")
    one = rows.join(again, key, "left_semi").groupBy(*key).agg(first_row).select("row")
    return once.unionByName(one).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a benchmark passage; rows that share an id, or have none, are told apart by their text."""
    found = decontamination.contaminated_texts(
        docs.select("doc_id", "text"), table(spark, folder, "benchmark")
    )
    key = ["none", "id", "text_hash"]
    hit = share(checkpoint(found.select(
        F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("hash").alias("text_hash")).distinct()))
    rows = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").isNull().alias("none"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), decontamination.text_hash(F.col("text")).alias("text_hash"),
    )
    return rows.join(hit, key, "left_anti").select("row.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every document, its secrets masked; ``n_chars`` follows the new text."""
    out = secrets.masked(docs)
    changed = {c: F.char_length("text").cast(t).alias(c) for c, t in docs.dtypes if c == "n_chars"}
    counted = [F.when(F.col("n_chars").isNotNull(), changed[c]).alias(c) if c in changed else F.col(c) for c in docs.columns]
    return out.select(*counted)


def pack_windows(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of documents in training windows."""
    return packing.pack(docs, public_tokenizers.path(VOCABULARY))
