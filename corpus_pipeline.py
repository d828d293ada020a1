"""Corpus cleaning from documents to packed training windows, one stage after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lisura.llm import stages

#: (name, function); each function takes (spark, docs, folder of the tables).
STAGES = [
    ("toxicity", stages.drop_toxic),
    ("near_duplicates", stages.drop_near_copies),
    ("decontamination", stages.drop_contaminated),
    ("secrets", stages.mask_secrets),
    ("packing", stages.pack_windows),
]

#: The first stage scores with a trained model, which SQL cannot express; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
