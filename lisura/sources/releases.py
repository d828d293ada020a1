"""Open-contracting releases, flattened, and their cross-check with purchases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lisura.functions import text as X

PREFIX = "ocds-914jxj-"
SCHEMA = T.StructType([
    T.StructField("ocid", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("tag", T.ArrayType(T.StringType())),
    T.StructField("tender", T.StructType([
        T.StructField("id", T.StringType()), T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType())])),
    T.StructField("awards", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
])


def read_releases(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return flatten_releases(spark.read.schema(SCHEMA).json(path))


def flatten_releases(raw: DataFrame) -> DataFrame:
    """(ocid, id, date, tag, tender_id, tender_title, has_tender, has_awards, schema_ok)."""
    def filled(name: str):
        return F.coalesce(F.col(name), F.lit("")) != ""

    return raw.select(
        X.text_or_empty("ocid").alias("ocid"), X.text_or_empty("id").alias("id"), X.text_or_empty("date").alias("date"),
        F.coalesce(F.array_join("tag", ","), F.lit("")).alias("tag"),
        X.text_or_empty("tender.id").alias("tender_id"),
        F.coalesce(F.nullif(F.col("tender.title"), F.lit("")), F.col("tender.description"), F.lit("")).alias("tender_title"),
        F.col("tender").isNotNull().alias("has_tender"),
        (F.coalesce(F.size("awards"), F.lit(0)) > 0).alias("has_awards"),
        (filled("ocid") & filled("id") & filled("date") & (F.coalesce(F.size("tag"), F.lit(0)) > 0)).alias("schema_ok"),
    )


def matching_releases(releases: DataFrame, purchases: DataFrame) -> DataFrame:
    """Releases whose ocid is, or ends with, a known contract id.

    Any suffix counts, so each ocid lists its own suffixes and the test is an
    equality semi join; an ocid is short, so this adds a few dozen rows each,
    and nothing is compared with every purchase.
    """
    suffixes = F.transform(F.sequence(F.lit(1), F.length("ocid")), lambda i: F.substring("ocid", i, F.length("ocid")))
    ids = purchases.select(F.col("pncp_id").alias("_s")).where(F.coalesce("_s", F.lit("")) != "").distinct()
    tails = releases.select("ocid").where(F.col("ocid") != "").distinct().select("ocid", F.explode(suffixes).alias("_s"))
    hit = tails.join(ids, "_s", "left_semi").select("ocid").distinct()
    return releases.join(hit, "ocid", "left_semi")


def crosscheck(releases: DataFrame, purchases: DataFrame) -> DataFrame:
    """One row: distinct ids on both sides, matches, and schema counts."""
    ids = purchases.select(F.col("pncp_id").alias("id")).where(F.coalesce("id", F.lit("")) != "").distinct()
    ocids = releases.select("ocid").where(F.col("ocid") != "").distinct()
    stripped = F.when(F.col("ocid").startswith(PREFIX), F.substring("ocid", F.lit(len(PREFIX) + 1), F.length("ocid")))
    known = ocids.select(F.explode(F.array_distinct(F.array("ocid", F.coalesce(stripped, F.col("ocid"))))).alias("id")).distinct()
    parts = {
        "ocds_n": ocids.agg(F.count(F.lit(1)).alias("v")),
        "purchases_n": ids.agg(F.count(F.lit(1)).alias("v")),
        "matched_n": ids.join(known, "id", "left_semi").agg(F.count(F.lit(1)).alias("v")),
        "schema_ok_n": releases.agg(F.count_if("schema_ok").alias("v")),
        "schema_bad_n": releases.agg(F.count_if(~F.col("schema_ok")).alias("v")),
    }
    stacked = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("k"), "v")
        stacked = one if stacked is None else stacked.unionByName(one)
    return stacked.agg(*[F.max(F.when(F.col("k") == name, F.col("v"))).alias(name) for name in parts])
