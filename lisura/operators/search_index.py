"""Folded substring search by an index of trigrams, for tables that are searched again and again.

Documents are written in places: ranges of (kind, folded text, id), in which
``slot`` counts up in that order.  Postings say which slots hold a trigram.
They lie in the place of their documents, by trigram and slot, and are written
in parts, so a frequent trigram fills several parts and no task holds all of
it; the task that reads documents writes their postings, which are not dealt
out.  A directory has one row per trigram and place.

Places are listed on the driver and have files of their own, so their number
is bounded: beyond it they get longer, whatever length was asked for.

A query looks up its trigrams in the directory, intersects the slots of the
rarest ones in the places that have all of these, and reads and verifies only
the places that hold a candidate.  Pages are found by counting hits per place,
so only the places of the page are ranked.  Hits are those of ``search``;
queries of one or two characters have no trigram and read all documents.

The folder is listed last, so a lost job leaves the older index in use.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lisura.functions import text as X
from lisura.operators.search import totals_of
from lisura.session import cut_lineage, if_small, stored

DOCUMENTS = "id string, kind string, entityId string, text string, folded string, slot long, place int"
POSTINGS = "gram string, slot long, place int"
DIRECTORY = "gram string, place int, n long"
LISTED = "version long, folder string"
#: Documents of a place, about; postings of a part, at most (or ten for each document of a place, if that is more).
PLACE_ROWS, PART_ROWS = 500_000, 5_000_000
#: Places of an index, about.
MOST_PLACES = 1_000
#: Trigrams of a query whose slots are intersected: the rarest.
RAREST = 3


def write_index(docs: DataFrame, root: str, place_rows: int = PLACE_ROWS, part_rows: int = PART_ROWS) -> None:
    """Index ``docs`` (see ``search_documents``) as the next version below ``root``."""
    spark, folder = docs.sparkSession, f"{root}/{uuid.uuid4()}"
    order = ["kind", "folded", "id"]
    rows = stored(docs.select("id", "kind", "entityId", "text", X.fold("text").alias("folded")), f"{folder}/unsorted")
    n = rows.count()
    places = max(1, min(MOST_PLACES, -(-n // place_rows)))
    (
        rows.repartitionByRange(places, *order).sortWithinPartitions(*order)
        .withColumn("slot", F.monotonically_increasing_id()).withColumn("place", F.spark_partition_id())
        .write.partitionBy("place").parquet(f"{folder}/documents")
    )
    spark.createDataFrame([], rows.schema).write.mode("overwrite").parquet(f"{folder}/unsorted")
    written = spark.read.schema(DOCUMENTS).parquet(f"{folder}/documents")
    grams = F.array_distinct(F.regexp_extract_all("folded", F.lit("(?s)(?=(...))"), F.lit(1)))
    (
        written.select(F.explode(grams).alias("gram"), "slot", "place").sortWithinPartitions("place", "gram", "slot")
        .write.option("maxRecordsPerFile", max(part_rows, 10 * (n // places))).partitionBy("place").parquet(f"{folder}/postings")
    )
    postings = spark.read.schema(POSTINGS).parquet(f"{folder}/postings")
    directory = postings.groupBy("gram", "place").agg(F.count(F.lit(1)).alias("n"))
    directory.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{folder}/directory")
    version = len(_listed(spark, root)) + 1
    spark.createDataFrame([(version, folder)], LISTED).coalesce(1).write.mode("append").parquet(f"{root}/_listed")


def _listed(spark: SparkSession, root: str) -> list[str]:
    """Folders of all versions, oldest first; one small row per version."""
    try:
        return [r["folder"] for r in spark.read.schema(LISTED).parquet(f"{root}/_listed").orderBy("version").collect()]
    except AnalysisException as error:
        # Nothing was written yet; any other fault is one.
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def index_hits(spark: SparkSession, root: str, q: str | None) -> DataFrame:
    """Documents that contain the query, ignoring case and accents, with their place and slot; none for an empty query."""
    folder = _listed(spark, root)[-1]
    docs = spark.read.schema(DOCUMENTS).parquet(f"{folder}/documents")
    nothing = docs.where(F.lit(False))
    if not q:
        return nothing
    folded = spark.range(1).select(X.fold(F.lit(q))).first()[0]
    wanted = {folded[i : i + 3] for i in range(len(folded) - 2)}
    matching = docs.where(F.contains("folded", F.lit(folded)))
    if not wanted:
        return matching
    directory = spark.read.schema(DIRECTORY).parquet(f"{folder}/directory")
    # One small row per trigram of the query.
    found = directory.where(F.col("gram").isin(*wanted)).groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = {r["gram"]: r["n"] for r in found}
    if len(counts) < len(wanted):
        return nothing
    rarest = sorted(counts, key=lambda g: (counts[g], g))[:RAREST]
    full = directory.where(F.col("gram").isin(*rarest)).groupBy("place").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(rarest))
    places = [r["place"] for r in full.collect()]
    if not places:
        return nothing
    postings = spark.read.schema(POSTINGS).parquet(f"{folder}/postings")
    slots = postings.where(F.col("place").isin(*places) & F.col("gram").isin(*rarest)).groupBy("slot", "place").agg(F.count(F.lit(1)).alias("n"))
    slots = cut_lineage(slots.where(F.col("n") == len(rarest)).select("slot", "place"))
    places = [r["place"] for r in slots.select("place").distinct().collect()]
    if not places:
        return nothing
    return matching.where(F.col("place").isin(*places)).join(if_small(slots.select("slot")), "slot", "left_semi")


def index_totals(spark: SparkSession, root: str, q: str | None) -> DataFrame:
    """(kind, total) of matches for each kind, zero included."""
    return totals_of(index_hits(spark, root, q))


def index_page(spark: SparkSession, root: str, q: str | None, skip: int = 0, take: int = 5) -> DataFrame:
    """One page of hits per kind, by folded text and id: the rows of ``search``, only the places of the page being ranked."""
    found = index_hits(spark, root, q)
    before: dict[str, int] = {}
    shown = []
    for r in found.groupBy("kind", "place").agg(F.count(F.lit(1)).alias("n")).orderBy("kind", "place").collect():
        first = before.get(r["kind"], 0)
        before[r["kind"]] = first + r["n"]
        if first < skip + take and first + r["n"] > skip:
            shown.append((r["kind"], r["place"], first))
    starts = spark.createDataFrame(shown, "kind string, place int, first long")
    here = found.where(F.col("place").isin(*[p for _, p, _ in shown])).join(F.broadcast(starts), ["kind", "place"])
    rank = F.row_number().over(W.partitionBy("kind", "place").orderBy("slot")) + F.col("first")
    return here.withColumn("rank", rank).where((F.col("rank") > skip) & (F.col("rank") <= skip + take)).select(
        "id", "kind", "entityId", "text", "rank")
