"""Proportional stratified interleaving: every shard holds each source in the corpus's own mixture.

Rows of a source are ranked in a seeded shuffle.  Rank r of n, plus an offset
of the source in [0, 1), gives the fractional rank (r + offset) / n.  Sorting
all rows by it interleaves the sources evenly, and a cut at equal counts gives
shards whose row counts differ by one at most (law ``rows``).

No window sees a whole source or the whole table: rows are counted per range
of the shuffle key (or of the fractional rank), ranges are summed up in small
tables, and rows are numbered inside their range only.  The number of ranges
follows the number of rows; no result depends on it.

Cases: a null source is a source of its own; a null text has size 16 and the
checksum of no bytes; repeated rows are placed one by one, ordered by id and
checksum; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lisura.llm.common import checkpoint, share

#: Rows of a range of the shuffle key or of the fractional rank, about; a range is numbered in one task.  Ranges at least.
RANGE_ROWS, RANGES = 50_000, 2_048


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) from 52 hashed bits."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 12).cast("double") / float(2**52)


def _before(counts: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Rows in earlier ranges of the same group."""
    earlier = W.partitionBy(*keys).orderBy(by).rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def interleave(docs: DataFrame, shards: int, seed: int = 17, ranges: int | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, source, fraction, shard, slot."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.col("source").cast("string").alias("source"),
    ).withColumn("order", _unit(F.lit(seed), F.col("doc_id"), F.col("text_crc32")))
    rows = checkpoint(rows)
    ranges = ranges or max(RANGES, -(-rows.count() // RANGE_ROWS))
    rows = rows.withColumn("range", F.floor(F.col("order") * ranges).cast("int"))
    # The group key stands for null too, so that plain equality joins work.
    group = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source")))
    rows = rows.withColumn("group", group)
    counts = rows.groupBy("group", "range").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("group").agg(F.sum("n").alias("total"))
    starts = _before(counts, ["group"], "range").drop("n").join(totals, "group")
    inside = W.partitionBy("group", "range").orderBy("order", "doc_id", "text_crc32", "size")
    ranked = (
        rows.withColumn("at", F.row_number().over(inside) - 1)
        .join(starts, ["group", "range"])
        .withColumn("fraction", (F.col("before") + F.col("at") + _unit(F.lit(seed), F.col("group"))) / F.col("total"))
        .withColumn("slice", F.least(F.floor(F.col("fraction") * ranges), F.lit(ranges - 1)).cast("int"))
        .select("doc_id", "size", "text_crc32", "source", "group", "order", "fraction", "slice")
    )
    ranked = checkpoint(ranked)
    # One row per slice, that is per so many thousand rows: a single window sums them up.
    slices = ranked.groupBy("slice").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.lit(0))
    slices = _before(slices, ["all"], "slice").withColumn("rows", F.sum("n").over(W.partitionBy("all")))
    slices = checkpoint(slices.select("slice", "before", "rows"))
    inside = W.partitionBy("slice").orderBy("fraction", "group", "order", "doc_id", "text_crc32", "size")
    placed = (
        ranked.withColumn("at", F.row_number().over(inside) - 1)
        .join(share(slices), "slice")
        .withColumn("place", F.col("before") + F.col("at"))
        # Shard s holds the places from ceil(s * rows / shards) on.
        .withColumn("shard", F.expr(f"place * {shards} div rows").cast("int"))
        .withColumn("slot", F.expr(f"place - (shard * rows + {shards} - 1) div {shards}"))
    )
    return placed.select("doc_id", "size", "text_crc32", "source", "fraction", "shard", "slot")
