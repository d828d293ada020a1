"""Warehouse tables in key ranges: an upsert rewrites the ranges it touches and no others.

A table is cut into ranges of its key.  A version is a list of ranges, each
with its first key, its folder and its rows; ranges that an upsert does not touch keep
the folder of an earlier version.  Data is written first and the list last, as
one file, so a lost job leaves the older version as it was and can be rerun.
One writer per table at a time.

Ranges are listed on the driver and have a file each, so their number is
bounded: beyond it they get longer, whatever length was asked for.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from lisura.session import stored

MANIFEST = "version long, low string, folder string, rows long, schema string"
#: Rows of a range, about; a range is cut once it has twice as many.
RANGE_ROWS = 1_000_000
#: Ranges of a table, about; a table of more rows than these hold has longer ones.
MOST_RANGES = 1_000

Merge = Callable[[DataFrame | None, DataFrame], DataFrame]


def key_text(keys: list[str]) -> Column:
    """The key as one text that ranges are cut by."""
    return F.concat_ws("\u0001", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])


def range_of(key: Column, lows: list[str]) -> Column:
    """Number of the last range whose first key is not above ``key`` (the first range takes all below); binary search."""
    table = F.from_json(F.lit(json.dumps(lows)), "array<string>")
    steps = F.array(*[F.lit(1 << k) for k in range(max(1, (len(lows) - 1).bit_length()) - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step) <= key, at + step).otherwise(at))


def ranges(spark: SparkSession, root: str, name: str) -> list[Row]:
    """Ranges of the newest version by first key; empty before the first write.  One small row per range."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{root}/{name}/_manifest")
        newest = rows.agg(F.max("version").alias("version"))
        return sorted(rows.join(newest, "version", "left_semi").collect(), key=lambda r: r["low"])
    except AnalysisException as error:
        # Nothing was written yet; any other fault is one.
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def _read(spark: SparkSession, listed: list[Row]) -> DataFrame:
    # The schema is in the list: no footers are read, and columns that older ranges lack are null.
    return spark.read.schema(T.StructType.fromJson(json.loads(listed[0]["schema"]))).parquet(*[r["folder"] for r in listed])


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """Newest version of a table, or None before the first write."""
    listed = ranges(spark, root, name)
    return _read(spark, listed) if listed else None


def _cuts(placed: DataFrame, counts: dict[int, int], range_rows: int) -> dict[int, list[str]]:
    """First keys of further ranges, for ranges that have grown to twice the wanted rows."""
    big = {r: -(-n // range_rows) for r, n in counts.items() if n > 2 * range_rows}
    if not big:
        return {}
    grown = placed.where(F.col("_range").isin(*big)).select("_range", "_key")
    parts = grown.repartitionByRange(sum(big.values()), "_range", "_key").groupBy("_range", F.spark_partition_id().alias("_part"))
    found: dict[int, list[str]] = {}
    for r in parts.agg(F.min("_key").alias("low")).orderBy("_range", "low").collect():
        found.setdefault(r["_range"], []).append(r["low"])
    return {r: lows[1:] for r, lows in found.items()}


def _write(rows: DataFrame, keys: list[str], root: str, name: str, version: int, lows: list[str], kept: list[Row], range_rows: int) -> None:
    """Write ``rows``, which lie in the ranges that begin at ``lows``, and list them with ``kept`` as the next version."""
    spark = rows.sparkSession
    key = key_text(keys)
    placed = stored(rows.withColumn("_key", key).withColumn("_range", range_of(F.col("_key"), lows)), f"{root}/{name}/_merged")
    counts = {r["_range"]: r["n"] for r in placed.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values()) + sum(r["rows"] for r in kept)
    cuts = _cuts(placed, counts, max(range_rows, -(-total // MOST_RANGES)))
    if cuts:
        lows = sorted({*lows, *(low for more in cuts.values() for low in more)})
        placed = placed.withColumn("_range", range_of(F.col("_key"), lows))
        counts = {r["_range"]: r["n"] for r in placed.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}
    folder = f"{root}/{name}/v={version}"
    placed.repartition("_range").sortWithinPartitions("_range", "_key").drop("_key").write.mode("overwrite").option(
        "compression", "zstd").partitionBy("_range").parquet(folder)
    _emptied(placed, f"{root}/{name}/_merged")
    schema = rows.schema.json()
    listed = [(version, r["low"], r["folder"], r["rows"], schema) for r in kept]
    listed += [(version, lows[r], f"{folder}/_range={r}", n, schema) for r, n in sorted(counts.items())]
    spark.createDataFrame(listed, MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/{name}/_manifest")


def _emptied(rows: DataFrame, folder: str) -> None:
    """Leave no rows in a folder that only a step between needed."""
    rows.sparkSession.createDataFrame([], rows.schema).write.mode("overwrite").parquet(folder)


def write_table(df: DataFrame, root: str, name: str, keys: list[str], range_rows: int = RANGE_ROWS) -> DataFrame | None:
    """Replace the whole table by the next version and return it; the old one stays readable meanwhile."""
    spark = df.sparkSession
    listed = ranges(spark, root, name)
    _write(df, keys, root, name, listed[0]["version"] + 1 if listed else 1, [""], [], range_rows)
    return read_table(spark, root, name)


def upsert_table(
    incoming: DataFrame, root: str, name: str, keys: list[str], merge: Merge, range_rows: int = RANGE_ROWS
) -> DataFrame | None:
    """The table after merging ``incoming``; only ranges that hold one of its keys are read and rewritten.

    ``merge`` gets the rows of these ranges (None for a new table) and ``incoming``,
    and returns the rows that replace them; keys must not change.
    """
    spark = incoming.sparkSession
    listed = ranges(spark, root, name)
    if not listed:
        _write(merge(None, incoming), keys, root, name, 1, [""], [], range_rows)
        return read_table(spark, root, name)
    incoming = stored(incoming, f"{root}/{name}/_incoming")
    number = range_of(key_text(keys), [r["low"] for r in listed])
    hit = {r[0] for r in incoming.select(number.alias("_range")).distinct().collect()}
    if hit:
        touched = [r for i, r in enumerate(listed) if i in hit]
        kept = [r for i, r in enumerate(listed) if i not in hit]
        merged = merge(_read(spark, touched), incoming)
        _write(merged, keys, root, name, listed[0]["version"] + 1, [r["low"] for r in touched], kept, range_rows)
    _emptied(incoming, f"{root}/{name}/_incoming")
    return read_table(spark, root, name)
