"""Merkle manifest of a dataset: a hash tree per language, one root over all, and a proof for every row.

Rows are numbered within their language, and every eight consecutive nodes
have one parent.  Per level, lag and lead columns of the fixed offsets 1 to 7,
masked by a node's slot (number modulo eight) and by the length of its run,
supply its siblings; the first child of a run hashes the parent.  Levels are
read again from the top down to hand each node its path: the siblings on the
left and right, level by level.

Windows never see a whole language: they run over blocks of ``BLOCK`` nodes,
and as runs end where blocks end, no sibling is in another block.  Numbers come
from a range partitioning by (language, doc_id): the place within a range, less
the language's first place there, plus its rows in earlier ranges.  A language
or an id that a third of all rows share is spread over ranges like any other.

Cases: null fields are hashed as ``-``, which no value is; a null language is
first, apart from the empty one; rows with a null id come first in their
language; rows that share an id follow in the order of their leaves, and equal
rows are leaves of their own with equal hashes; a null text or id is never
tampered with; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lisura.llm.common import ascii_lower, checkpoint, share

#: Children of a node, nodes that one window sees, rows of a range at most (about).
CHILDREN, BLOCK, RANGE_ROWS = 8, 8**4, 1_000_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 of the fields in order, each with its length in bytes."""
    def written(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return sha(*[written(fields[f]) for f in FIELDS])


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, the place in the group from 0 on, and ``n``, the rows of the group.

    ``rows`` is read twice, so it should be checkpointed.  Rows that tie are
    spread by their place in the input.
    """
    spark = rows.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    keys = [group, *order, "tie"]
    placed = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(ranges, *keys)
    placed = checkpoint(placed.sortWithinPartitions(*keys).drop("tie").withColumn("at", F.monotonically_increasing_id()))
    # The upper bits of "at" number the range, the lower 33 the place in it.
    placed = placed.withColumn("range", F.shiftrightunsigned("at", 33))
    counts = checkpoint(placed.groupBy(group, "range").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows")))
    earlier = W.partitionBy(group).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(
        group, "range", (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("rows").over(W.partitionBy(group)).alias("n"))
    found = placed.join(share(checkpoint(starts)), [group, "range"])
    return found.withColumn("idx", F.col("at") + F.col("shift")).drop("at", "range", "shift")


def _siblings(nodes: DataFrame) -> DataFrame:
    """``nodes`` (key, idx, n, digest) with the hashes of the siblings to the left and to the right, joined."""
    near = W.partitionBy("key", F.expr(f"idx div {BLOCK}")).orderBy("idx")
    slot = F.col("idx") % CHILDREN
    run = F.least(F.lit(CHILDREN), F.col("n") - F.col("idx") + slot)
    none = F.lit("")
    left = [F.when(slot >= k, F.lag("digest", k).over(near)).otherwise(none) for k in range(CHILDREN - 1, 0, -1)]
    right = [F.when(slot + k < run, F.lead("digest", k).over(near)).otherwise(none) for k in range(1, CHILDREN)]
    return nodes.withColumn("left", F.concat(*left)).withColumn("right", F.concat(*right))


def climb(leaves: DataFrame) -> list[DataFrame]:
    """Levels of (key, idx, n, digest), leaves first; a level holds the groups that are not yet down to one node."""
    levels = [leaves]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        first = _siblings(levels[-1].where(F.col("n") > 1)).where(F.col("idx") % CHILDREN == 0)
        levels.append(checkpoint(first.select(
            "key", F.expr(f"idx div {CHILDREN}").alias("idx"), F.expr(f"(n + {CHILDREN - 1}) div {CHILDREN}").alias("n"),
            sha(F.col("digest"), F.col("right")).alias("digest"))))
        most = -(-most // CHILDREN)
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """(key, digest) of each group's last node."""
    done = [level.where(F.col("n") == 1).select("key", "digest") for level in levels]
    out = done[0]
    for other in done[1:]:
        out = out.unionByName(other)
    return out


def descend(levels: list[DataFrame], above: DataFrame, leaves: DataFrame) -> DataFrame:
    """``leaves`` (the lowest level, with any other columns) with ``path`` and the columns that ``above`` (key, path, ...) has.

    A path holds (left, right) of every level up to the root.
    """
    paths = None
    for at in range(len(levels) - 1, -1, -1):
        level = levels[at] if at else leaves
        found = level.where(F.col("n") == 1).join(above, "key")
        if paths is not None:
            up = paths.select("key", F.col("idx").alias("parent"), *above.columns[1:])
            several = _siblings(level.where(F.col("n") > 1)).withColumn("parent", F.expr(f"idx div {CHILDREN}"))
            several = several.join(up, ["key", "parent"]).withColumn(
                "path", F.concat(F.array(F.struct("left", "right")), F.col("path"))).drop("left", "right", "parent")
            found = found.unionByName(several)
        paths = found
    return paths


def manifest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, lang, leaf, subroot, root, path, tampered (the leaf of the changed row)."""
    fields = {f: F.col(f) for f in FIELDS}
    text = F.col("text").cast("string")
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    other = leaf_hash(fields | {"text": ascii_lower(text)})
    leaf = leaf_hash(fields)
    rows = docs.select(
        "doc_id", F.col("lang").cast("string").alias("lang"), leaf.alias("digest"), F.when(changed, other).alias("tampered"))
    # The key orders like the language, with null first and apart from the empty one.
    key = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("lang")))
    rows = checkpoint(rows.withColumn("key", key))
    leaves = checkpoint(numbered(rows, "key", ["doc_id", "digest"]))
    levels = climb(leaves.select("key", "idx", "n", "digest"))
    subroots = checkpoint(tops(levels).withColumnRenamed("key", "lang_key").withColumn("key", F.lit("")))
    ranked = checkpoint(numbered(subroots, "key", ["lang_key"]))
    upper = climb(ranked.select("key", "idx", "n", "digest"))
    start = F.array().cast("array<struct<left:string,right:string>>")
    crown = tops(upper).select("key", start.alias("path"), F.col("digest").alias("root"))
    above = checkpoint(descend(upper, crown, ranked).select(
        F.col("lang_key").alias("key"), "path", F.col("digest").alias("subroot"), "root"))
    found = descend(levels, above, leaves)
    return found.select(
        "doc_id", "lang", F.col("digest").alias("leaf"), "subroot", "root", "path", F.coalesce("tampered", "digest").alias("tampered"))


def proof_hash(path: Column) -> Column:
    """SHA-256 of all siblings of a path."""
    return sha(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of a path."""
    return F.aggregate(path, leaf, lambda node, x: sha(x["left"], node, x["right"]))
