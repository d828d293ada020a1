"""Audit of how filters interact: what every order of them removes at every step.

Each document has a mask of the filters it fails, and only counts per (part,
mask) are needed afterwards.  In an order, a document goes at its first failing
filter.  Orders that begin alike have consecutive lexicographic ranks (a rank
is read off the Lehmer code of the beginning), so the orders in which a mask
goes at a step form a few intervals of ranks.  Its counts are added where an
interval begins and subtracted where it ends; running sums over the ranks give
the totals of all orders at once, without simulating one.

A copy is a document whose whole text (its SHA-256; null counts as empty)
occurs under a smaller doc_id.  Rows are first counted per (doc_id, text,
part), then per (text, part), both with map-side combine, so a text that a
third of all rows share meets as one row per part.

Cases: a null text is empty and has no words; a null part is the empty string,
like a part of that name; null ids come after all others and equal each other,
so rows that repeat id and text are copies of a smaller id only; of several
labels of one id, any 1 counts, and null labels or ids count nothing; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lisura.llm.common import BLANKS, UPPER

#: Limits of the filters A to D (E asks for copies).
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 100, 80, 10, "[#$%&*|]"
LETTERS = "ABCDE"
COUNTS = ("docs", "good", "toxic")


def intervals(n: int) -> Iterator[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank after the last) of the orders in which a mask of ``n`` filters goes at a step."""

    def begin(mask: int, used: int, step: int, rank: int) -> Iterator[tuple[int, int, int, int]]:
        width, place = factorial(n - step), 0
        for f in range(n):
            if used >> f & 1:
                continue
            first = rank + place * width  # one digit of the Lehmer code: how many unused filters come before
            place += 1
            if mask >> f & 1:
                yield mask, step, first, first + width
            else:
                yield from begin(mask, used | 1 << f, step + 1, first)

    for mask in range(1, 1 << n):
        yield from begin(mask, 0, 1, 0)


def text_flags(text: Column) -> Column:
    """Bits of the filters A to D for a whole text."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))
    count, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    length = F.char_length(text).cast("long")
    capitals = length - F.char_length(F.translate(text, UPPER, ""))
    failed = (
        count < MIN_WORDS,
        100 * distinct < DISTINCT_PERCENT * count,
        100 * capitals > CAPITAL_PERCENT * length,
        text.rlike(SYMBOLS),
    )
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failed)), F.lit(0)).cast("int")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, docs, good, toxic): documents by language and failed filters."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        text_flags(text).alias("flags"),
    )
    rows = rows.groupBy("id", "part", "digest", "flags").agg(F.count(F.lit(1)).alias("docs"))
    known = labels.select(
        F.col("doc_id").cast("long").alias("id"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int").alias("good"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int").alias("toxic"),
    ).where(F.col("id").isNotNull()).groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    # Rows without id have no label; their texts keep them apart in the join.
    rows = rows.withColumn("spread", F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long")))
    rows = rows.join(known.withColumn("spread", F.lit(0).cast("long")), ["id", "spread"], "left").select(
        F.col("id").isNull().alias("none"), "id", "part", "digest", "flags", "docs",
        (F.col("docs") * F.coalesce("good", F.lit(0))).alias("good"), (F.col("docs") * F.coalesce("toxic", F.lit(0))).alias("toxic"))
    texts = rows.groupBy("digest", "part", "flags").agg(
        *[F.sum(c).alias(c) for c in COUNTS], F.min(F.struct("none", "id", *COUNTS)).alias("first"))
    # One row per part here, however often a text occurs.
    own = F.struct("first.none", "first.id")
    least = F.min(own).over(W.partitionBy("digest"))
    texts = texts.withColumn("leads", own.eqNullSafe(least))
    first = {c: F.when(F.col("leads"), F.col(f"first.{c}")).otherwise(F.lit(0)) for c in COUNTS}
    copy = 1 << LETTERS.index("E")
    halves = F.array(
        F.struct(F.col("flags").alias("mask"), *[first[c].alias(c) for c in COUNTS]),
        F.struct((F.col("flags") + copy).alias("mask"), *[(F.col(c) - first[c]).alias(c) for c in COUNTS]),
    )
    return (
        texts.select("part", F.explode(halves).alias("h")).select("part", "h.*").where(F.col("docs") > 0)
        .groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in COUNTS])
    )


def audit(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order of the filters and step, from (part, mask, docs, good, toxic).

    Bit k of a mask stands for ``letters[k]``.  The tables of intervals and
    orders depend on the number of filters only.
    """
    spark, n = counts.sparkSession, len(letters)
    ranks = factorial(n)
    edges = spark.createDataFrame(
        [(m, s, r, sign) for m, s, first, after in intervals(n) for r, sign in ((first, 1), (after, -1))],
        "mask int, step int, rank int, sign int")
    orders = spark.createDataFrame(
        [(r, "".join(p)) for r, p in enumerate(permutations(letters))], "rank int, filter_order string")
    fails = [F.sum(F.when(F.col("mask").bitwiseAND(1 << k) > 0, F.col("docs")).otherwise(0)) for k in range(n)]
    alone = [F.sum(F.when(F.col("mask") == 1 << k, F.col("docs")).otherwise(0)) for k in range(n)]
    parts = counts.groupBy("part").agg(
        F.sum("docs").alias("total"), F.array(*fails).alias("fails"), F.array(*alone).alias("alone"))
    # Every part has a row for each rank and step, with or without an interval's end there.
    grid = parts.select("part", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))).alias("rank")).select(
        "part", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"), "rank", *[F.lit(0).cast("long").alias(c) for c in COUNTS])
    changes = counts.join(F.broadcast(edges), "mask").where(F.col("rank") < ranks).select(
        "part", "step", "rank", *[(F.col("sign") * F.col(c)).alias(c) for c in COUNTS])
    changes = grid.unionByName(changes).groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in COUNTS])
    running = W.partitionBy("part", "step").orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    gone = changes.select("part", "step", "rank", *[F.sum(c).over(running).alias(c) for c in COUNTS])
    gone = gone.join(F.broadcast(orders), "rank").join(parts, "part")
    letter = F.expr("substring(filter_order, step, 1)")
    at = F.instr(F.lit(letters), letter) - 1
    steps = W.partitionBy("part", "rank").orderBy("step").rowsBetween(W.unboundedPreceding, W.currentRow)
    return gone.select(
        "part", "filter_order", "step",
        (F.col("total") - F.sum("docs").over(steps)).alias("kept"),
        F.col("docs").alias("removed"),
        (F.get("fails", at) - F.col("docs")).alias("redundant"),
        F.get("alone", at).alias("unique_fails"),
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        F.sum("docs").over(W.partitionBy("part", letter)).alias("shapley"),
    )
