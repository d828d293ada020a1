"""Exact group statistics that never put a whole group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _bin(v: Column) -> Column:
    """Monotone logarithmic bin: sixteen bins per doubling, around 2,000 in all."""
    d = v.cast("double")
    size = F.floor(F.log2(F.abs(d) * 1e6 + 1) * 16).cast("int") + 1
    return F.when(d < 0, -size).when(d > 0, size).otherwise(F.lit(0))


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, _v, _n): how often each value stands in each group; nulls are left out."""
    rows = df.select(*keys, F.col(value).alias("_v"))
    for c in (*keys, "_v"):
        rows = rows.where(F.col(c).isNotNull())
    return rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))


def group_median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """One row per key group: ``n`` and the exact median (mean of the middle two)."""
    return median_of_counts(value_counts(df, keys, value), keys, name)


def median_of_counts(counted: DataFrame, keys: list[str], name: str = "median") -> DataFrame:
    """The same from a table of (keys, _v, _n), one row per distinct value.

    1. count per (key, bin) and find, by a running sum over bins, the one or
       two bins holding the middle ranks;
    2. rank only the distinct values inside those bins.

    A key holding a third of all rows is therefore spread over as many tasks
    as it has distinct values; the widest group any task sees is the distinct
    values of one bin (4% of the price scale), and for step 1 the bins of one
    key.  Rows with a null key or value are left out.
    """
    # The filter a join would infer is written out, so that both uses of
    # ``counts`` plan to the same exchange and it runs once.
    counts = counted.withColumn("_b", _bin(F.col("_v"))).where(F.col("_b").isNotNull())
    ordered = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    bins = (
        counts.groupBy(*keys, "_b")
        .agg(F.sum("_n").alias("_bn"))
        .withColumn("_upto", F.sum("_bn").over(ordered))
        .withColumn("n", F.sum("_bn").over(W.partitionBy(*keys)))
        .withColumn("_lo", F.expr("(n + 1) div 2"))
        .withColumn("_hi", F.expr("(n + 2) div 2"))
        .withColumn("_before", F.col("_upto") - F.col("_bn"))
        .where(
            ((F.col("_before") < F.col("_lo")) & (F.col("_lo") <= F.col("_upto")))
            | ((F.col("_before") < F.col("_hi")) & (F.col("_hi") <= F.col("_upto")))
        )
    )
    inside = W.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = (
        counts.join(bins, [*keys, "_b"])
        .withColumn("_last", F.col("_before") + F.sum("_n").over(inside))
        .withColumn("_first", F.col("_last") - F.col("_n"))
    )

    def at(rank: str) -> Column:
        return F.max(F.when((F.col("_first") < F.col(rank)) & (F.col(rank) <= F.col("_last")), F.col("_v")))

    return (
        ranked.groupBy(*keys)
        .agg(F.max("n").alias("n"), at("_lo").alias("_a"), at("_hi").alias("_z"))
        .select(*keys, "n", ((F.col("_a") + F.col("_z")) / 2).alias(name))
    )


def keep_latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the greatest by ``order``.  A plain partial aggregate."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)) if order else F.max(F.struct(*rest))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the least by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)) if order else F.min(F.struct(*rest))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def pairs_within(
    rows: DataFrame, group: list[str], member: str, block: int = 2000, carry: list[str] | None = None
) -> DataFrame:
    """Every unordered pair of distinct members of a group, as left < right.

    The pairs are the wanted result, so their number cannot be reduced; what
    is avoided is one task holding a big group.  Members are spread over
    ``ceil(n / block)`` blocks and joined block against block on an equality
    key, so a task sees at most two blocks of one group.
    """
    carry = carry or []
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > 1)
    spread = (
        rows.select(*group, member, *carry)
        .join(sizes, group)
        .withColumn("_blocks", F.ceil(F.col("_size") / F.lit(block)).cast("int"))
        .withColumn("_at", F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int"))
        .drop("_size")
    )
    left = spread.select(
        *group,
        F.col("_at").alias("_i"),
        F.explode(F.sequence(F.col("_at"), F.col("_blocks") - 1)).alias("_j"),
        F.struct(member, *carry).alias("_a"),
    )
    right = spread.select(
        *group,
        F.explode(F.sequence(F.lit(0), F.col("_at"))).alias("_i"),
        F.col("_at").alias("_j"),
        F.struct(member, *carry).alias("_b"),
    )
    joined = left.join(right, [*group, "_i", "_j"]).where(
        F.when(F.col("_i") == F.col("_j"), F.col(f"_a.{member}") < F.col(f"_b.{member}")).otherwise(
            F.col(f"_a.{member}") != F.col(f"_b.{member}")
        )
    )
    straight = F.col(f"_a.{member}") < F.col(f"_b.{member}")
    return joined.select(
        *group,
        F.when(straight, F.col("_a")).otherwise(F.col("_b")).alias("left"),
        F.when(straight, F.col("_b")).otherwise(F.col("_a")).alias("right"),
    )
