"""What is covered: counts per year and city, coded share, freshness, flags per day."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lisura.functions import fixed
from lisura.functions import text as X
from lisura.operators.explorer import Tables, visible_contracts, visible_items


def covered_cities(t: Tables) -> DataFrame:
    """Distinct (nome, uf, ibge) of buyers with visible contracts."""
    owners = t.buyers.select(
        F.col("id").alias("orgaoId"), F.col("municipioNome").alias("nome"), "uf", F.col("municipioIbge").alias("ibge"))
    used = visible_contracts(t).select("orgaoId").distinct()
    return owners.join(used, "orgaoId", "left_semi").select("nome", "uf", "ibge").distinct().orderBy("nome", "ibge")


def counts_per_year(t: Tables) -> DataFrame:
    """(year, purchases, items) for every year that has visible contracts."""
    contracts = visible_contracts(t)
    per_year = contracts.groupBy("ano").agg(F.count(F.lit(1)).alias("purchases"))
    per_contract = visible_items(t).groupBy("contratacaoId").agg(F.count(F.lit(1)).alias("k"))
    items = (
        per_contract.join(contracts.select(F.col("id").alias("contratacaoId"), "ano"), "contratacaoId")
        .groupBy("ano").agg(F.sum("k").alias("items"))
    )
    return per_year.join(items, "ano", "left").select(
        F.col("ano").alias("year"), "purchases", F.coalesce("items", F.lit(0)).alias("items")).orderBy("year")


def catalog_number(c: Column) -> Column:
    """A code as its truncated positive integer text; null otherwise."""
    n = X.parse_decimal(c, X.WIDE)
    return F.when(n > 0, F.floor(n).cast("decimal(38,0)").cast("string"))


def catalog_codes(catalog: DataFrame) -> DataFrame:
    """Distinct (codigo, kind) of a catalog with ``codigo`` and ``tipo``."""
    kind = F.when(F.upper(F.substring(F.trim(X.text_or_empty("tipo")), 1, 1)) == "S", "catser").otherwise("catmat")
    return (
        catalog.select(catalog_number(F.col("codigo").cast("string")).alias("codigo"), kind.alias("kind"))
        .where(F.col("codigo").isNotNull()).distinct()
    )


def coded_share(items: DataFrame, codes: DataFrame) -> DataFrame:
    """(n_items, n_coded, percent): items whose code is in the catalog of its kind."""
    material = codes.where(F.col("kind") == "catmat").select(F.col("codigo").alias("_m"), F.lit(1).alias("in_m")).distinct()
    service = codes.where(F.col("kind") == "catser").select(F.col("codigo").alias("_s"), F.lit(1).alias("in_s")).distinct()
    # Distinct code pairs are few next to items, so they are counted first.
    pairs = items.groupBy("catmat", "catser").agg(F.count(F.lit(1)).alias("k"))
    found = (
        pairs.withColumn("_m", catalog_number(F.col("catmat"))).withColumn("_s", catalog_number(F.col("catser")))
        .join(material, "_m", "left").join(service, "_s", "left")
    )
    hit = F.col("in_m").isNotNull() | F.col("in_s").isNotNull()
    totals = found.agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("n_items"),
        F.coalesce(F.sum(F.when(hit, F.col("k"))), F.lit(0)).alias("n_coded"),
    )
    share = F.round(F.lit(100).cast("decimal(20,0)") * F.col("n_coded") / F.nullif(F.col("n_items"), F.lit(0)), 2)
    return totals.withColumn("percent", F.coalesce(share, F.lit(0)).cast("decimal(10,2)"))


def single_labels(items: DataFrame) -> DataFrame:
    """(n, uf, quarter): a label only where all items agree on one non-empty value."""
    # min = max says "exactly one value" without a distinct count.
    parts = []
    for name in ("uf", "quarter"):
        c = F.nullif(F.col(name), F.lit(""))
        parts.append(F.when(F.min(c) == F.max(c), F.max(c)).otherwise("").alias(name))
    return items.agg(F.count(F.lit(1)).alias("n"), *parts)


def coverage_report(t: Tables, codes: DataFrame, version: str) -> DataFrame:
    """One row: totals, coded share and the slice label.

    The three one-row results are stacked and folded, which needs no join.
    """
    shown = visible_items(t)
    parts = (
        coded_share(shown, codes)
        .unionByName(single_labels(shown), allowMissingColumns=True)
        .unionByName(visible_contracts(t).agg(F.count(F.lit(1)).alias("n_purchases")), allowMissingColumns=True)
    )
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns]).withColumn("methodologyVersion", F.lit(version))


def source_freshness(manifests: DataFrame, sources: tuple = fixed.PUBLISHED_SOURCES) -> DataFrame:
    """Rows, latest write and its snapshot for the fixed list of sources."""
    names = manifests.sparkSession.createDataFrame(list(sources), "source string, name string")
    sums = manifests.groupBy("source").agg(
        F.sum("rows").alias("n"), F.max("written_at").alias("lastUpdate"),
        F.max_by("snapshot_id", F.struct("written_at", "snapshot_id")).alias("snapshotId"),
    )
    live = F.coalesce(F.col("n"), F.lit(0)) > 0
    return names.join(sums, "source", "left").select(
        "name", F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        F.when(live, F.col("lastUpdate")).alias("lastUpdate"), F.when(live, F.col("snapshotId")).alias("snapshotId"),
    )


def flag_counts(flags: DataFrame, kinds: tuple[str, ...] = fixed.FLAG_KINDS) -> DataFrame:
    """(kind, day, n): per day when flags span several days, else per kind; zeros for known kinds."""
    per_day = flags.groupBy("kind", F.col("detectedAt").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    # One row per kind and day is left, so looking at all of them at once is cheap.
    everything = W.partitionBy(F.lit(1))
    marked = per_day.withColumn("_many", F.min("day").over(everything) < F.max("day").over(everything))
    known = flags.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    split = marked.where(F.coalesce("_many", F.lit(False))).select("kind", "day", "n")
    whole = (
        marked.where(~F.coalesce("_many", F.lit(False)))
        .groupBy("kind").agg(F.max("day").alias("day"), F.sum("n").alias("n")).select("kind", "day", "n")
    )
    rows = split.unionByName(whole)
    missing = known.join(rows.select("kind").distinct(), "kind", "left_anti").select(
        "kind", F.lit(None).cast("date").alias("day"), F.lit(0).cast("long").alias("n"))
    return rows.unionByName(missing)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n) for each named table."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)
