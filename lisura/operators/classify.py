"""Uncoded descriptions to the nearest catalog entry.

Texts become signed hashed n-gram vectors.  The two nearest entries of each
text are found with an exact prefix filter: all pairs above a first limit, then
all pairs above a lower one for the texts that have no two neighbours yet, and
so on down to zero.  Most texts end at a high limit, where few pairs are
looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lisura.functions import text as X
from lisura.session import cut_lineage

# Vector size, gram widths and acceptance limits.
BUCKETS = 4096
WIDTHS = (3, 4)
MIN_COSINE = 0.72
MIN_LEAD = 0.18
# Cosine limits at which the texts still without two neighbours are searched.
LEVELS = (0.54, 0.36, 0.2, 0.1, 0.0)
# Slack for rounding of sums of doubles, so the filter never drops a pair on the limit.
SLACK = 1e-9


def _windows(padded: Column, width: int) -> Column:
    last = F.length(padded) - width + 1
    starts = F.sequence(F.lit(1), F.greatest(last, F.lit(1)))
    cut = F.transform(starts, lambda i: F.substring(padded, i, F.lit(width)))
    return F.when(last >= 1, cut).otherwise(F.array().cast("array<string>"))


def grams(folded: Column) -> Column:
    """Array of all 3- and 4-character windows of the blank-padded text."""
    padded = F.concat(F.lit(" "), folded, F.lit(" "))
    both = F.concat(*[_windows(padded, w) for w in WIDTHS])
    return F.when(folded == "", F.array().cast("array<string>")).otherwise(both)


def _hex(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("int")


def with_gram_hash(df: DataFrame) -> DataFrame:
    """Add (bucket, sign) of ``gram``: sha256, low 12 bits little-endian, fifth byte's parity."""
    d = F.col("_digest")
    low = _hex(F.concat(F.substring(d, 3, 2), F.substring(d, 1, 2)))
    odd = _hex(F.substring(d, 10, 1)) % 2
    return df.withColumn("_digest", F.sha2("gram", 256)).withColumns({
        "bucket": low % BUCKETS, "sign": F.when(odd == 0, F.lit(1.0)).otherwise(F.lit(-1.0))}).drop("_digest")


def bucket_weights(texts: DataFrame, text: str = "folded") -> DataFrame:
    """(text, bucket, tf): signed term frequency per bucket of each distinct text.

    Grams are counted per text before hashing, so a repeated gram is hashed once.
    """
    listed = texts.select(F.col(text)).distinct().withColumn("_g", grams(F.col(text)))
    counted = (
        listed.select(text, F.size("_g").alias("_n"), F.explode("_g").alias("gram"))
        .groupBy(text, "_n", "gram").agg(F.count(F.lit(1)).alias("_c"))
    )
    return with_gram_hash(counted).groupBy(text, "bucket").agg(
        F.sum(F.col("sign") * F.col("_c") / F.col("_n")).alias("tf"))


def bucket_frequency(catalog_weights: DataFrame, per_entry: DataFrame) -> DataFrame:
    """(bucket, df, idf) over catalog entries; ``per_entry`` is (folded, entries)."""
    docs = per_entry.agg(F.coalesce(F.sum("entries"), F.lit(0)).alias("docs")).first()["docs"]
    df = catalog_weights.join(per_entry, "folded").groupBy("bucket").agg(F.sum("entries").alias("df"))
    idf = F.log(F.lit(docs + 1.0) / (F.col("df") + 1)) + 1.0
    return df.select("bucket", "df", idf.alias("idf"))


def unit_vectors(weights: DataFrame, frequency: DataFrame) -> DataFrame:
    """(folded, bucket, w, df): idf-weighted and scaled to length one."""
    raw = weights.join(frequency, "bucket", "left").select(
        "folded", "bucket", (F.col("tf") * F.coalesce("idf", F.lit(1.0))).alias("x"),
        F.coalesce("df", F.lit(0)).alias("df"))
    norms = raw.groupBy("folded").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm")).where(F.col("norm") > 0)
    return raw.join(norms, "folded").select("folded", "bucket", (F.col("x") / F.col("norm")).alias("w"), "df")


def prefix_buckets(vectors: DataFrame, limit: float) -> DataFrame:
    """Of each text, only the leading buckets of which similar texts must share one.

    With both vectors ordered from rare to common bucket, let the tail be the
    longest end whose length is below ``limit``.  Two unit vectors that share
    no bucket of their heads have a cosine below ``limit``.
    """
    # A text has at most ``BUCKETS`` rows, so the window is bounded.
    onward = W.partitionBy("folded").orderBy(F.desc("df"), F.desc("bucket")).rowsBetween(W.unboundedPreceding, W.currentRow)
    tail = F.sum(F.col("w") * F.col("w")).over(onward)
    floor = max(limit - SLACK, 0.0) ** 2
    return vectors.withColumn("_tail", tail).where(F.col("_tail") >= floor).select("folded", "bucket")


def similar_pairs(queries: DataFrame, entries: DataFrame, limit: float) -> DataFrame:
    """(q, e, cosine) for all text pairs with cosine >= limit and above 0, clamped to 1.

    Both sides are (folded, bucket, w, df).  Buckets that many texts share are
    split by skew-join handling; weights meet on (text, bucket) rows.
    """
    q = prefix_buckets(queries, limit).withColumnRenamed("folded", "q")
    e = prefix_buckets(entries, limit).withColumnRenamed("folded", "e")
    candidates = q.join(e, "bucket").select("q", "e").distinct()
    left = queries.select(F.col("folded").alias("q"), "bucket", F.col("w").alias("qw"))
    right = entries.select(F.col("folded").alias("e"), "bucket", F.col("w").alias("ew"))
    met = candidates.join(left, "q").join(right, ["e", "bucket"])
    scored = met.groupBy("q", "e").agg(F.least(F.sum(F.col("qw") * F.col("ew")), F.lit(1.0)).alias("cosine"))
    return scored.where((F.col("cosine") >= limit - SLACK) & (F.col("cosine") > 0))


def catalog_entries(catalog: DataFrame) -> DataFrame:
    """(codigo, tipo, folded, seq): the first row of each (code, type)."""
    order = F.col("seq") if "seq" in catalog.columns else F.col("descricao")
    rows = catalog.select(
        F.trim(F.col("codigo").cast("string")).alias("codigo"),
        F.coalesce(F.nullif(F.upper(F.substring(F.trim(X.text_or_empty("tipo")), 1, 1)), F.lit("")), F.lit("M")).alias("tipo"),
        X.fold("descricao").alias("folded"), order.alias("seq"),
    ).where((F.col("codigo") != "") & (F.col("folded") != ""))
    return rows.groupBy("codigo", "tipo").agg(F.min(F.struct("seq", "folded")).alias("r")).select(
        "codigo", "tipo", F.col("r.folded").alias("folded"), F.col("r.seq").alias("seq"))


def catalog_vectors(catalog: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, bucket frequency, vectors) of a catalog."""
    catalog = cut_lineage(catalog.select("codigo", "descricao", "tipo", *(["seq"] if "seq" in catalog.columns else [])))
    entries = catalog_entries(catalog)
    # Document frequency counts every catalog row, repeated codes included.
    every = catalog.select(X.fold("descricao").alias("folded"), F.trim(F.col("codigo").cast("string")).alias("_c"))
    per_entry = every.where((F.col("folded") != "") & (F.col("_c") != "")).groupBy("folded").agg(
        F.count(F.lit(1)).alias("entries"))
    weights = bucket_weights(per_entry)
    frequency = bucket_frequency(weights, per_entry)
    return entries, frequency, unit_vectors(weights, frequency)


def nearest_entries(
    queries: DataFrame, catalog: DataFrame, min_cosine: float = MIN_COSINE, min_lead: float = MIN_LEAD
) -> DataFrame:
    """Score each distinct (folded, kind): code, quality, top1, top2.

    ``kind`` 'M' or 'S' restricts the entries compared with; anything else
    does not.  Ties for the first place go to the earlier catalog row; a
    neighbour that is missing, or has no positive cosine, scores 0.
    """
    entries, frequency, entry_vectors = catalog_vectors(catalog)
    entry_vectors = cut_lineage(entry_vectors)
    asked = cut_lineage(queries.select("folded", "kind").where(F.col("folded") != "").distinct())
    vectors = cut_lineage(unit_vectors(bucket_weights(asked), frequency))
    named = entries.withColumnRenamed("folded", "e")
    # A rank filter: each map task keeps two candidates per text before the shuffle.
    order = W.partitionBy("folded", "kind").orderBy(F.desc("cosine"), "seq", "codigo", "tipo")
    left, parts = asked, []
    for level in LEVELS:
        mine = vectors.join(left.select("folded").distinct(), "folded", "left_semi")
        pairs = similar_pairs(mine, entry_vectors, level)
        found = (
            left.join(pairs.withColumnRenamed("q", "folded"), "folded").join(named, "e")
            .where(~F.col("kind").isin("M", "S") | (F.col("kind") == F.col("tipo")))
            .withColumn("r", F.row_number().over(order))
            .where(F.col("r") <= 2)
            .groupBy("folded", "kind")
            .agg(
                F.max(F.when(F.col("r") == 1, F.struct("codigo", "tipo"))).alias("b"),
                F.max(F.when(F.col("r") == 1, F.col("cosine"))).alias("top1"),
                F.max(F.when(F.col("r") == 2, F.col("cosine"))).alias("top2"),
            )
        )
        found = cut_lineage(found if level == LEVELS[-1] else found.where(F.col("top2").isNotNull()))
        parts.append(found)
        if level != LEVELS[-1]:
            left = cut_lineage(left.join(found, ["folded", "kind"], "left_anti"))
            if not left.limit(1).count():
                break
    best = reduce(lambda a, b: a.unionByName(b), parts)
    joined = asked.join(best, ["folded", "kind"], "left")
    top1 = F.coalesce("top1", F.lit(0.0))
    top2 = F.coalesce("top2", F.lit(0.0))
    ok = (top1 >= min_cosine) & (top1 - top2 >= min_lead)
    return joined.select(
        "folded", "kind",
        F.when(ok & (F.col("b.tipo") != "S"), F.col("b.codigo")).alias("catmat"),
        F.when(ok & (F.col("b.tipo") == "S"), F.col("b.codigo")).alias("catser"),
        F.when(ok, "knn").otherwise("none").alias("quality"),
        top1.alias("top1"), top2.alias("top2"), ok.alias("assigned"),
    )


# ---- reuse across runs -----------------------------------------------------


def description_key(folded: Column, kind: Column) -> Column:
    """Cache key: sha256 of the folded text, and the type it was asked for."""
    return F.concat_ws(":", F.sha2(folded, 256), kind)


def score_new(queries: DataFrame, catalog: DataFrame, cache: DataFrame | None) -> DataFrame:
    """Scores of texts that are not in the cache yet, keyed for appending to it."""
    keyed = queries.select("folded", "kind").where(F.col("folded") != "").distinct().withColumn(
        "hash", description_key(F.col("folded"), F.col("kind")))
    if cache is not None:
        keyed = keyed.join(cache.select("hash"), "hash", "left_anti")
    scores = nearest_entries(keyed, catalog)
    return scores.withColumn("hash", description_key(F.col("folded"), F.col("kind"))).select(
        "hash", "catmat", "catser", "quality", "top1", "top2", "assigned")
