"""Search documents and folded substring search over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lisura.functions import text as X
from lisura.operators.explorer import Tables, visible_buyers, visible_items, visible_suppliers

KINDS = ("orgao", "fornecedor", "item")


def search_documents(t: Tables) -> DataFrame:
    """One row per unsuspended buyer, supplier and item: (id, kind, entityId, text)."""

    def docs(df: DataFrame, kind: str, body: str) -> DataFrame:
        return df.where(~F.col("suspended")).select(
            F.concat(F.lit(kind + "_"), F.col("id")).alias("id"), F.lit(kind).alias("kind"),
            F.trim(X.text_or_empty("id")).alias("entityId"), F.trim(X.text_or_empty(body)).alias("text"),
        )

    return (
        docs(t.buyers, "orgao", "razaoSocial")
        .unionByName(docs(t.suppliers, "fornecedor", "razaoSocial"))
        .unionByName(docs(t.items, "item", "descricao"))
    )


def bad_documents(docs: DataFrame) -> DataFrame:
    """Documents without id or text; a load must stop when this has rows."""
    return docs.where((F.coalesce("entityId", F.lit("")) == "") | (F.coalesce("text", F.lit("")) == ""))


def require_text(docs: DataFrame) -> DataFrame:
    """The same documents, failing at run time on an empty one."""
    text = F.when(F.coalesce("text", F.lit("")) == "", F.raise_error(F.concat(F.col("id"), F.lit(" missing text"))))
    return docs.withColumn("text", F.coalesce(text.cast("string"), F.col("text")))


def stale_documents(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """Indexed ids that no current document has."""
    return indexed.select("id").distinct().join(current.select("id"), "id", "left_anti")


def matching(docs: DataFrame, q: str | None) -> DataFrame:
    """Documents containing the query, ignoring case and accents; none for an empty one."""
    if not q:
        return docs.where(F.lit(False))
    return docs.where(F.contains(X.fold("text"), X.fold(F.lit(q))))


def search_totals(docs: DataFrame, q: str | None) -> DataFrame:
    """(kind, total) of matches for each of the three kinds, zero included."""
    return totals_of(matching(docs, q))


def totals_of(hits: DataFrame) -> DataFrame:
    """(kind, total) of hits for each of the three kinds, zero included."""
    kinds = hits.sparkSession.createDataFrame([(k,) for k in KINDS], "kind string")
    counts = hits.groupBy("kind").agg(F.count(F.lit(1)).alias("total"))
    return kinds.join(counts, "kind", "left").withColumn("total", F.coalesce("total", F.lit(0)))


def search(docs: DataFrame, q: str | None, skip: int = 0, take: int = 5) -> DataFrame:
    """One page of hits per kind, by folded text and id.

    ``rank <= skip + take`` is a rank filter, which Spark applies before the
    shuffle, so a query that matches everything still moves only a page.
    """
    order = W.partitionBy("kind").orderBy(X.fold("text"), "id")
    return (
        matching(docs, q)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= skip + take)
        .where(F.col("rank") > skip)
    )


def visible_hits(hits: DataFrame, t: Tables) -> DataFrame:
    """Hits whose entity is visible, keeping rank order within each kind."""
    shown = (
        visible_buyers(t).select(F.lit("orgao").alias("kind"), F.col("id").alias("entityId"))
        .unionByName(visible_suppliers(t).select(F.lit("fornecedor").alias("kind"), F.col("id").alias("entityId")))
        .unionByName(visible_items(t).select(F.lit("item").alias("kind"), F.col("id").alias("entityId")))
    )
    return hits.join(shown, ["kind", "entityId"], "left_semi").orderBy("kind", "rank")
