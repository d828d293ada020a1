"""Contract checks: each broken rule is a row (rule, key), nothing is thrown away."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lisura.functions import fixed
from lisura.functions.identity import fingerprint

COLUMNS = ["table", "rule", "key"]


def _key(keys: list[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])


def _broken(df: DataFrame, table: str, rule: str, bad: Column, keys: list[str]) -> DataFrame:
    return df.where(F.coalesce(bad, F.lit(False))).select(
        F.lit(table).alias("table"), F.lit(rule).alias("rule"), _key(keys).alias("key"))


def closed_set(df: DataFrame, table: str, name: str, allowed, keys: list[str]) -> DataFrame:
    return _broken(df, table, f"{name} in set", ~F.col(name).isin(list(allowed)), keys)


def not_null(df: DataFrame, table: str, names: list[str], keys: list[str]) -> DataFrame:
    parts = [_broken(df, table, f"{n} not null", F.col(n).isNull(), keys) for n in names]
    return reduce(lambda a, b: a.unionByName(b), parts)


def ordered_pair(df: DataFrame, table: str, left: str = "leftCnpj", right: str = "rightCnpj") -> DataFrame:
    return _broken(df, table, f"{left} < {right}", ~(F.col(left) < F.col(right)), [left, right])


def unique_key(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """One row per key value that occurs more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(
        F.lit(table).alias("table"), F.lit(f"unique {','.join(keys)}").alias("rule"), _key(keys).alias("key"))


def official_url(df: DataFrame, table: str, name: str, keys: list[str], hosts=fixed.OFFICIAL_HOSTS) -> DataFrame:
    host = F.lower(F.regexp_extract(F.col(name), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1))
    good = F.lit(False)
    for h in hosts:
        good = good | (host == h) | host.endswith("." + h)
    return _broken(df, table, f"{name} on official host", ~good, keys)


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """All broken rules over the tables that are given."""
    parts: list[DataFrame] = []

    def has(name: str) -> DataFrame | None:
        return tables.get(name)

    if (t := has("orgao")) is not None:
        parts += [closed_set(t, "orgao", "esfera", ("federal", "estadual", "municipal"), ["cnpj"]),
                  unique_key(t, "orgao", ["cnpj"]), not_null(t, "orgao", ["razaoSocial", "poder", "uf"], ["cnpj"])]
    if (t := has("fornecedor")) is not None:
        parts += [unique_key(t, "fornecedor", ["cnpj"]), not_null(t, "fornecedor", ["razaoSocial"], ["cnpj"])]
    if (t := has("contratacao")) is not None:
        parts += [unique_key(t, "contratacao", ["pncpId"]),
                  not_null(t, "contratacao", ["orgaoId", "modalidade", "ano"], ["pncpId"])]
    if (t := has("item")) is not None:
        parts += [unique_key(t, "item", ["id"]), not_null(t, "item", ["contratacaoId", "quantidade", "uf", "quarter"], ["id"])]
    if (t := has("flag")) is not None:
        parts += [closed_set(t, "flag", "state", fixed.FLAG_STATES, ["id"]), unique_key(t, "flag", ["id"])]
    if (t := has("item_exclusion")) is not None:
        parts += [closed_set(t, "item_exclusion", "reason", fixed.EXCLUSION_REASONS, ["itemId", "reason"]),
                  unique_key(t, "item_exclusion", ["itemId", "reason"])]
    if (t := has("fornecedor_adjacency")) is not None:
        parts += [closed_set(t, "fornecedor_adjacency", "kind", fixed.ADJACENCY_KINDS, ["kind", "leftCnpj", "rightCnpj"]),
                  ordered_pair(t, "fornecedor_adjacency"),
                  unique_key(t, "fornecedor_adjacency", ["kind", "leftCnpj", "rightCnpj"])]
    if (t := has("co_bid_edge")) is not None:
        parts += [ordered_pair(t, "co_bid_edge"),
                  unique_key(t, "co_bid_edge", ["kind", "leftCnpj", "rightCnpj", "licitacaoId", "itemLote"])]
    if (t := has("co_bid_screen")) is not None:
        parts += [closed_set(t, "co_bid_screen", "kind", fixed.SCREEN_KINDS, ["kind", "subjectId"]),
                  unique_key(t, "co_bid_screen", ["kind", "subjectId", "snapshotId"])]
    if (t := has("licitacao_participante")) is not None:
        parts += [closed_set(t, "licitacao_participante", "uf", ("SP", "RS"), ["licitacaoId", "participante"]),
                  closed_set(t, "licitacao_participante", "source", ("tce_sp", "tce_rs"), ["licitacaoId", "participante"]),
                  unique_key(t, "licitacao_participante", ["licitacaoId", "itemLote", "participante", "source"])]
    return reduce(lambda a, b: a.unionByName(b), parts)


def same_content(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: counts and whether two versions of a table hold the same rows."""
    one = fingerprint(before).select(F.struct("n", "h1", "h2").alias("b"))
    two = fingerprint(after).select(F.struct("n", "h1", "h2").alias("a"))
    both = one.unionByName(two, allowMissingColumns=True).agg(F.max("b").alias("b"), F.max("a").alias("a"))
    return both.select(
        F.col("b.n").alias("n_before"), F.col("a.n").alias("n_after"), (F.col("a") == F.col("b")).alias("unchanged"))
