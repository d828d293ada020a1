"""Edges between companies that share an attribute or bid on the same lot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lisura.functions import person_ids as P
from lisura.functions import text as X
from lisura.functions.text import column
from lisura.operators.stats import pairs_within

def company_id(df: DataFrame) -> Column:
    """14-character id: given whole, or root + order + check digits."""
    whole = X.alnum(column(df, "cnpj"))
    root = X.company_root(column(df, "cnpj_basico"))
    order = F.right(F.lpad(X.alnum(column(df, "cnpj_ordem")), 4, "0"), F.lit(4))
    check = F.right(F.lpad(X.alnum(column(df, "cnpj_dv")), 2, "0"), F.lit(2))
    return F.when(F.length(whole) == 14, whole).when(root.isNotNull(), F.concat(root, order, check))


def partner_members(establishments: DataFrame, partners: DataFrame) -> DataFrame:
    """(kind, key, cnpj, evidence) of companies through their partners."""
    ident = F.trim(X.text_or_empty(column(partners, "identificador_de_socio")))
    raw = F.trim(X.text_or_empty(column(partners, "cnpj_cpf_do_socio")))
    number, masked = X.digits(raw), P.mask_person(raw)
    person = P.is_masked(masked) | P.is_person(raw)
    company = (ident == "1") | (F.length(number) == 14)
    key = (
        F.when(raw == "", F.lit(None))
        .when(company, F.when(F.length(number) == 14, number).otherwise(F.nullif(X.alnum(raw), F.lit(""))))
        .when(person, masked)
    )
    links = partners.select(
        X.company_root(column(partners, "cnpj_basico")).alias("root"),
        key.alias("key"),
        F.when(company, "cnpj").otherwise("cpf").alias("partner_type"),
    ).where(F.col("key").isNotNull() & F.col("root").isNotNull())
    companies = establishments.select(company_id(establishments).alias("cnpj")).where(F.col("cnpj").isNotNull())
    companies = companies.withColumn("root", F.substring("cnpj", 1, 8))
    joined = links.distinct().join(companies.distinct(), "root")
    return joined.select(
        F.lit("shared_qsa_partner").alias("kind"), "key", "cnpj",
        F.concat(F.lit("partner_key="), F.col("key"), F.lit(" partner_type="), F.col("partner_type")).alias("evidence"),
    )


def _attribute(establishments: DataFrame, kind: str, label: str, key: Column) -> DataFrame:
    rows = establishments.select(company_id(establishments).alias("cnpj"), key.alias("key"))
    rows = rows.where(F.col("cnpj").isNotNull() & (F.coalesce("key", F.lit("")) != ""))
    return rows.select(
        F.lit(kind).alias("kind"), "key", "cnpj", F.concat(F.lit(f"{label}="), F.col("key")).alias("evidence"))


def address_members(e: DataFrame) -> DataFrame:
    street = X.fold(F.concat_ws(" ", column(e, "tipo_logradouro"), column(e, "logradouro")))
    number, city = X.fold(column(e, "numero")), X.fold(column(e, "municipio"))
    postcode = X.digits(column(e, "cep"))
    parts = [F.nullif(p, F.lit("")) for p in (street, number, postcode, city)]
    key = F.when((street != "") & ((number != "") | (postcode != "")), F.concat_ws(" ", *parts))
    return _attribute(e, "shared_address", "address", key)


def phone_members(e: DataFrame) -> DataFrame:
    def phone(area: str, line: str) -> Column:
        d = X.digits(F.concat(X.text_or_empty(column(e, area)), X.text_or_empty(column(e, line))))
        # Eleven digits could be a person id, so they are never used as a key.
        return F.when(F.length(d) != 11, d)

    both = e.withColumn("_phone", F.explode(F.array_distinct(F.array(
        F.coalesce(phone("ddd1", "telefone1"), F.lit("")), F.coalesce(phone("ddd2", "telefone2"), F.lit(""))))))
    return _attribute(both, "shared_phone", "phone", F.col("_phone"))


def email_members(e: DataFrame) -> DataFrame:
    mail = X.fold(column(e, "correio_eletronico"))
    return _attribute(e, "shared_email", "email", F.when(F.contains(mail, F.lit("@")), P.mask_person(mail)))


def shared_members(establishments: DataFrame, partners: DataFrame | None = None) -> DataFrame:
    """All (kind, key, cnpj): who shares what.  Linear in the input."""
    parts = [address_members(establishments), phone_members(establishments), email_members(establishments)]
    if partners is not None:
        parts.insert(0, partner_members(establishments, partners))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("evidence", P.mask_person(F.col("evidence"))).distinct()


def adjacency_edges(members: DataFrame, snapshot: str = "", version: str = "", block: int = 2000) -> DataFrame:
    """Undirected company edges, one per (kind, pair), left < right.

    Companies with the same eight-character root are never linked.  All pairs
    of every group are the result; ``members`` says the same in linear space,
    and :func:`neighbours` and :func:`hubs` work on that.
    """
    pairs = pairs_within(members, ["kind", "key"], "cnpj", block, ["evidence"]).where(
        F.substring("left.cnpj", 1, 8) != F.substring("right.cnpj", 1, 8))
    return (
        pairs.groupBy("kind", F.col("left.cnpj").alias("leftCnpj"), F.col("right.cnpj").alias("rightCnpj"))
        .agg(F.min("left.evidence").alias("evidence"))
        .withColumn("snapshot_id", F.lit(snapshot))
        .withColumn("methodology_version", F.lit(version))
    )


def hubs(members: DataFrame, above: int) -> DataFrame:
    """Members of groups with more than ``above`` members: (kind, evidence, cnpj, n)."""
    sized = members.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > above)
    return members.join(sized, ["kind", "key"]).select("kind", "evidence", "cnpj", F.col("n").alias("group_n"))


def neighbours(members: DataFrame, companies: DataFrame) -> DataFrame:
    """Every company linked to the given ones, from groups of any size.

    Works on membership, not on pairs, so a dense group costs one row per
    member and asked company.
    """
    asked = companies.select(F.col("cnpj").alias("asked")).distinct()
    mine = members.join(asked, F.col("cnpj") == F.col("asked")).select("kind", "key", "asked")
    return (
        members.join(mine, ["kind", "key"])
        .where(F.substring("cnpj", 1, 8) != F.substring("asked", 1, 8))
        .groupBy("kind", "asked", "cnpj")
        .agg(F.min("evidence").alias("evidence"))
    )


def bidders(participants: DataFrame) -> DataFrame:
    """Company bids, one row per (tender, lot, company); the lowest bid stands."""
    rows = participants.where(P.is_company(F.col("participante")) & (F.col("licitacaoId") != ""))
    return rows.groupBy("licitacaoId", "itemLote", "participante").agg(
        F.min("proposta").alias("proposta"), F.max("winner").alias("winner"),
        F.min("snapshot_id").alias("snapshot_id"), F.min("methodology_version").alias("methodology_version"),
    )


def cobid_edges(participants: DataFrame, block: int = 2000) -> DataFrame:
    """Company pairs bidding on the same tender and lot."""
    event = ["licitacaoId", "itemLote"]
    carry = ["proposta", "winner", "snapshot_id", "methodology_version"]
    pairs = pairs_within(bidders(participants), event, "participante", block, carry)
    a, b = F.col("left"), F.col("right")
    return pairs.select(
        F.lit("co_bid").alias("kind"), a["participante"].alias("leftCnpj"), b["participante"].alias("rightCnpj"),
        *event, a["proposta"].alias("leftProposta"), b["proposta"].alias("rightProposta"),
        F.when(a["winner"], a["participante"]).when(b["winner"], b["participante"]).otherwise("").alias("winner"),
        a["snapshot_id"].alias("snapshot_id"), a["methodology_version"].alias("methodology_version"),
    )


def crowded_lots(participants: DataFrame, above: int) -> DataFrame:
    """Bidders of lots with more than ``above`` bidders: one row per bidder."""
    bids = bidders(participants)
    event = ["licitacaoId", "itemLote"]
    sized = bids.groupBy(*event).agg(F.count(F.lit(1)).alias("group_n")).where(F.col("group_n") > above)
    return bids.join(sized, event)
