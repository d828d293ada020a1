"""Checkable jobs: participants, edges, screens."""

from __future__ import annotations

from pyspark.sql import functions as F

from lisura.operators import graph as G
from lisura.operators import participants as PA
from lisura.operators import screens as SC
from lisura.operators.stats import pairs_within
from lisura.plans.jobs import job

PEOPLE = """
select case when l_suppkey % 4 = 0 then lpad(cast(l_suppkey as string), 11, '2')
            else lpad(cast(l_suppkey as string), 14, '0') end as who, l_orderkey, l_linenumber, l_partkey, l_extendedprice
from {lineitem}"""


@job("participants_normalized", f"""
select cast(l_orderkey as string) as "licitacaoId", case when l_orderkey % 3 = 0 then 'SP' else 'RS' end as uf,
       case when length(who) = 14 then who
            else concat('***.', substr(who, 4, 3), '.', substr(who, 7, 3), '-**') end as participante,
       l_extendedprice as proposta, l_linenumber = 1 as winner,
       case when l_orderkey % 3 = 0 then 'tce_sp' else 'tce_rs' end as source
from ({PEOPLE}) p where l_orderkey % 3 < 2""")
def _(v):
    key = F.col("l_orderkey")
    who = F.when(F.col("l_suppkey") % 4 == 0, F.lpad(F.col("l_suppkey").cast("string"), 11, "2")).otherwise(
        F.lpad(F.col("l_suppkey").cast("string"), 14, "0"))
    rows = v.lineitem.select(
        key.cast("string").alias("licitacao_id"),
        F.when(key % 3 == 0, "sp").when(key % 3 == 1, " RS ").otherwise("PR").alias("uf"),
        who.alias("participante"), F.replace(F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(",")).alias("proposta"),
        F.when(F.col("l_linenumber") == 1, "Vencedor").otherwise("nao").alias("winner"),
        F.when(key % 3 == 0, "TCE-SP licitacao").otherwise("tce rs").alias("source"))
    return PA.normalize_participants(rows).select("licitacaoId", "uf", "participante", "proposta", "winner", "source")


@job("participants_state_one", """
select cast(l_orderkey as string) as "licitacaoId", concat('Órgão ', l_partkey % 50) as orgao, 'reforma e acao' as classe,
       cast(l_linenumber as string) as "itemLote", lpad(cast(l_suppkey as string), 14, '0') as participante,
       l_extendedprice as proposta, l_linenumber = 2 as winner from {lineitem}""")
def _(v):
    digits = F.lpad(F.col("l_suppkey").cast("string"), 14, "0")
    dotted = F.concat(F.substring(digits, 1, 2), F.lit("."), F.substring(digits, 3, 3), F.lit("."), F.substring(digits, 6, 3),
                      F.lit("/"), F.substring(digits, 9, 4), F.lit("-"), F.substring(digits, 13, 2))
    raw = v.lineitem.select(
        F.col("l_orderkey").cast("string").alias("Código da Licitação"),
        F.concat(F.lit("Órgão "), F.col("l_partkey") % 50).alias("Entidade"), F.lit("Reforma  e Ação").alias("Objeto"),
        F.col("l_linenumber").cast("string").alias("Produto (item)"), dotted.alias("CNPJ do participante candidato"),
        F.replace(F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(",")).alias("Valor da Proposta"),
        F.when(F.col("l_linenumber") == 2, "Classificado - Vencedor").otherwise("Classificado").alias("Resultado da Habilitação"))
    return PA.from_state_one(raw).select("licitacaoId", "orgao", "classe", "itemLote", "participante", "proposta", "winner")


def _bid_tables(v):
    """Stacked bid tables: item level for some tenders, lot level for more, tender level for all."""
    li = v.lineitem
    k = F.col("l_orderkey")
    base = dict(
        NR_LICITACAO=k.cast("string"), ANO_LICITACAO=F.lit("2014"), CD_TIPO_MODALIDADE=F.lit("CNC"),
        NR_DOCUMENTO_LICITANTE=F.lpad(F.col("l_suppkey").cast("string"), 14, "0"))
    price = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")

    def rows(df, table, **extra):
        cols = {**base, **extra}
        return df.select(F.lit(table).alias("_table"), *[c.alias(n) for n, c in cols.items()])

    line = F.col("l_linenumber").cast("string")
    items = rows(li.where(k % 3 == 0), "ITEM_PROPOSTA", NR_LOTE=F.lit("1"), NR_ITEM=line, VL_TOTAL_ITEM=price)
    lots = rows(li.where(k % 3 < 2), "LOTE_PROPOSTA", NR_LOTE=line, VL_TOTAL_LOTE=price)
    whole = rows(li, "PROPOSTA", VL_TOTAL_PROPOSTA=price)
    first = li.where(F.col("l_linenumber") == 1)
    won = first.select(
        F.when(k % 2 == 0, "LICITACAO").otherwise("ITEM").alias("_table"), base["NR_LICITACAO"].alias("NR_LICITACAO"),
        base["ANO_LICITACAO"].alias("ANO_LICITACAO"), base["CD_TIPO_MODALIDADE"].alias("CD_TIPO_MODALIDADE"),
        base["NR_DOCUMENTO_LICITANTE"].alias("NR_DOCUMENTO_VENCEDOR"))
    out = items
    for part in (lots, whole, won):
        out = out.unionByName(part, allowMissingColumns=True)
    return out


@job("participants_state_two", """
with won as (select distinct l_orderkey, l_suppkey from {lineitem} where l_linenumber = 1)
select concat(l.l_orderkey, '/2014/CNC') as "licitacaoId",
       case when l.l_orderkey % 3 = 0 then concat('1/', l_linenumber) when l.l_orderkey % 3 = 1 then cast(l_linenumber as string)
            else '' end as "itemLote",
       lpad(cast(l.l_suppkey as string), 14, '0') as participante, l_extendedprice as proposta,
       w.l_suppkey is not null as winner, 'CNC' as classe
from {lineitem} l left join won w on w.l_orderkey = l.l_orderkey and w.l_suppkey = l.l_suppkey""")
def _(v):
    return PA.from_state_two(_bid_tables(v)).select("licitacaoId", "itemLote", "participante", "proposta", "winner", "classe")


@job("winner_set", """
select distinct concat(l_orderkey, '/2014/CNC') as tender, lpad(cast(l_suppkey as string), 14, '0') as token
from {lineitem} where l_linenumber = 1""")
def _(v):
    return PA.winner_set(PA._tidy(_bid_tables(v)))


@job("most_detailed_proposals", """
select concat(l_orderkey, '/2014/CNC') as tender,
       case when l_orderkey % 3 = 0 then 'ITEM_PROPOSTA' when l_orderkey % 3 = 1 then 'LOTE_PROPOSTA' else 'PROPOSTA' end as level,
       count(*) as n from {lineitem} group by 1, 2""")
def _(v):
    chosen = PA.most_detailed_proposals(PA._tidy(_bid_tables(v)))
    return chosen.groupBy("tender", F.col("_table").alias("level")).agg(F.count(F.lit(1)).alias("n"))


@job("participants_unified", """
select source, uf, count(*) as n, sum(case when winner then 1 else 0 end)::bigint as winners
from (select 'tce_rs' as source, 'RS' as uf, l_linenumber = -1 as winner from {lineitem}
      union all select source, uf, winner from {v_bid}) p group by 1, 2""")
def _(v):
    one = PA.normalize_participants(v.v_bid)
    li = v.lineitem.select(
        F.col("l_orderkey").cast("string").alias("licitacaoId"), F.lit("RS").alias("uf"),
        F.lpad(F.col("l_suppkey").cast("string"), 14, "0").alias("participante"), F.lit("tce_rs").alias("source"))
    both = PA.unify_participants(one, PA.normalize_participants(li))
    return both.groupBy("source", "uf").agg(F.count(F.lit(1)).alias("n"), F.count_if("winner").alias("winners"))


# ---- edges ---------------------------------------------------------------------

COMPANY = "concat(cnpj_basico, cnpj_ordem, cnpj_dv)"
KEYS = {
    "shared_address": f"""select distinct {COMPANY} as cnpj, lower(strip_accents(concat_ws(' ', concat('rua ', logradouro), numero, municipio))) as k
        from {{v_company}}""",
    "shared_phone": f"""select distinct {COMPANY} as cnpj, concat(ddd1, telefone1) as k from {{v_company}}""",
    "shared_email": f"""select distinct {COMPANY} as cnpj, lower(correio_eletronico) as k from {{v_company}}
        where correio_eletronico like '%@%'""",
    "shared_qsa_partner": f"""select distinct {COMPANY} as cnpj,
        case when length(cnpj_cpf_do_socio) = 14 then cnpj_cpf_do_socio
             else concat('***.', substr(cnpj_cpf_do_socio, 4, 3), '.', substr(cnpj_cpf_do_socio, 7, 3), '-**') end as k
        from {{v_partner}} p join {{v_company}} c using (cnpj_basico)""",
}


def _edge_sql(kind: str) -> str:
    return f"""
with m as ({KEYS[kind]})
select distinct '{kind}' as kind, a.cnpj as "leftCnpj", b.cnpj as "rightCnpj"
from m a join m b on a.k = b.k and a.cnpj < b.cnpj where substr(a.cnpj, 1, 8) <> substr(b.cnpj, 1, 8)"""


def _edges(members):
    return G.adjacency_edges(members, block=25).select("kind", "leftCnpj", "rightCnpj")


@job("edges_shared_partner", _edge_sql("shared_qsa_partner"))
def _(v):
    return _edges(G.partner_members(v.v_company, v.v_partner))


@job("edges_shared_address", _edge_sql("shared_address"))
def _(v):
    return _edges(G.address_members(v.v_company))


@job("edges_shared_phone", _edge_sql("shared_phone"))
def _(v):
    return _edges(G.phone_members(v.v_company))


@job("edges_shared_email", _edge_sql("shared_email"))
def _(v):
    return _edges(G.email_members(v.v_company))


@job("adjacency_edges", "with " + ", ".join(f"m{i} as ({sql})" for i, sql in enumerate(KEYS.values()))
    + " " + " union all ".join(
        f"""select distinct '{kind}' as kind, a.cnpj as "leftCnpj", b.cnpj as "rightCnpj"
        from m{i} a join m{i} b on a.k = b.k and a.cnpj < b.cnpj
        where substr(a.cnpj, 1, 8) <> substr(b.cnpj, 1, 8)""" for i, kind in enumerate(KEYS)))
def _(v):
    members = G.shared_members(v.v_company, v.v_partner)
    return _edges(members)


# Groups above this many members are listed as hubs.
HUB = 4


@job("adjacency_dense_hubs", "with " + ", ".join(
    f"m{i} as (select *, count(*) over (partition by k) as n from ({sql}) q)" for i, sql in enumerate(KEYS.values()))
    + " " + " union all ".join(
        f"select '{kind}' as kind, cnpj, n as group_n from m{i} where n > {HUB}" for i, kind in enumerate(KEYS)))
def _(v):
    members = G.shared_members(v.v_company, v.v_partner)
    return G.hubs(members, HUB).select("kind", "cnpj", "group_n")


@job("adjacency_neighbours", f"""
with m as ({KEYS["shared_address"]}), asked as (select cnpj from m where substr(cnpj, 7, 2) = '11')
select distinct 'shared_address' as kind, a.cnpj as asked, b.cnpj
from asked q join m a on a.cnpj = q.cnpj join m b on a.k = b.k where substr(a.cnpj, 1, 8) <> substr(b.cnpj, 1, 8)""")
def _(v):
    members = G.address_members(v.v_company).distinct()
    asked = members.where(F.substring("cnpj", 7, 2) == "11").select("cnpj")
    return G.neighbours(members, asked).select("kind", "asked", "cnpj")


@job("cobid_edges", """
select 'co_bid' as kind, a.participante as "leftCnpj", b.participante as "rightCnpj", a."licitacaoId", a."itemLote",
       a.proposta::double as "leftProposta", b.proposta::double as "rightProposta",
       case when a.winner then a.participante when b.winner then b.participante else '' end as winner
from {v_bid} a join {v_bid} b on a."licitacaoId" = b."licitacaoId" and a.participante < b.participante""")
def _(v):
    return G.cobid_edges(v.v_bid).drop("snapshot_id", "methodology_version")


@job("cobid_dense_lots", """
select "licitacaoId", participante, n as group_n
from (select *, count(*) over (partition by "licitacaoId") as n from {v_bid}) b where n > 7""")
def _(v):
    return G.crowded_lots(v.v_bid, 7).select("licitacaoId", "participante", "group_n")


@job("pairs_within_groups", """
select a.c_nationkey, a.c_custkey as "left", b.c_custkey as "right"
from {customer} a join {customer} b on a.c_nationkey = b.c_nationkey and a.c_mktsegment = b.c_mktsegment
  and floor(a.c_custkey / 1500) = floor(b.c_custkey / 1500) and a.c_custkey < b.c_custkey""")
def _(v):
    """Block-split pairing, with blocks small enough to split every group."""
    rows = v.customer.withColumn("zone", F.floor(F.col("c_custkey") / 1500))
    pairs = pairs_within(rows, ["zone", "c_nationkey", "c_mktsegment"], "c_custkey", block=4)
    return pairs.select("c_nationkey", F.col("left.c_custkey").alias("left"), F.col("right.c_custkey").alias("right"))


# ---- screens -------------------------------------------------------------------

SQL_TIGHT = """
select "licitacaoId", "itemLote", count(*) as n,
       round_even(stddev_samp(cast(proposta as double)) / avg(cast(proposta as double)), 4) as cv
from {v_bid} group by 1, 2
having count(*) >= 3 and round_even(stddev_samp(cast(proposta as double)) / avg(cast(proposta as double)), 4) <= 0.3"""


@job("screen_tight_bids", SQL_TIGHT)
def _(v):
    return SC.tight_bids(SC.screen_rows(v.v_bid), 3, 0.3).select("licitacaoId", "itemLote", "n", "cv")


SQL_SKEW = """
with bids as (select "licitacaoId", cast(proposta as double) as p, min(cast(proposta as double)) over (partition by "licitacaoId") as low,
              count(*) over (partition by "licitacaoId") as n from {v_bid}),
rest as (select "licitacaoId", low, n, count(*) as cluster_n, round_even(stddev_samp(p) / avg(p), 4) as cluster_cv, median(p) as med
         from bids where p > low group by 1, 2, 3)
select "licitacaoId", low, cluster_n, cluster_cv, round(med, 4) as cluster_median, round_even(low / med, 4) as low_ratio
from rest where cluster_n = n - 1 and cluster_n >= 3 and cluster_cv <= 0.3 and round_even(low / med, 4) <= 0.7"""


@job("screen_low_outlier", SQL_SKEW)
def _(v):
    out = SC.low_outliers(SC.screen_rows(v.v_bid), 3, 0.3, 0.7)
    return out.select("licitacaoId", "low", "cluster_n", "cluster_cv",
                      F.round(F.col("cluster_median").cast("double"), 4).alias("cluster_median"), "low_ratio")


SQL_COVER = """
with pairs as (
  select a.participante as l, b.participante as r, a."licitacaoId" as lid,
         case when a.proposta >= b.proposta then a.participante else b.participante end as high
  from {v_bid} a join {v_bid} b on a."licitacaoId" = b."licitacaoId" and a.participante < b.participante
  where a.proposta <> 0 and b.proposta <> 0
    and round_even(cast(greatest(a.proposta, b.proposta) as double) / cast(least(a.proposta, b.proposta) as double), 4) >= 1.5
    and not case when a.proposta >= b.proposta then a.winner else b.winner end)
select l as "leftCnpj", r as "rightCnpj", count(*) as n, min(high) as high, min(lid) as first
from pairs group by 1, 2 having count(*) >= 2 and min(high) = max(high)"""


@job("screen_cover_bidding", SQL_COVER)
def _(v):
    out = SC.cover_pairs(SC.screen_rows(v.v_bid), block=3)
    return out.select("leftCnpj", "rightCnpj", "n", "high", F.col("first.licitacaoId").alias("first"))


SQL_ROTATION = """
with wins as (select orgao, classe, participante, count(*) as k, min("licitacaoId") as f
              from {v_bid} where winner group by 1, 2, 3)
select orgao, classe, sum(k)::bigint as n, count(*) as n_winners, min(f) as "licitacaoId"
from wins group by 1, 2 having sum(k) >= 3 and count(*) between 3 and 5 and max(k) < sum(k)"""


@job("screen_winner_rotation", SQL_ROTATION)
def _(v):
    out = SC.winner_rotation(SC.screen_rows(v.v_bid))
    return out.select("orgao", "classe", "n", "n_winners", "licitacaoId")


LOOSE = {
    "bid_variance": {"min_bidders": 3, "max_cv": 0.3},
    "skew": {"min_cluster": 3, "cluster_max_cv": 0.3, "max_low_ratio": 0.7},
    "cover_bidding": {"min_repeats": 2, "min_ratio": 1.5},
    "winner_rotation": {"min_set": 3, "max_set": 5, "min_licitacoes": 3},
}


SQL_SCREENS = f"""
with tight as ({SQL_TIGHT}), skew as ({SQL_SKEW}), cover as ({SQL_COVER}), rot as ({SQL_ROTATION})
select 'bid_variance' as kind, "licitacaoId" as "subjectId", n, n as n_values from tight
union all select 'skew', "licitacaoId", cluster_n, 0 from skew
union all select 'cover_bidding', first, max_by(n, (-cast("leftCnpj" as bigint) * 1000000 - cast("rightCnpj" as bigint))), 0 from cover group by first
union all select 'winner_rotation', null, n, n_winners from rot"""


@job("screens_all", SQL_SCREENS)
def _(v):
    out = SC.detect_screens(v.v_bid, LOOSE)
    n = F.coalesce(F.get_json_object("evidence", "$.n"), F.get_json_object("evidence", "$.cluster_n"))
    listed = F.coalesce(F.get_json_object("evidence", "$.values"), F.get_json_object("evidence", "$.winners"))
    return out.select(
        "kind", F.when(F.col("kind") != "winner_rotation", F.col("subjectId")).alias("subjectId"), n.cast("bigint").alias("n"),
        F.coalesce(F.json_array_length(listed), F.lit(0)).cast("bigint").alias("n_values"))


@job("screen_members", f"""
with tight as ({SQL_TIGHT})
select 'bid_variance' as kind, b."licitacaoId", b.participante, b.proposta::double as proposta, b.winner
from {{v_bid}} b join tight t on t."licitacaoId" = b."licitacaoId" """)
def _(v):
    rows = SC.screen_rows(v.v_bid)
    hits = SC.tight_bids(rows, 3, 0.3).select(
        F.lit("bid_variance").alias("kind"), F.col("licitacaoId").alias("subjectId"), "licitacaoId")
    return SC.screen_members(rows, hits).select("kind", "licitacaoId", "participante", "proposta", "winner")
