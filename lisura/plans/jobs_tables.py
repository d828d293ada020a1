"""Checkable jobs: sources over the sample data, entity tables, upserts, checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lisura.operators import checks as CH
from lisura.operators import entities as EN
from lisura.plans.jobs import job
from lisura.sources import api_pages as AP
from lisura.sources import auctions as AU
from lisura.sources import landing as LA
from lisura.sources import registry as RG
from lisura.sources import releases as RL
from lisura.sources import sanctions as SA

NOW = "timestamp '2024-05-01 00:00:00'"


def now():
    return F.expr(NOW)


# ---- sources -------------------------------------------------------------------


@job("company_roots", """
select distinct substr(t, 1, 8) as root from (
  select lpad(cast(l_suppkey as string), 14, '0') as t from {lineitem} where l_suppkey % 3 > 0
  union all select lpad(cast(o_custkey as string), 8, '9') from {orders}) x""")
def _(v):
    rows = v.lineitem.join(v.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.when(F.col("l_suppkey") % 3 > 0, F.lpad(F.col("l_suppkey").cast("string"), 14, "0")).otherwise(
            F.lpad(F.col("l_suppkey").cast("string"), 11, "1")).alias("codFornecedor"),
        F.lpad(F.col("o_custkey").cast("string"), 8, "9").alias("orgaoEntidadeCnpj"), "l_partkey")
    extra = v.orders.select(
        F.lit(None).cast("string").alias("codFornecedor"), F.lpad(F.col("o_custkey").cast("string"), 8, "9").alias("orgaoEntidadeCnpj"),
        F.lit(1).cast("bigint").alias("l_partkey"))
    return RG.company_roots(rows.unionByName(extra))


@job("registry_reduced", """
select concat(cnpj_basico, cnpj_ordem, cnpj_dv) as cnpj, e.razao_social
from {v_company} c left join (
  select lpad(cast(c_custkey as string), 8, '0') as b, c_name as razao_social from {customer} where c_custkey % 2 = 0) e on e.b = cnpj_basico
where cast(cnpj_basico as bigint) % 3 = 1""")
def _(v):
    companies = v.customer.where(F.col("c_custkey") % 2 == 0).select(
        F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("cnpj_basico"), F.col("c_name").alias("razao_social"))
    roots = v.v_company.where(F.col("cnpj_basico").cast("bigint") % 3 == 1).select(F.col("cnpj_basico").alias("root")).distinct()
    out, _partners = RG.registry_tables(companies, v.v_company, v.v_partner, roots)
    return out.select("cnpj", "razao_social")


def _registers(v):
    base = v.v_sanction.select(
        F.col("cnpj").alias("CPF OU CNPJ DO SANCIONADO"), F.col("ref").alias("CÓDIGO DA SANÇÃO"),
        F.date_format("start_on", "dd/MM/yyyy").alias("DATA INÍCIO SANÇÃO"), F.date_format("end_on", "dd/MM/yyyy").alias("DATA FINAL SANÇÃO"),
        F.col("register").alias("_r"))
    ceis = base.where(F.col("_r") == "CEIS").withColumn("CADASTRO", F.lit(" ")).drop("_r")
    cnep = base.where(F.col("_r") == "CNEP").withColumns({"CADASTRO": F.lit("CNEP"), "VALOR DA MULTA": F.lit("1")}).drop("_r")
    return SA.sanction_rows(ceis, cnep)


@job("sanction_windows", """
select cnpj, cast(start_on as string) as start_on, cast(end_on as string) as end_on, register, ref from {v_sanction}""")
def _(v):
    from lisura.operators.flags import sanction_windows

    return sanction_windows(_registers(v)).drop("ordinal")


@job("missing_registers", """
select r as register from (values ('CEIS'), ('CNEP')) t(r) where r not in (select register from {v_sanction} where ordinal = 2)""")
def _(v):
    return SA.missing_registers(v.v_sanction.where(F.col("ordinal") == 2).select(F.col("register").alias("CADASTRO")))


@job("releases_flat", """
select concat('ocds-914jxj-', o_orderkey) as ocid, case when o_orderkey % 4 > 0 then concat('r', o_orderkey) else '' end as id,
  concat('tender,', o_orderstatus) as tag, case when o_orderkey % 2 = 0 then o_orderpriority else o_orderstatus end as tender_title,
  o_orderkey % 3 = 0 as has_awards, o_orderkey % 4 > 0 as schema_ok from {orders}""")
def _(v):
    return RL.flatten_releases(_releases(v)).select("ocid", "id", "tag", "tender_title", "has_awards", "schema_ok")


def _releases(v):
    key = F.col("o_orderkey")
    award = F.create_map(F.lit("id"), F.lit("a"))
    return v.orders.select(
        F.concat(F.lit(RL.PREFIX), key).alias("ocid"), F.when(key % 4 > 0, F.concat(F.lit("r"), key)).alias("id"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"), F.array(F.lit("tender"), "o_orderstatus").alias("tag"),
        F.struct(key.cast("string").alias("id"), F.when(key % 2 == 0, F.col("o_orderpriority")).alias("title"),
                 F.col("o_orderstatus").alias("description")).alias("tender"),
        F.when(key % 3 == 0, F.array(award)).alias("awards"))


@job("releases_matching", """
with ids as (select cast(o_orderkey as string) as p from {orders} where o_orderkey % 5 = 0)
select distinct concat('ocds-914jxj-', o_orderkey) as ocid from {orders}
where concat('ocds-914jxj-', o_orderkey) in (select p from ids)
   or exists (select 1 from ids where p = right(cast(o_orderkey as string), length(p)))""")
def _(v):
    ids = v.orders.where(F.col("o_orderkey") % 5 == 0).select(F.col("o_orderkey").cast("string").alias("pncp_id"))
    return RL.matching_releases(RL.flatten_releases(_releases(v)), ids).select("ocid")


@job("releases_crosscheck", """
select count(*) as ocds_n, (select count(*) from {customer}) as purchases_n,
  (select count(*) from {customer} where c_custkey in (select o_orderkey from {orders})) as matched_n,
  count(*) filter (o_orderkey % 4 > 0) as schema_ok_n, count(*) filter (o_orderkey % 4 = 0) as schema_bad_n from {orders}""")
def _(v):
    ids = v.customer.select(F.col("c_custkey").cast("string").alias("pncp_id"))
    return RL.crosscheck(RL.flatten_releases(_releases(v)), ids)


@job("api_pages_flat", """
select concat(o_orderkey, '-1-x:', coalesce(l_linenumber, 0), ':', case when l_linenumber % 2 = 0 then l_suppkey else 0 end) as record_id,
  'b' as orgao_razao, case when l_linenumber is null then '' else concat('item ', l_linenumber) end as descricao,
  case when l_linenumber % 2 = 0 then lpad(cast(l_suppkey as string), 14, '0') else '' end as ni_fornecedor,
  cast(l_quantity as string) as quantidade, cast(o_totalprice as string) as valor_total_homologado
from {orders} left join (select distinct on (l_orderkey, l_linenumber) * from {lineitem} order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) l
  on l_orderkey = o_orderkey""")
def _(v):
    key = F.col("o_orderkey").cast("string")
    blank = F.lit(None).cast("string")
    contracts = v.orders.select(
        F.concat(key, F.lit("-1-x")).alias("numeroControlePNCP"), blank.alias("modalidadeId"), blank.alias("modalidadeNome"),
        blank.alias("objetoCompra"), F.col("o_totalprice").cast("string").alias("valorTotalHomologado"), blank.alias("dataPublicacaoPncp"),
        F.lit("2024").alias("anoCompra"), key.alias("sequencialCompra"),
        F.struct(F.lit("12345678000190").alias("cnpj"), F.lit("b").alias("razaoSocial"), blank.alias("esferaId"), blank.alias("poderId")).alias("orgaoEntidade"),
        F.struct(blank.alias("ufSigla"), blank.alias("municipioNome"), blank.alias("codigoIbge")).alias("unidadeOrgao"))
    line = F.col("l_linenumber").cast("string")
    first = v.lineitem.groupBy("l_orderkey", "l_linenumber").agg(
        F.min(F.struct("l_partkey", "l_suppkey", "l_quantity")).alias("m")).select("l_orderkey", "l_linenumber", "m.*")
    keys = [F.lit("12345678000190").alias("k_cnpj"), F.lit("2024").alias("k_ano"), F.col("l_orderkey").cast("string").alias("k_seq")]
    items = first.select(
        line.alias("numeroItem"), F.concat(F.lit("item "), line).alias("descricao"), blank.alias("materialOuServico"),
        F.col("l_quantity").cast("string").alias("quantidade"), blank.alias("unidadeMedida"), blank.alias("valorUnitarioEstimado"),
        blank.alias("valorTotal"), blank.alias("catalogoCodigoItem"),
        F.when(F.col("l_linenumber") % 2 == 0, "true").otherwise("false").alias("temResultado"), *keys)
    results = first.select(
        F.col("l_suppkey").cast("string").alias("sequencialResultado"), F.lpad(F.col("l_suppkey").cast("string"), 14, "0").alias("niFornecedor"),
        blank.alias("nomeRazaoSocialFornecedor"), blank.alias("tipoPessoa"), blank.alias("valorUnitarioHomologado"),
        blank.alias("quantidadeHomologada"), *keys, line.alias("k_item"))
    out = AP.contract_rows(contracts, items, results)
    return out.select("record_id", "orgao_razao", "descricao", "ni_fornecedor", "quantidade", "valor_total_homologado")


@job("snapshot_description", """
select count(*) as rows, strftime(max(o_orderdate), '%Y-%m-%d') as partition_date from {orders}""")
def _(v):
    """Size and date of a landing; its content id is checked against reordered rows in the tests."""
    return LA.describe_snapshot(v.orders, F.col("o_orderdate"), "2000-01-01").select("rows", "partition_date")


@job("pipe_tables", """
select case o_orderkey % 3 when 0 then 'LICITANTE' when 1 then 'LOTE' else 'ITEM' end as _table, o_orderkey as k,
       case o_orderkey % 3 when 0 then 'F' when 1 then 'a|b' else '"q' end as mark,
       case when o_orderkey % 3 > 0 then concat('L', o_custkey) end as lote from {orders}""")
def _(v):
    """Lines of three files: quoted separators and quotes, a column line in another order, a remittance line."""
    key, lot = F.col("o_orderkey").cast("string"), F.concat(F.lit("L"), "o_custkey")
    file = F.when(F.col("o_orderkey") % 3 == 0, "x/Licitante_1.txt").when(F.col("o_orderkey") % 3 == 1, "x/LOTE.TXT").otherwise("ITEM.txt")
    bidder = F.concat_ws("|", key, F.lit("2024"), F.lit("CNC"), F.lit("F"), F.lit("1"))
    lots = F.concat_ws("|", key, F.lit('"a|b"'), F.concat(F.lit('"'), lot, F.lit('"')))
    item = F.concat_ws("|", key, F.lit("2024"), F.lit('"""q"'), lot, F.lit("1"))
    lines = v.orders.select(file.alias("file"), F.when(F.col("o_orderkey") % 3 == 0, bidder).when(F.col("o_orderkey") % 3 == 1, lots).otherwise(item).alias("value"))
    one = v.nation.where("n_nationkey = 0")
    heads = one.select(F.lit("x/LOTE.TXT"), F.lit("nr_licitacao|CD TIPO MODALIDADE|NR_LOTE")).union(
        one.select(F.lit("ITEM.txt"), F.lit("89550032000174|01/01/2014|31/12/2014|31/01/2015|X|4"))).union(
        one.select(F.lit("x/pessoas.txt"), F.lit("1|2|3")))
    out = AU.pipe_rows(AU.pipe_lines(lines.union(heads)))
    mark = F.when(F.col("_table") == "LICITANTE", F.col("TP_DOCUMENTO_LICITANTE")).otherwise(F.col("CD_TIPO_MODALIDADE"))
    return out.select("_table", F.col("NR_LICITACAO").cast("bigint").alias("k"), mark.alias("mark"), F.col("NR_LOTE").alias("lote"))


@job("state_one_rows", """
select cast(o_orderkey as string) as edital, o_orderpriority as objeto from {orders} where o_orderkey % 4 < 2""")
def _(v):
    key = F.col("o_orderkey")
    place = F.when(key % 4 == 0, "  BAURÚ ").when(key % 4 == 1, "35.06003").when(key % 4 == 2, "Bauruzinho")
    named = {"Município": place, "Número do edital": key.cast("string"), "Objeto": F.col("o_orderpriority")}
    raw = v.orders.select(*[named.get(c, F.lit("x")).alias(c) for c in AU.STATE_ONE_COLUMNS])
    return AU.state_one_rows(raw).select(F.col("`Número do edital`").alias("edital"), F.col("Objeto").alias("objeto"))


# ---- entities ------------------------------------------------------------------


@job("buyer_entities", """
select orgao_cnpj as cnpj, any_value(orgao_razao) as "razaoSocial", any_value(uf) as uf from {v_item} group by 1""")
def _(v):
    return EN.buyers(v.v_item).select("cnpj", "razaoSocial", "uf")


@job("supplier_entities", """
select fornecedor_cnpj as cnpj, any_value(fornecedor_razao) as "razaoSocial", cast(any_value(opened_on) as string) as "openedOn"
from {v_item} group by 1""")
def _(v):
    return EN.suppliers(v.v_item).select("cnpj", "razaoSocial", "openedOn")


@job("contract_entities", """
select pncp_id as "pncpId", arg_max(snapshot_id, record_id) as "snapshotId", cast(any_value(ano) as bigint) as ano,
       strftime(max(publicado_em), '%Y-%m-%d %H:%M:%S') as "publicadoEm" from {v_item} group by 1""")
def _(v):
    return EN.contracts(v.v_item).select("pncpId", "snapshotId", "ano", "publicadoEm")


@job("item_entities", """
select distinct record_id as key, descricao, catmat, uf, quarter from {v_item}""")
def _(v):
    items = v.v_item.withColumn("descricao", F.concat_ws("|", "descricao", "record_id"))
    out = EN.item_rows(items)
    parts = F.split("descricao", "\\|")
    return out.select(parts[1].alias("key"), parts[0].alias("descricao"), "catmat", "uf", "quarter")


@job("item_facts_latest", """
select uf, quarter, count(*) as n, round(sum(valor_total), 2)::double as valor from (
  select *, row_number() over (partition by line_id, uf, quarter order by award_date desc, snapshot_id desc, record_hash desc) as rn
  from (select *, concat('h', record_id) as record_hash from {v_item}) i) t where rn = 1 group by 1, 2""")
def _(v):
    items = v.v_item.withColumn("record_hash", F.concat(F.lit("h"), "record_id"))
    latest = EN.latest_item_facts(items.withColumn("record_id", F.col("line_id")), "award_date")
    return latest.groupBy("uf", "quarter").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("valor_total"), 2).alias("valor"))


@job("new_items", """
select record_id from {v_item} where l_suppkey % 3 <> 0""")
def _(v):
    written = EN.item_rows(v.v_item.where(F.col("l_suppkey") % 3 == 0))
    return EN.new_items(v.v_item, written).select("record_id")


@job("exclusion_table", """
select reason, count(*) as n, count(distinct record_id) as items from (
  select record_id, 'qty_eq_1_collapse' as reason from {v_item} where quantidade = 1 and valor_unitario = valor_total
  union all select record_id, 'zero_or_negative' from {v_item_zero} where quantidade <= 0 or valor_unitario <= 0 or valor_total < 0) x
group by 1""")
def _(v):
    from lisura.operators import exclusions as EX

    tags = EX.quantity_one_collapse(v.v_item).unionByName(EX.zero_or_negative(v.v_item_zero))
    unknown = tags.withColumn("record_id", F.concat("record_id", F.lit("?")))
    rows = EN.exclusion_rows(tags.unionByName(unknown), v.v_item)
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("itemId").alias("items"))


@job("flag_table", """
with aged as (select *, datediff('day', opened_on, award_date) as age from {v_item})
select case when age < 90 then 'cnpj_age' else 'cnpj_age_info' end as kind, snapshot_id as "snapshotId", count(*) as n
from aged where age between 0 and 364 group by 1, 2""")
def _(v):
    from lisura.operators import flags as FL

    rows = EN.flag_rows(FL.company_age(v.v_item), v.v_item, version="v2")
    return rows.groupBy("kind", "snapshotId").agg(F.count_distinct("id").alias("n"))


@job("participant_table", """
select source, uf, count(*) as n, sum(case when winner then 1 else 0 end)::bigint as winners from {v_bid} group by 1, 2""")
def _(v):
    rows = EN.participant_rows(v.v_bid.unionByName(v.v_bid))
    return rows.groupBy("source", "uf").agg(F.count_distinct("id").alias("n"), F.count_if("winner").alias("winners"))


@job("screen_table", """
select 'bid_variance' as kind, "licitacaoId" as "subjectId" from {v_bid} group by 2 having count(*) >= 6""")
def _(v):
    big = v.v_bid.groupBy("licitacaoId").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 6)
    screens = big.select(
        F.lit("bid_variance").alias("kind"), F.col("licitacaoId").alias("subjectId"), "licitacaoId", F.lit("detected").alias("state"),
        F.lit("{}").alias("evidence"), F.lit("s").alias("snapshot_id"), F.lit("v1").alias("methodology_version"))
    return EN.screen_rows(screens.unionByName(screens)).select("kind", "subjectId")


@job("ordered_edges", """
select least(l_partkey, l_suppkey) as "leftCnpj", greatest(l_partkey, l_suppkey) as "rightCnpj",
       case when l_partkey > l_suppkey then l_tax else l_discount end as "leftProposta",
       case when l_partkey > l_suppkey then l_discount else l_tax end as "rightProposta"
from {lineitem} where l_partkey <> l_suppkey""")
def _(v):
    edges = v.lineitem.select(
        F.col("l_partkey").alias("leftCnpj"), F.col("l_suppkey").alias("rightCnpj"), F.col("l_discount").alias("leftProposta"),
        F.col("l_tax").alias("rightProposta"))
    return EN.ordered_edges(edges, (("leftProposta", "rightProposta"),))


@job("supplier_partners", """
with s as (select concat(lpad(cast(s_suppkey as string), 8, '0'), '000199') as cnpj from {supplier})
select distinct s.cnpj as "fornecedorCnpj", nome_socio as nome,
  case when identificador_de_socio = '2' then concat('***.', substr(cnpj_cpf_do_socio, 4, 3), '.', substr(cnpj_cpf_do_socio, 7, 3), '-**') end as "cpfMasked",
  coalesce(case when n_nationkey < 10 then n_name end, qualificacao_do_socio) as qualificacao
from {v_partner} p join s on substr(s.cnpj, 1, 8) = cnpj_basico left join {nation} on cast(n_nationkey as string) = qualificacao_do_socio""")
def _(v):
    suppliers = v.supplier.select(
        F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lpad(F.col("s_suppkey").cast("string"), 8, "0"), F.lit("000199")).alias("cnpj"))
    roles = v.nation.where(F.col("n_nationkey") < 10).select(
        F.col("n_nationkey").cast("string").alias("codigo"), F.col("n_name").alias("descricao"))
    return EN.partner_rows(v.v_partner, suppliers, roles).select("fornecedorCnpj", "nome", "cpfMasked", "qualificacao")


@job("activity_lookup", """
select cast(p_size as string) as codigo, arg_min(p_name, p_partkey) as descricao from {part} where p_partkey % 3 > 0 group by 1""")
def _(v):
    rows = v.part.select(
        F.concat(F.lit("-"), "p_size").alias("codigo"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_name")).otherwise(" ").alias("descricao"),
        F.col("p_partkey").alias("seq"))
    return EN.activity_lookup(rows, "seq")


# ---- upserts -------------------------------------------------------------------


@job("upsert_suppliers", """
with old as (select s_suppkey as k, s_name as name, 'c' as cnae, s_suppkey % 5 = 0 as suspended from {supplier} where s_suppkey % 3 > 0),
fresh as (select l_suppkey as k, max(l_partkey) as seq from {lineitem} where l_suppkey % 4 > 0 group by 1)
select coalesce(o.k, f.k) as cnpj, case when f.k is null then o.name else concat('n', f.seq) end as "razaoSocial",
  case when f.k is null then o.cnae when f.seq % 2 = 0 then 'd' else o.cnae end as cnae, coalesce(o.suspended, false) as suspended,
  case when o.k is null then '2024-05-01 00:00:00' else '2020-01-01 00:00:00' end as "createdAt",
  case when f.k is null then '2020-01-01 00:00:00' else '2024-05-01 00:00:00' end as "updatedAt"
from old o full join fresh f on o.k = f.k""")
def _(v):
    past = F.expr("timestamp '2020-01-01 00:00:00'")
    current = v.supplier.where(F.col("s_suppkey") % 3 > 0).select(
        F.col("s_suppkey").alias("cnpj"), F.col("s_name").alias("razaoSocial"), F.lit("c").alias("cnae"),
        (F.col("s_suppkey") % 5 == 0).alias("suspended"), past.alias("createdAt"), past.alias("updatedAt"))
    incoming = v.lineitem.where(F.col("l_suppkey") % 4 > 0).select(
        F.col("l_suppkey").alias("cnpj"), F.concat(F.lit("n"), "l_partkey").alias("razaoSocial"),
        F.when(F.col("l_partkey") % 2 == 0, "d").alias("cnae"), F.col("l_partkey").alias("_seq"))
    return EN.upsert(current, incoming, ["cnpj"], now(), keep_old_if_null=("cnae",), order=["_seq"]).select(
        "cnpj", "razaoSocial", "cnae", "suspended", "createdAt", "updatedAt")


@job("upsert_flags_refresh_delta", """
select e.event_id as id, case when event_id % 2 = 0 then 'new' else 'old' end as delta, case when event_id % 3 = 0 then 'v2' else 'v1' end as version
from {events} e where event_id % 3 > 0 or event_id % 2 = 0""")
def _(v):
    current = v.events.where(F.col("event_id") % 3 > 0).select(
        F.col("event_id").alias("id"), F.lit("old").alias("delta"), F.lit("v1").alias("version"))
    incoming = v.events.where(F.col("event_id") % 2 == 0).select(
        F.col("event_id").alias("id"), F.lit("new").alias("delta"), F.lit("v2").alias("version"))
    return EN.upsert(current, incoming, ["id"], now(), refresh_only=("delta",)).select("id", "delta", "version")


@job("insert_absent_codes", """
select distinct cast(p_partkey % 700 as string) as codigo, 'catmat' as kind from {part} where p_partkey % 700 >= 100""")
def _(v):
    current = v.part.where(F.col("p_partkey") < 100).select(F.col("p_partkey").cast("string").alias("codigo"), F.lit("catmat").alias("kind"))
    incoming = v.part.select((F.col("p_partkey") % 700).cast("string").alias("codigo"), F.lit("catmat").alias("kind"))
    return EN.insert_absent(current, incoming, ["codigo", "kind"])


@job("scan_participants", """
select "licitacaoId", participante from {v_bid} where uf = 'SP' and source = 'tce_sp'""")
def _(v):
    return EN.scan(v.v_bid, "licitacao_participante", uf="SP", source="tce_sp").select("licitacaoId", "participante")


@job("scan_edges_of_company", """
select a.participante as "leftCnpj", b.participante as "rightCnpj", a."licitacaoId"
from {v_bid} a join {v_bid} b on a."licitacaoId" = b."licitacaoId" and a.participante < b.participante
where a.participante = '00000000000003' or b.participante = '00000000000003'""")
def _(v):
    from lisura.operators.graph import cobid_edges

    return EN.scan(cobid_edges(v.v_bid), "co_bid_edge", endpoint="00000000000003").select("leftCnpj", "rightCnpj", "licitacaoId")


# ---- checks --------------------------------------------------------------------


@job("contract_violations", """
select 'orgao' as "table", 'esfera in set' as rule, id as key from {v_buyer} where esfera = 'estadual'
union all select 'orgao', 'unique cnpj', uf from {v_buyer} group by uf having count(*) > 1
union all select 'fornecedor', 'razaoSocial not null', cnpj from {v_seller} where suspended
union all select 'co_bid_edge', 'leftCnpj < rightCnpj', concat(l_partkey, '|', l_suppkey) from {lineitem} where not (l_partkey < l_suppkey)
union all select 'co_bid_edge', 'unique kind,leftCnpj,rightCnpj,licitacaoId,itemLote', concat('co_bid|', l_partkey, '|', l_suppkey, '|x|y')
  from {lineitem} group by l_partkey, l_suppkey having count(*) > 1""")
def _(v):
    mended = v.v_buyer.withColumns({
        "esfera": F.when(F.col("esfera") == "estadual", "outra").otherwise(F.col("esfera")), "cnpj": F.col("id")})
    by_uf = v.v_buyer.withColumns({"cnpj": F.col("uf"), "esfera": F.lit("federal")})
    sellers = v.v_seller.withColumn("razaoSocial", F.when(~F.col("suspended"), F.col("razaoSocial")))
    edges = v.lineitem.select(
        F.lit("co_bid").alias("kind"), F.col("l_partkey").alias("leftCnpj"), F.col("l_suppkey").alias("rightCnpj"),
        F.lit("x").alias("licitacaoId"), F.lit("y").alias("itemLote"))
    return CH.violations({"orgao": mended, "fornecedor": sellers, "co_bid_edge": edges}).unionByName(
        CH.violations({"orgao": by_uf}))


@job("official_urls", """
select 'limit' as "table", 'url on official host' as rule, cast(n_nationkey as string) as key from {nation} where n_nationkey % 3 > 0""")
def _(v):
    k = F.col("n_nationkey")
    urls = v.nation.select(
        k.alias("id"), F.when(k % 3 == 0, "https://www.Planalto.gov.br/x").when(k % 3 == 1, "https://planalto.gov.br.evil.example/").otherwise(
            "http://example.com/?u=gov.br").alias("url"))
    return CH.official_url(urls, "limit", "url", ["id"])


@job("same_content_check", """
select 'reordered' as what, count(*) as n_before, count(*) as n_after, true as unchanged from {lineitem}
union all select 'one value changed', count(*), count(*), count(*) filter (l_orderkey = (select min(l_orderkey) from {lineitem})) = 0 from {lineitem}
union all select 'rows left out', count(*), count(*) filter (l_linenumber > 1), count(*) filter (l_linenumber = 1) = 0 from {lineitem}""")
def _(v):
    rows = v.lineitem
    shuffled = rows.repartition(7, "l_partkey").select(*reversed(rows.columns))
    first = rows.agg(F.min("l_orderkey").alias("_first"))
    other = rows.join(first, F.col("l_orderkey") == F.col("_first"), "left").withColumn(
        "l_quantity", F.when(F.col("_first").isNotNull(), F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))).drop("_first")
    pairs = {"reordered": shuffled, "one value changed": other, "rows left out": rows.where("l_linenumber > 1")}
    return reduce(lambda a, b: a.unionByName(b), (
        CH.same_content(rows, after).select(F.lit(what).alias("what"), "*") for what, after in pairs.items()))
