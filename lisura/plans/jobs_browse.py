"""Checkable jobs: visibility, lists, denominators, coverage, search, lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from lisura.operators import coverage as CO
from lisura.operators import explorer as E
from lisura.operators import lifecycle as LC
from lisura.operators import search as SE
from lisura.plans.jobs import job


def tables(v) -> E.Tables:
    return E.Tables(v.v_buyer, v.v_seller, v.v_contract, v.v_line)


SHOWN_C = """shown_c as (select c.* from {v_contract} c join {v_buyer} b on b.id = c."orgaoId" where not c.suspended and not b.suspended)"""
OK_I = """ok_i as (select i.* from {v_line} i left join {v_seller} s on s.id = i."fornecedorId"
  where not i.suspended and not coalesce(s.suspended, false))"""
SHOWN_I = f"""{SHOWN_C}, {OK_I}, shown_i as (select i.* from ok_i i join shown_c c on c.id = i."contratacaoId")"""


def flat(df, *names):
    """Chosen columns and the coverage struct as plain columns."""
    return df.select(*names, F.col("coverage.n").alias("n"), F.col("coverage.uf").alias("cov_uf"),
                     F.col("coverage.quarter").alias("cov_quarter"), F.col("coverage.methodologyVersion").alias("cov_version"))


@job("visible_items", f"with {SHOWN_I} select id from shown_i")
def _(v):
    return E.visible_items(tables(v)).select("id")


@job("visible_contracts", f"with {SHOWN_C} select id from shown_c")
def _(v):
    return E.visible_contracts(tables(v)).select("id")


@job("suspension_list", """
select 'orgao' as kind, id, suspended or (cast(substr(id, 2) as bigint) % 5 = 1) as suspended from {v_buyer}
union all select 'fornecedor', id, suspended or (cast(substr(id, 2) as bigint) % 5 = 1) from {v_seller}""")
def _(v):
    """Suspend by list, on top of what is suspended already."""
    def listed(df, kind):
        return df.where(F.substring("id", 2, 20).cast("bigint") % 5 == 1).select(F.lit(kind).alias("kind"), "id")

    t = tables(v)
    after = E.suspend(t, listed(t.buyers, "orgao").unionByName(listed(t.suppliers, "fornecedor")))
    return after.buyers.select(F.lit("orgao").alias("kind"), "id", "suspended").unionByName(
        after.suppliers.select(F.lit("fornecedor").alias("kind"), "id", "suspended"))


SQL_BUYER_N = f"""{OK_I}, counts as (
  select c."orgaoId" as id, count(*) as n from ok_i i join {{v_contract}} c on c.id = i."contratacaoId"
  where not c.suspended and i."methodologyVersion" = 'v1' %s group by 1)"""


@job("buyers_with_coverage", f"""
with {SQL_BUYER_N % "and i.quarter = '1997-Q2'"}
select b.id, coalesce(n, 0) as n, uf as cov_uf, '1997-Q2' as cov_quarter, 'v1' as cov_version
from {{v_buyer}} b left join counts using (id) where not suspended""")
def _(v):
    t = tables(v)
    return flat(E.with_buyer_coverage(E.visible_buyers(t), t, "v1", "1997-Q2"), "id")


@job("list_buyers", f"""
with {SQL_BUYER_N % ""}
select b.id, "razaoSocial", coalesce(n, 0) as n, uf as cov_uf, '' as cov_quarter, 'v1' as cov_version
from {{v_buyer}} b left join counts using (id)
where not suspended and ("razaoSocial" like '%1%' or cnpj like '%1%') and esfera = 'municipal'
order by "razaoSocial", id limit 20 offset 5""")
def _(v):
    return flat(E.list_buyers(tables(v), "v1", q="1", esfera="municipal", skip=5, take=20), "id", "razaoSocial")


SQL_SUPPLIER_N = f"""{SHOWN_C}, counts as (
  select i."fornecedorId" as id, count(*) as n from {{v_line}} i join shown_c c on c.id = i."contratacaoId"
  where not i.suspended and i."methodologyVersion" = 'v1' and i.uf = 'NATION_3' group by 1)"""


@job("suppliers_with_coverage", f"""
with {SQL_SUPPLIER_N}
select s.id, coalesce(n, 0) as n, 'NATION_3' as cov_uf, '' as cov_quarter, 'v1' as cov_version
from {{v_seller}} s left join counts using (id) where not suspended""")
def _(v):
    t = tables(v)
    return flat(E.with_supplier_coverage(E.visible_suppliers(t), t, "v1", uf="NATION_3"), "id")


@job("list_suppliers", f"""
with {SQL_SUPPLIER_N}
select s.id, coalesce(n, 0) as n, 'NATION_3' as cov_uf, '' as cov_quarter, 'v1' as cov_version
from {{v_seller}} s left join counts using (id)
where not suspended and ("razaoSocial" like '%2%' or cnpj like '%2%') order by "razaoSocial", id limit 100""")
def _(v):
    return flat(E.list_suppliers(tables(v), "v1", q="2", uf="NATION_3", take=1000), "id")


SQL_CONTRACT_N = """counts as (
  select i."contratacaoId" as id, count(*) filter (not i.suspended and not coalesce(s.suspended, false)) as n, max(i.quarter) as q
  from {v_line} i left join {v_seller} s on s.id = i."fornecedorId" group by 1)"""


@job("contracts_with_coverage", f"""
with {SHOWN_C}, {SQL_CONTRACT_N}
select c.id, b."razaoSocial" as "orgaoRazaoSocial", coalesce(n, 0) as n, b.uf as cov_uf, coalesce(q, '') as cov_quarter,
       c."methodologyVersion" as cov_version
from shown_c c join {{v_buyer}} b on b.id = c."orgaoId" left join counts on counts.id = c.id""")
def _(v):
    t = tables(v)
    return flat(E.with_contract_coverage(E.visible_contracts(t), t), "id", "orgaoRazaoSocial")


@job("list_contracts", f"""
with {SHOWN_C}, {SQL_CONTRACT_N},
sold as (select distinct i."contratacaoId" as id from {{v_line}} i join {{v_seller}} s on s.id = i."fornecedorId"
         where i."fornecedorId" = 's2' and not i.suspended and not s.suspended)
select c.id, strftime(c."publicadoEm", '%Y-%m-%d %H:%M:%S') as "publicadoEm", coalesce(n, 0) as n, b.uf as cov_uf,
       coalesce(q, '') as cov_quarter, c."methodologyVersion" as cov_version
from shown_c c join {{v_buyer}} b on b.id = c."orgaoId" left join counts on counts.id = c.id
where c.id in (select id from sold) and c."methodologyVersion" = 'v1' and c.objeto like '%Objeto%'
order by c."publicadoEm" desc nulls first, c.id limit 50""")
def _(v):
    return flat(E.list_contracts(tables(v), q="Objeto", supplier="s2", version="v1"), "id", "publicadoEm")


@job("list_items", f"""
with {SHOWN_I}, universe as (select * from shown_i where descricao like '%ring%' and uf = 'NATION_3'),
counted as (
  select *, count(*) over (partition by uf, quarter, "methodologyVersion") as n_all,
         count(*) over (partition by uf, quarter, "methodologyVersion", catmat) as n_code from universe)
select id, descricao, case when catmat is null then n_all else n_code end as n, uf as cov_uf, quarter as cov_quarter,
       "methodologyVersion" as cov_version
from counted order by descricao, id limit 100 offset 10""")
def _(v):
    return flat(E.list_items(tables(v), q="ring", uf="NATION_3", skip=10, take=100), "id", "descricao")


@job("list_flags", """
select concat('f', event_id) as id, concat('i', flag_id) as "itemId", action as kind from {v_event}
where action = 'review' order by 3, 2, 1 limit 100 offset 0""")
def _(v):
    flags = v.v_event.select(
        F.concat(F.lit("f"), "event_id").alias("id"), F.concat(F.lit("i"), "flag_id").alias("itemId"),
        F.col("action").alias("kind"), F.lit("detected").alias("state"))
    return E.list_flags(flags, kind="review", state="detected", take=500, skip=-3).drop("state")


@job("page_coverage", f"""
with {SHOWN_I} select count(*) as n, 'NATION_4' as uf, '' as quarter, 'v1' as "methodologyVersion"
from shown_i where uf = 'NATION_4' and "methodologyVersion" = 'v1'""")
def _(v):
    rows = E.filter_items(tables(v), uf="NATION_4", version="v1")
    return E.page_coverage(rows, "v1", uf="NATION_4")


@job("item_details", f"""
with {SHOWN_I}, counted as (
  select *, count(*) over (partition by uf, quarter, "methodologyVersion") as n_all,
         count(*) over (partition by uf, quarter, "methodologyVersion", catmat) as n_code from shown_i)
select i.id, c."pncpId" as "contratacaoPncpId", b."razaoSocial" as "orgaoRazaoSocial", s."razaoSocial" as "fornecedorRazaoSocial",
       case when i.catmat is null then n_all else n_code end as n, i.uf as cov_uf, i.quarter as cov_quarter,
       i."methodologyVersion" as cov_version
from counted i join {{v_contract}} c on c.id = i."contratacaoId" join {{v_buyer}} b on b.id = c."orgaoId"
  left join {{v_seller}} s on s.id = i."fornecedorId" """)
def _(v):
    return flat(E.item_details(tables(v)), "id", "contratacaoPncpId", "orgaoRazaoSocial", "fornecedorRazaoSocial")


@job("contract_item_rows", f"""
with {SHOWN_I}
select c."pncpId", i.id, i.descricao from shown_c c left join shown_i i on i."contratacaoId" = c.id""")
def _(v):
    return E.contract_item_rows(tables(v)).select("pncpId", "id", "descricao")


AS_OF = "2001-08-15"


@job("supplier_details", f"""
with aged as (
  select *, datediff('month', "openedOn", date '{AS_OF}') - case when day("openedOn") > 15 then 1 else 0 end as m from {{v_seller}}),
parts as (select *, m // 12 as y, m % 12 as r from aged where not suspended)
select p.id, n_name as "cnaeDescricao",
  case when "openedOn" > date '{AS_OF}' then 'n/d' when m = 0 then 'menos de 1 mês'
       else concat_ws(' e ', case when y = 1 then '1 ano' when y > 1 then concat(y, ' anos') end,
                      case when r = 1 then '1 mês' when r > 1 then concat(r, ' meses') end) end as "idadeCadastral"
from parts p left join {{nation}} on concat('00', n_nationkey) = replace(cnae, '-', '')""")
def _(v):
    activities = v.nation.select(F.concat(F.lit("00"), "n_nationkey").alias("codigo"), F.col("n_name").alias("descricao"))
    out = E.supplier_details(tables(v), activities, "v1", F.to_date(F.lit(AS_OF)))
    return out.select("id", "cnaeDescricao", "idadeCadastral")


@job("supplier_partner_rows", """
select s.id as "fornecedorId", s."razaoSocial", p.nome_socio as nome
from {v_seller} s join {v_partner} p on cast(p.cnpj_basico as bigint) % 10 = cast(substr(s.id, 2) as bigint) where not s.suspended""")
def _(v):
    partners = v.v_partner.select(
        F.concat(F.lit("s"), F.col("cnpj_basico").cast("bigint") % 10).alias("fornecedorId"), F.col("nome_socio").alias("nome"),
        F.lit(None).cast("string").alias("cpfMasked"), F.lit(None).cast("string").alias("qualificacao"))
    return E.supplier_partner_rows(tables(v), partners).select("fornecedorId", "razaoSocial", "nome")


# ---- coverage ------------------------------------------------------------------


@job("covered_cities", f"""
with {SHOWN_C} select distinct b."municipioNome" as nome, b.uf, b."municipioIbge" as ibge
from shown_c c join {{v_buyer}} b on b.id = c."orgaoId" """)
def _(v):
    return CO.covered_cities(tables(v))


@job("counts_per_year", f"""
with {SHOWN_I}
select ano as year, count(distinct c.id) as purchases, count(i.id) as items
from shown_c c left join shown_i i on i."contratacaoId" = c.id group by 1""")
def _(v):
    return CO.counts_per_year(tables(v))


@job("coded_share", f"""
with {SHOWN_I}
select count(*) as n_items, count(*) filter (catmat is not null and cast(catmat as bigint) % 3 = 0 and cast(catmat as bigint) > 0) as n_coded,
       round(100.0 * count(*) filter (catmat is not null and cast(catmat as bigint) % 3 = 0 and cast(catmat as bigint) > 0) / count(*), 2)::double as percent
from shown_i""")
def _(v):
    catalog = v.part.where(F.col("p_partkey") % 3 == 0).select(
        F.concat("p_partkey", F.lit(".0")).alias("codigo"), F.lit("M").alias("tipo"))
    return CO.coded_share(E.visible_items(tables(v)), CO.catalog_codes(catalog))


@job("catalog_codes", """
select distinct cast(p_partkey as string) as codigo, case when p_size % 2 = 0 then 'catser' else 'catmat' end as kind
from {part} where p_partkey > 0""")
def _(v):
    return CO.catalog_codes(v.part.select(
        F.col("p_partkey").cast("string").alias("codigo"), F.when(F.col("p_size") % 2 == 0, "serviço").alias("tipo")))


@job("single_valued_labels", """
select 'one' as what, count(*) as n, 'NATION_5' as uf, '' as quarter from {v_line} where uf = 'NATION_5'
union all select 'all', count(*), '', '' from {v_line}""")
def _(v):
    one, every = CO.single_labels(v.v_line.where(F.col("uf") == "NATION_5")), CO.single_labels(v.v_line)
    return one.select(F.lit("one").alias("what"), "*").unionByName(every.select(F.lit("all").alias("what"), "*"))


@job("coverage_report", f"""
with {SHOWN_I}
select count(*) as n_items, count(*) filter (cast(catmat as bigint) % 3 = 1) as n_coded,
       round(100.0 * count(*) filter (cast(catmat as bigint) % 3 = 1) / count(*), 2)::double as percent,
       count(*) as n, '' as uf, '' as quarter, (select count(*) from shown_c) as n_purchases, 'v1' as "methodologyVersion"
from shown_i""")
def _(v):
    catalog = v.part.where(F.col("p_partkey") % 3 == 1).select(F.col("p_partkey").alias("codigo"), F.lit("M").alias("tipo"))
    return CO.coverage_report(tables(v), CO.catalog_codes(catalog), "v1")


SOURCES = (("signup", "federal_purchases"), ("view", "ocds"), ("never", "tce_sp"))


@job("source_freshness", """
with names as (select * from (values ('signup', 'federal_purchases'), ('view', 'ocds'), ('never', 'tce_sp')) n(source, name)),
sums as (select event_type as source, sum(user_id)::bigint as n, max(ts) as last, max_by(event_id, ts) as snap from {events} group by 1)
select name, coalesce(n, 0) as n, strftime(last, '%Y-%m-%d %H:%M:%S') as "lastUpdate", concat('s', snap) as "snapshotId"
from names left join sums using (source) where n > 0
union all select name, 0, null, null from names left join sums using (source) where n is null""")
def _(v):
    manifests = v.events.select(
        F.col("event_type").alias("source"), F.col("user_id").alias("rows"), F.col("ts").alias("written_at"),
        F.concat(F.lit("s"), "event_id").alias("snapshot_id"))
    return CO.source_freshness(manifests, SOURCES)


@job("flag_counts_by_day", """
select action as kind, cast(cast(ts as date) as string) as day, count(*) as n from {v_event} group by 1, 2
union all select 'cnpj_age', null, 0""")
def _(v):
    flags = v.v_event.select(F.col("action").alias("kind"), F.col("ts").alias("detectedAt"))
    return CO.flag_counts(flags, ("cnpj_age", "review", "notify"))


@job("flag_counts_single_day", """
select action as kind, '2024-01-07' as day, count(*) as n from {v_event} where cast(ts as date) = date '2024-01-07' group by 1
union all select 'cnpj_age', null, 0""")
def _(v):
    flags = v.v_event.where(F.col("ts").cast("date") == F.to_date(F.lit("2024-01-07")))
    return CO.flag_counts(flags.select(F.col("action").alias("kind"), F.col("ts").alias("detectedAt")), ("cnpj_age",))


@job("table_counts", """
select 'orgao' as "table", count(*) as n from {v_buyer} union all select 'fornecedor', count(*) from {v_seller}
union all select 'contratacao', count(*) from {v_contract} union all select 'item', count(*) from {v_line}""")
def _(v):
    t = tables(v)
    return CO.table_counts({"orgao": t.buyers, "fornecedor": t.suppliers, "contratacao": t.contracts, "item": t.items})


# ---- search --------------------------------------------------------------------

DOCS = """
docs as (select concat('orgao_', id) as id, 'orgao' as kind, id as "entityId", "razaoSocial" as text from {v_buyer} where not suspended
  union all select concat('fornecedor_', id), 'fornecedor', id, "razaoSocial" from {v_seller} where not suspended
  union all select concat('item_', id), 'item', id, descricao from {v_line} where not suspended)"""


@job("search_documents", f"with {DOCS} select * from docs")
def _(v):
    return SE.require_text(SE.search_documents(tables(v)))


@job("search_bad_documents", """
select concat('item_', id) as id from {v_line} where not suspended and descricao like 'red%'""")
def _(v):
    t = tables(v)
    blanked = t.items.withColumn("descricao", F.when(~F.col("descricao").startswith("red"), F.col("descricao")))
    return SE.bad_documents(SE.search_documents(E.Tables(t.buyers, t.suppliers, t.contracts, blanked))).select("id")


@job("search_stale_documents", f"""
with {DOCS} select concat('item_', id) as id from {{v_line}} where concat('item_', id) not in (select id from docs)""")
def _(v):
    indexed = v.v_line.select(F.concat(F.lit("item_"), "id").alias("id"))
    return SE.stale_documents(indexed, SE.search_documents(tables(v)))


@job("search_totals", f"""
with {DOCS}, kinds as (select * from (values ('orgao'), ('fornecedor'), ('item')) k(kind))
select kinds.kind, count(docs.id) as total from kinds left join docs on docs.kind = kinds.kind and lower(text) like '%bolt%'
group by 1""")
def _(v):
    return SE.search_totals(SE.search_documents(tables(v)), "BÓLT")


@job("search_hits", f"""
with {SHOWN_I}, {DOCS},
ranked as (select *, row_number() over (partition by kind order by lower(text), id) as rank from docs where lower(text) like '%r%1%' or lower(text) like '%r%')
select kind, "entityId", rank from ranked where rank > 2 and rank <= 12
  and (kind <> 'item' or "entityId" in (select id from shown_i))""")
def _(v):
    hits = SE.search(SE.search_documents(tables(v)), "R", skip=2, take=10)
    return SE.visible_hits(hits, tables(v)).select("kind", "entityId", "rank")


@job("search_in_documents", """
select doc_id from {documents} where lower(strip_accents(text)) like '%tion on%'""")
def _(v):
    docs = v.documents.select("doc_id", "text")
    return SE.matching(docs, "TIÓN on").select("doc_id")


# ---- flag lifecycle ------------------------------------------------------------

REPLAY = """
recursive_events as (
  select *, row_number() over (partition by flag_id order by ts, event_id) as k from {v_event}),
walk as (
  select flag_id, cast(0 as bigint) as k, 'detected' as state, 'detected' as from_state, cast(null as timestamp) as notified,
         false as accepted, cast(null as bigint) as event_id, '' as action, blocked
  from {v_flag}
  union all
  select w.flag_id, e.k,
    case when e.action = 'review' and w.state = 'detected' then 'internal_review'
         when e.action = 'notify' and w.state = 'internal_review' then 'notified'
         when e.action = 'publish' and w.state = 'notified' and e.ts >= w.notified + interval 7 days and not w.blocked then 'published'
         when e.action = 'resolve' and w.state = 'published' then 'resolved'
         when e.action = 'retract' and w.state = 'published' then 'retracted' else w.state end,
    w.state,
    case when e.action = 'notify' and w.state = 'internal_review' then e.ts else w.notified end,
    (e.action = 'review' and w.state = 'detected') or (e.action = 'notify' and w.state = 'internal_review')
      or (e.action = 'publish' and w.state = 'notified' and e.ts >= w.notified + interval 7 days and not w.blocked)
      or (e.action in ('resolve', 'retract') and w.state = 'published')
      or (e.action = 'reply' and w.state not in ('detected', 'internal_review')),
    e.event_id, e.action, w.blocked
  from walk w join recursive_events e on e.flag_id = w.flag_id and e.k = w.k + 1)"""


@job("flag_final_states", f"""
with recursive {REPLAY},
last as (select flag_id, max_by(state, k) as state, max(notified) as notified from walk group by 1)
select flag_id, state, strftime(notified, '%Y-%m-%d %H:%M:%S') as notified_at from last""")
def _(v):
    return LC.final_states(v.v_flag, v.v_event).select("flag_id", "state", "notified_at")


@job("flag_judged_events", f"""
with recursive {REPLAY}
select event_id, from_state, accepted, case when accepted then state end as to_state from walk where k > 0""")
def _(v):
    return LC.judged_events(v.v_flag, v.v_event).select("event_id", "from_state", "accepted", "to_state")


@job("flag_audit", f"""
with recursive {REPLAY}
select flag_id, cast(null as string) as from_state, 'detected' as to_state, cast(null as bigint) as event_id from {{v_flag}}
union all select flag_id, from_state, state, event_id from walk where accepted and action <> 'reply'""")
def _(v):
    judged = LC.judged_events(v.v_flag, v.v_event)
    return LC.audit_rows(v.v_flag, judged).select("flag_id", "from_state", "to_state", "event_id")


@job("flag_rejected_events", f"""
with recursive {REPLAY} select event_id, action, from_state from walk where k > 0 and not accepted""")
def _(v):
    return LC.rejected_events(LC.judged_events(v.v_flag, v.v_event)).select("event_id", "action", "from_state")


@job("new_flag_validation", """
select event_id as request,
  case when event_id % 7 = 0 then 'Request is invalid' when event_id % 2 = 1 then 'Item not found' end as problem,
  case when event_id % 7 <> 0 and event_id % 2 = 0 then 'detected' end as state
from {events}""")
def _(v):
    text = F.lit("x")
    requests = v.events.select(
        F.col("event_id").alias("request"), F.col("event_id").alias("itemId"), F.when(F.col("event_id") % 7 != 0, "k").alias("kind"),
        *[text.alias(c) for c in ("delta", "sourceUrl", "snapshotId", "methodologyVersion")])
    items = v.events.where(F.col("event_id") % 2 == 0).select(F.col("event_id").alias("id"))
    return LC.validate_new_flags(requests, items).select("request", "problem", "state")
