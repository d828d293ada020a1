"""Checkable jobs: data errors, indicators, outliers."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from lisura.operators import exclusions as EX
from lisura.operators import flags as FL
from lisura.operators import outliers as OU
from lisura.operators.stats import group_median
from lisura.plans.jobs import job

TAG = "record_id, pncp_id, reason, detail, snapshot_id, methodology_version"

MISMATCH = """
abs(quantidade * valor_unitario - valor_total) > 0.02
and cast(abs(quantidade * valor_unitario - valor_total) as double)
    / greatest(abs(cast(valor_total as double)), abs(cast(quantidade * valor_unitario as double)), 1) > 0.002"""

SQL_MISMATCH = f"""
select record_id, pncp_id, 'qty_unit_price_neq_total' as reason,
       concat('qty * unit_price != total_value. qty=', quantidade, ' unit_price=', valor_unitario,
              ' product=', quantidade * valor_unitario, ' total=', valor_total) as detail,
       snapshot_id, methodology_version
from {{v_item}} where {MISMATCH}"""


@job("exclusion_qty_price_mismatch", SQL_MISMATCH)
def _(v):
    return EX.qty_price_mismatch(v.v_item)


SQL_SHIFT = """
with peers as (
  select *, median(cast(valor_unitario as double)) over (partition by catmat) as med,
         count(*) over (partition by catmat) as n
  from {v_item} where valor_unitario > 0),
mags as (select *, abs(log10(cast(valor_unitario as double) / med)) as mag from peers where n >= 3 and med > 0)
select record_id, pncp_id, 'decimal_shift' as reason,
       concat('unit_price is a 100x or 1000x shift from peer median. peer=catmat:', catmat, ' price=', valor_unitario,
              ' median=', cast(med as decimal(18,6)), ' abs_log10=', printf('%.4f', mag)) as detail,
       snapshot_id, methodology_version
from mags where mag between 1.8 and 2.2 or mag between 2.8 and 3.2"""


@job("exclusion_decimal_shift", SQL_SHIFT)
def _(v):
    return EX.decimal_shift(v.v_item)


SQL_COLLAPSE = """
select record_id, pncp_id, 'qty_eq_1_collapse' as reason,
       concat('quantidade==1 and unit_price==total_value. qty=', quantidade, ' unit_price=', valor_unitario,
              ' total=', valor_total) as detail, snapshot_id, methodology_version
from {v_item} where quantidade = 1 and valor_unitario = valor_total"""


@job("exclusion_quantity_one_collapse", SQL_COLLAPSE)
def _(v):
    return EX.quantity_one_collapse(v.v_item)


SQL_ZERO = """
select record_id, pncp_id, 'zero_or_negative' as reason,
       concat('non-positive money or qty. ', concat_ws(' ',
         case when quantidade <= 0 then concat('quantidade=', quantidade) end,
         case when valor_unitario <= 0 then concat('valor_unitario=', valor_unitario) end,
         case when valor_total < 0 then concat('valor_total=', valor_total) end)) as detail,
       snapshot_id, methodology_version
from {v_item_zero} where quantidade <= 0 or valor_unitario <= 0 or valor_total < 0"""


@job("exclusion_zero_or_negative", SQL_ZERO)
def _(v):
    return EX.zero_or_negative(v.v_item_zero)


SQL_DUP = """
with ranked as (
  select *, row_number() over w as rn, first_value(record_id) over w as canon
  from {v_item_repeat}
  window w as (partition by pncp_id, id_compra_item, quantidade, valor_unitario
               order by record_id, snapshot_id, methodology_version))
select record_id, pncp_id, 'duplicate_row' as reason,
       concat('duplicate pncp+item+money. canonical_record_id=', canon, ' pncp_id=', pncp_id, ' item=', id_compra_item)
         as detail, snapshot_id, methodology_version
from ranked where rn > 1"""


@job("exclusion_duplicate_rows", SQL_DUP)
def _(v):
    return EX.duplicate_rows(v.v_item_repeat)


@job("exclusion_identical_copies", """
select name as record_id, 'x' as pncp_id, 'duplicate_row' as reason,
       concat('duplicate pncp+item+money. canonical_record_id=', name, ' pncp_id=x item=', name) as detail,
       '' as snapshot_id, '' as methodology_version
from (select c_mktsegment as name, row_number() over (partition by c_mktsegment order by c_custkey) as rn from {customer}) c
where rn > 1""")
def _(v):
    """Rows equal in everything, record id included: all but one copy."""
    segment = F.col("c_mktsegment")
    return EX.duplicate_rows(v.customer.select(
        segment.alias("record_id"), F.lit("x").alias("pncp_id"), segment.alias("descricao"),
        F.lit("").alias("snapshot_id"), F.lit("").alias("methodology_version"),
        *[F.lit(None).cast("decimal(18,6)").alias(c) for c in ("quantidade", "valor_unitario", "valor_total")],
    )).withColumn("record_id", F.col("record_id")).withColumn(
        "detail", F.concat(F.lit("duplicate pncp+item+money. canonical_record_id="), "record_id",
                           F.lit(" pncp_id=x item="), "record_id"))


def _price_table(v):
    price = F.replace(F.col("p_retailprice").cast("string"), F.lit("."), F.lit(","))
    return v.part.select(
        (F.col("p_partkey") % 500).cast("string").alias("Código Item"),
        F.when(F.col("p_partkey") % 7 == 0, "-1").otherwise(price).alias("Valor Referência"),
        F.col("p_partkey").alias("seq"))


@job("catalog_reference_prices", """
select cast(p_partkey % 500 as string) as codigo, max_by(p_retailprice, p_partkey) as preco
from {part} where p_partkey % 7 <> 0 group by 1""")
def _(v):
    return EX.reference_prices(_price_table(v), seq="seq")


SQL_MAGNITUDE = """
with refs as (
  select i.*, coalesce(case when l_linenumber = 5 then 9.5 end, case when l_suppkey % 2 = 0 then p_retailprice end) as ref
  from {v_item} i join {part} on i.catmat = cast(p_partkey as string))
select record_id, pncp_id, 'catalog_magnitude' as reason, snapshot_id, methodology_version
from refs where valor_unitario > 0 and (cast(valor_unitario as double) > 100 * ref or 100 * cast(valor_unitario as double) < ref)"""


@job("exclusion_catalog_magnitude", SQL_MAGNITUDE)
def _(v):
    own = F.when(F.col("l_linenumber") == 5, F.lit(Decimal("9.5"))).cast("decimal(18,6)")
    # A service code stands in for every other supplier, so both lookups are used.
    items = v.v_item.withColumn("valor_referencia", own).withColumn(
        "catser", F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("s"), "catmat"))).withColumn("catmat", F.lit("none"))
    prices = v.part.select(F.concat(F.lit("s"), "p_partkey").alias("codigo"),
                           F.col("p_retailprice").cast("decimal(18,6)").alias("preco"))
    return EX.catalog_magnitude(items, prices).drop("detail")


ALL_ERRORS = " union all ".join(
    f"select record_id, reason from ({sql}) t{i}" for i, sql in enumerate((SQL_MISMATCH, SQL_COLLAPSE)))
SQL_ALL = f"""
with shifted as ({SQL_SHIFT}),
found as ({ALL_ERRORS} union all select record_id, reason from shifted)
select record_id, reason from found"""


@job("exclusions_all", SQL_ALL)
def _(v):
    return EX.detect_data_errors(v.v_item).select("record_id", "reason")


@job("exclusions_all_priced", f"""
{SQL_ALL} union all
select record_id, 'catalog_magnitude' as reason from {{v_item}} join {{part}} on catmat = cast(p_partkey as string)
where p_partkey % 3 = 0 and valor_unitario > 0 and (cast(valor_unitario as double) > 100 * p_retailprice / 250 or cast(valor_unitario as double) * 100 < p_retailprice / 250)""")
def _(v):
    """All reasons with a price table, whose prices are a 250th of the list for a third of the codes."""
    prices = v.part.where("p_partkey % 3 = 0").select(
        F.col("p_partkey").cast("string").alias("codigo"), (F.col("p_retailprice") / 250).cast("decimal(18,6)").alias("preco"))
    return EX.detect_data_errors(v.v_item, prices).select("record_id", "reason")


@job("comparable_items", f"""
with shifted as ({SQL_SHIFT}),
found as ({ALL_ERRORS} union all select record_id, reason from shifted)
select record_id, pncp_id, valor_unitario::double as valor_unitario
from {{v_item}} where record_id not in (select record_id from found)""")
def _(v):
    return EX.comparable_items(v.v_item, EX.detect_data_errors(v.v_item)).select("record_id", "pncp_id", "valor_unitario")


@job("exact_group_median", """
select codigo_classe, uf, count(*) as n, round(median(cast(valor_total as double)), 4) as median from {v_item} group by 1, 2""")
def _(v):
    out = group_median(v.v_item, ["codigo_classe", "uf"], "valor_total")
    return out.withColumn("median", F.round(F.col("median").cast("double"), 4))


# ---- indicators ----------------------------------------------------------------


@job("flag_company_age", """
with aged as (select *, datediff('day', opened_on, award_date) as age from {v_item})
select record_id, pncp_id, case when age < 90 then 'cnpj_age' else 'cnpj_age_info' end as kind,
       concat('opened_on=', opened_on, ' award_date=', award_date, ' age_days=', age,
              ' tier=', case when age < 90 then 'flag' else 'info' end) as delta,
       '' as source_url, snapshot_id, methodology_version
from aged where age between 0 and 364""")
def _(v):
    return FL.company_age(v.v_item)


@job("flag_sanctioned_supplier", """
with hits as (
  select i.*, s.register, s.ref,
         row_number() over (partition by record_id order by ordinal, start_on, register, ref) as rn
  from {v_item} i join {v_sanction} s on i.fornecedor_cnpj = s.cnpj
  where (start_on is null or award_date >= start_on) and (end_on is null or award_date <= end_on))
select record_id, pncp_id, 'sanctioned_ceis_cnep' as kind,
       concat('fornecedor CNPJ overlaps ', register, ' sanction window on award_date=', award_date, '. ref=', ref) as delta,
       '' as source_url, snapshot_id, methodology_version
from hits where rn = 1""")
def _(v):
    return FL.sanctioned(v.v_item, v.v_sanction)


@job("waiver_purchases", """
select record_id, modalidade, modalidade_codigo from {v_item}
where modalidade_codigo = '8' or lower(modalidade) like '%dispensa%'""")
def _(v):
    return FL.waiver_items(v.v_item).select("record_id", "modalidade", "modalidade_codigo")


@job("purchase_class_key", """
select record_id,
  case when l_suppkey % 5 = 0 then concat('codigo_classe:', codigo_classe)
       when l_suppkey % 5 = 1 then concat('codigo_grupo:', descricao)
       when l_suppkey % 5 = 2 then concat('codigo_classe:', codigo_classe, '-m')
       when l_suppkey % 5 = 3 then concat('codigo_classe:', substr(lpad(catmat, 6, '9'), 1, 4))
       else concat('item:', catmat) end as class_key
from {v_item}""")
def _(v):
    k = F.col("l_suppkey") % 5
    items = v.v_item.select(
        "record_id", F.when(k == 0, F.col("codigo_classe")).alias("codigo_classe"),
        F.when(k == 1, F.col("descricao")).alias("codigo_grupo"),
        F.when(k == 3, F.lpad("catmat", 6, "9")).otherwise(F.col("catmat")).alias("catmat"),
        F.when(k == 2, F.concat("codigo_classe", F.lit("-m"))).alias("map_classe"),
        F.lit(None).cast("string").alias("map_grupo"))
    return items.select("record_id", FL.class_key(items).alias("class_key"))


SPLIT_LINES = """
lines as (select *, cast(year(award_date) as int) as y from {source} where modalidade_codigo = '8'),
purchases as (
  select orgao_cnpj, codigo_classe, y, id_compra, sum(valor_total) as amount, min(award_date) as awarded
  from lines group by 1, 2, 3, 4),
groups as (
  select p.orgao_cnpj, p.codigo_classe, p.y, count(*) as n, sum(amount) as total, max(amount) as top, any_value(l.lim) as lim
  from purchases p join (select year, amount as lim from {{v_limit}} where kind = 'other') l on l.year = p.y
  group by 1, 2, 3),
runs as (
  select p.orgao_cnpj, p.codigo_classe, p.y, p.awarded,
         count(*) over w as run_n, sum(amount) over w as run_sum
  from purchases p join groups g using (orgao_cnpj, codigo_classe, y)
  where amount >= lim * 0.9 and amount < lim
  window w as (partition by p.orgao_cnpj, p.codigo_classe, p.y order by p.awarded
               range between current row and interval 90 days following)),
best as (
  select *, row_number() over (partition by orgao_cnpj, codigo_classe, y order by run_n desc, awarded) as rn
  from runs where run_n >= 3),
chosen as (
  select g.*, b.awarded as first_day, b.run_n, b.run_sum
  from groups g left join best b on b.rn = 1 and b.orgao_cnpj = g.orgao_cnpj and b.codigo_classe = g.codigo_classe and b.y = g.y
  where b.run_n is not null or (g.n >= 2 and g.top < g.lim and g.total > g.lim))
select l.record_id, l.pncp_id, case when first_day is null then 'fracionamento' else 'fracionamento_cluster' end as kind,
       concat('indicio Art. 75 par.1 same-object annual aggregate. orgao=', l.orgao_cnpj, ' class_key=codigo_classe:',
              l.codigo_classe, ' year=', l.y, ' n=', coalesce(run_n, n), ' sum=',
              cast(coalesce(run_sum, total) as decimal(18,6)), ' threshold=', lim, ' decree=d1 kind=other rule=',
              case when first_day is null then 'over_sum' else 'cluster' end) as delta,
       '' as source_url, l.snapshot_id, l.methodology_version
from lines l
  join chosen c on c.orgao_cnpj = l.orgao_cnpj and c.codigo_classe = l.codigo_classe and c.y = l.y
  join purchases p on p.orgao_cnpj = l.orgao_cnpj and p.codigo_classe = l.codigo_classe and p.y = l.y and p.id_compra = l.id_compra
where first_day is null
   or (p.amount >= lim * 0.9 and p.amount < lim and p.awarded between first_day and first_day + 90)"""


def _split_sql(source: str) -> str:
    return "with " + SPLIT_LINES.replace("{source}", "{" + source + "}").replace("{{", "{").replace("}}", "}")


@job("flag_split_purchases", _split_sql("v_item"))
def _(v):
    return FL.split_purchases(v.v_item, v.v_limit)


@job("flag_split_purchases_cluster", _split_sql("v_item_band"))
def _(v):
    return FL.split_purchases(v.v_item_band, v.v_limit)


ALLOWED = (("ECON", ["1", "2"]), ("SMAL", ["3"]), ("PROM", ["44", "5"]))


@job("flag_activity_mismatch", """
with rules as (select * from (values ('ECON', '1,2', '^(1|2)'), ('SMAL', '3', '^3'), ('PROM', '44,5', '^(44|5)')) r(classe, allowed, pat)),
codes as (select *, cast(l_suppkey as string) as c1, cast(l_suppkey * 7 as string) as c2 from {v_item})
select record_id, pncp_id, 'cnae_mismatch' as kind,
       concat('indicio CATMAT class outside winner CNAE allow-list. class=', classe, ' cnae=', c1, ' secondary=',
              case when c1 = c2 then '' else c2 end, ' allowed=', allowed, ' table=1') as delta,
       '' as source_url, snapshot_id, methodology_version
from codes join rules on classe = substr(codigo_classe, 1, 4)
where not regexp_matches(c1, pat) and not regexp_matches(c2, pat)""")
def _(v):
    allowed = v.part.sparkSession.createDataFrame(list(ALLOWED), "classe string, prefixes array<string>")
    return FL.activity_mismatch(v.v_item, allowed)


SQL_EDITS = """
with hist as (
  select *, lag(record_hash) over w as old_hash, lag(snapshot_id) over w as old_snap,
         lag(valor_unitario_resultado) over w as p1, lag(quantidade) over w as q1,
         lag(fornecedor_cnpj) over w as f1, lag(fornecedor_razao) over w as r1
  from {v_version} window w as (partition by record_id order by snapped_on, snapshot_id, record_hash)),
hits as (
  select *, row_number() over (partition by record_id order by snapped_on desc, snapshot_id desc, record_hash desc) as rn
  from hist where old_hash is not null and snapped_on > gate
    and (valor_unitario_resultado <> p1 or quantidade <> q1 or fornecedor_cnpj <> f1 or fornecedor_razao <> r1))
select record_id, pncp_id, snapshot_id, record_hash as new_hash, old_hash, old_snap as old_snapshot_id,
       concat_ws(',', case when fornecedor_cnpj <> f1 then 'fornecedor_cnpj' end,
                 case when fornecedor_razao <> r1 then 'fornecedor_razao' end,
                 case when quantidade <> q1 then 'quantidade' end,
                 case when valor_unitario_resultado <> p1 then 'valor_unitario_resultado' end) as changed
from hits where rn = 1"""


@job("flag_retroactive_edit", SQL_EDITS)
def _(v):
    out = FL.retroactive_edits(v.v_version)

    def part(path):
        return F.get_json_object("delta", path)

    return out.select(
        "record_id", "pncp_id", "snapshot_id", part("$.new_hash").alias("new_hash"), part("$.old_hash").alias("old_hash"),
        part("$.old_snapshot_id").alias("old_snapshot_id"),
        F.array_join(F.json_object_keys(part("$.fields")), ",").alias("changed"))


@job("flags_all", f"""
with aged as (select record_id, datediff('day', opened_on, award_date) as age from {{v_item}})
select record_id, 'qty_unit_price_neq_total' as kind from {{v_item}} where {MISMATCH}
union all
select record_id, case when age < 90 then 'cnpj_age' else 'cnpj_age_info' end as kind from aged where age between 0 and 364
union all
select distinct record_id, 'sanctioned_ceis_cnep' as kind from {{v_item}} i join {{v_sanction}} s on i.fornecedor_cnpj = s.cnpj
where (start_on is null or award_date >= start_on) and (end_on is null or award_date <= end_on)""")
def _(v):
    """All indicators together; the split and activity rules find nothing under the published tables here."""
    return FL.detect_flags(v.v_item, sanctions=v.v_sanction).select("record_id", "kind")


# ---- outliers ------------------------------------------------------------------

SQL_SCORED = """
with banded as (
  select record_id, concat('code:', catmat) as peer, uf, quarter,
         case when quantidade <= 1 then '1' when quantidade <= 10 then '2-10' when quantidade <= 100 then '11-100'
              when quantidade <= 1000 then '101-1000' else '1001+' end as band,
         cast(valor_unitario as double) as price,
         abs(quantidade * valor_unitario - valor_total) > greatest(0.05, 0.01 * abs(cast(valor_total as double))) as data_error
  from {v_item} where valor_unitario > 0),
centred as (
  select *, median(price) over (partition by uf, quarter, band, substr(peer, 1, 7)) as median,
         count(*) over (partition by uf, quarter, band, substr(peer, 1, 7)) as n from banded),
spread as (
  select *, abs(price - median) as deviation,
         median(abs(price - median)) over (partition by uf, quarter, band, substr(peer, 1, 7)) as mad from centred)
select record_id, uf, quarter, band, n, round(median, 4) as median, round(mad, 4) as mad, data_error,
       round(round(case when mad < 1e-9 then price / median else deviation / mad end, 9), 3) as score from spread"""


def _peered(v):
    """Items whose code is cut short, so that peer groups have several members."""
    return v.v_item.withColumn("catmat", F.substring("catmat", 1, 2))


@job("outlier_scores", SQL_SCORED)
def _(v):
    return OU.scored_prices(_peered(v)).select(
        "record_id", "uf", "quarter", "band", "n", F.round(F.col("median").cast("double"), 4).alias("median"),
        F.round(F.col("mad").cast("double"), 4).alias("mad"), "data_error", F.round("score", 3).alias("score"))


@job("outliers_top_100", f"""
with scored as ({SQL_SCORED.replace("round(round(case", "round((case").replace("end, 9), 3)", "end), 9)")})
select record_id, round(score, 3) as score, row_number() over (order by score desc, record_id) as rank
from scored order by score desc, record_id limit 100""")
def _(v):
    return OU.top_outliers(_peered(v)).select("record_id", F.round("score", 3).alias("score"), "rank")


SQL_TOP = f"""
scored as ({SQL_SCORED.replace("select record_id, uf, quarter, band, n,", "select record_id, peer, price, deviation, uf, quarter, band, n,")
            .replace("round(round(case", "round((case").replace("end, 9), 3)", "end), 9)").replace("round(median, 4)", "median").replace("round(mad, 4)", "mad")}),
top as (select * from scored order by score desc, record_id limit 100)"""


@job("outlier_review_peers", f"""
with {SQL_TOP},
pairs as (
  select t.record_id, s.record_id as peer_record_id, s.price as peer_price, s.median,
         row_number() over (partition by t.record_id order by round(s.deviation, 6), s.record_id) as peer_rank
  from top t join scored s on substr(t.peer, 1, 7) = substr(s.peer, 1, 7) and t.uf = s.uf and t.quarter = s.quarter
    and t.band = s.band and t.record_id <> s.record_id)
select record_id, peer_rank, peer_record_id, peer_price, round(median, 4) as median from pairs where peer_rank <= 3""")
def _(v):
    scored = OU.scored_prices(_peered(v))
    top = OU.top_outliers(_peered(v))
    return OU.review_peers(top, scored).withColumn("median", F.round(F.col("median").cast("double"), 4))


@job("label_precision", f"""
with {SQL_TOP},
labelled as (
  select i.record_id, case when quality = 1 and toxic = 0 then 'real' when quality = 1 then 'unit error'
         when toxic = 1 then 'data error' else 'spec difference' end as label
  from {{v_item}} i join {{labels}} on i.l_orderkey % 400 = doc_id),
joined as (select label from (select * from scored order by score desc, record_id limit 2000) t join labelled using (record_id))
select count(*) as n_labelled, count(*) filter (label = 'real') as n_real,
       count(*) filter (label = 'unit error') as n_unit_error,
       count(*) filter (label = 'spec difference') as n_spec_difference,
       count(*) filter (label = 'data error') as n_data_error,
       round(avg(case when label = 'real' then 1.0 else 0.0 end), 9) as precision from joined""")
def _(v):
    label = (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "real").when(F.col("quality") == 1, "unit error")
        .when(F.col("toxic") == 1, "data error").otherwise("spec difference"))
    labels = v.v_item.join(v.labels, F.col("l_orderkey") % 400 == F.col("doc_id")).select(
        "record_id", label.alias("label"), F.lit(2).alias("labeled_at"))
    older = labels.withColumns({"label": F.lit("data error"), "labeled_at": F.lit(1)})
    out = OU.label_precision(OU.top_outliers(_peered(v), 2000), labels.unionByName(older))
    return out.withColumn("precision", F.round("precision", 9))
