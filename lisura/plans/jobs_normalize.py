"""Checkable jobs: parsing, catalog and unit matching, classification, ids, privacy."""

from __future__ import annotations

from pyspark.sql import functions as F

from lisura.functions import identity as I
from lisura.functions import text as X
from lisura.operators import classify as K
from lisura.operators import normalize as N
from lisura.operators import privacy as P
from lisura.operators.specs import with_spec_fields
from lisura.operators.units import match_units
from lisura.plans.jobs import job
from lisura.sources import purchases as PU

# Unit texts by line number, and what each must become.
UNIT_TEXTS = (
    ("UN.", "un", "1"), ("Cx c/ 12", "un", "12"), ("FRASCO 20,00 ML", "l", "0.02"), ("Pacote(s)", "pct", "1"),
    ("KG LÍQUIDO", "kg", "1"), ("cx 10 latas", "un", "10"), ("FOOBAR", "unknown", "1"),
)


def unit_case(what: int) -> str:
    return "case l_linenumber " + " ".join(
        f"when {i + 1} then '{row[what]}'" for i, row in enumerate(UNIT_TEXTS)) + " end"


def unit_text():
    out = F.lit(None).cast("string")
    for i, row in enumerate(UNIT_TEXTS):
        out = F.when(F.col("l_linenumber") == i + 1, row[0]).otherwise(out)
    return out


def br(c):
    """Decimal text with a comma and dots between thousands."""
    return F.translate(F.format_number(c, 2), ",.", ".,")


def raw_rows(v):
    """The sample lines as landed text with official headers."""
    i = v.v_item
    k = F.col("l_suppkey")
    day = F.col("publicado_em")
    return i.select(
        F.col("record_id").alias("record_id"), F.concat(F.lit("h"), "record_id").alias("record_hash"),
        F.col("pncp_id").alias("idCompra"), F.concat_ws("-", F.lit("12345678000190-1"), "ano", F.lpad("pncp_id", 6, "0")).alias("numeroControlePNCP"),
        F.when(k % 2 == 0, F.col("catmat")).alias("codItemCatalogo"),
        F.when(k % 3 == 0, F.upper(F.replace("descricao", F.lit("o"), F.lit("ó")))).otherwise(F.initcap("descricao")).alias("Descrição Detalhada"),
        F.when(k % 5 == 0, "S").otherwise("M").alias("materialOuServico"), unit_text().alias("Unidade Medida"),
        br("quantidade").alias("quantidade"), br("valor_unitario").alias("valorUnitarioResultado"),
        F.col("valor_total").cast("decimal(18,2)").cast("string").alias("valorTotal"),
        F.date_format(day, "dd/MM/yyyy HH:mm:ss").alias("dataPublicacaoPncp"), F.date_format("award_date", "yyyyMMdd").alias("dataResultado"),
        F.concat(F.substring("fornecedor_cnpj", 1, 8), F.lit("/"), F.substring("fornecedor_cnpj", 9, 6)).alias("codFornecedor"),
        F.when(k % 4 != 0, F.col("fornecedor_razao")).alias("nomeFornecedor"), F.lit("E").alias("orgaoEntidadeEsferaId"),
        F.lower("uf").alias("unidadeOrgaoUfSigla"), F.lit("snapX").alias("snapshot_id"),
    )


def name_catalog(v):
    """One material per part name; the widgets are services."""
    rows = v.part.groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    return rows.select(
        F.concat(F.lit("9"), F.lpad(F.col("k").cast("string"), 6, "0")).alias("codigo"), F.col("p_name").alias("descricao"),
        F.when(F.col("p_name").endswith("widget"), "S").otherwise("M").alias("tipo"), F.col("k").alias("seq"))


def company_file(v):
    return v.supplier.select(
        F.lpad(F.col("s_suppkey").cast("string"), 14, "0").alias("CNPJ"), F.lit("20200131").alias("data_inicio_atividade"),
        F.concat(F.lit("47"), F.col("s_suppkey")).alias("cnae_fiscal_principal"), F.upper("s_name").alias("razao_social"))


CATALOG = """
cat as (select p_name, concat('9', lpad(cast(min(p_partkey) as string), 6, '0')) as codigo, p_name like '%widget' as svc
        from {part} group by 1)"""


@job("normalized_items", f"""
with {CATALOG}
select record_id, cast(quantidade as double) as quantidade, cast(valor_unitario as double) as valor_unitario,
  cast(valor_total as double) as valor_total, cast(award_date as string) as award_date,
  strftime(publicado_em, '%Y-%m-%d %H:%M:%S') as publicado_em, quarter, ano, upper(uf) as uf, fornecedor_cnpj,
  case when l_suppkey % 4 = 0 then upper(fornecedor_razao) else fornecedor_razao end as fornecedor_razao,
  '2020-01-31' as opened_on, concat('47', l_suppkey) as cnae, 'estadual' as esfera, 'snapX' as snapshot_id,
  case when l_suppkey % 2 = 0 then case when l_suppkey % 5 = 0 then null else catmat end
       when not svc and l_suppkey % 5 <> 0 then codigo end as catmat,
  case when l_suppkey % 2 = 0 then case when l_suppkey % 5 = 0 then catmat end
       when svc and l_suppkey % 5 = 0 then codigo end as catser,
  case when l_suppkey % 2 = 0 or svc = (l_suppkey % 5 = 0) then 'exact' else 'none' end as catmat_match_quality,
  {unit_case(1)} as unidade_canonica,
  case when {unit_case(1)} <> 'unknown' then round(cast(valor_unitario as double) / cast({unit_case(2)} as double), 6) end as valor_por_unidade_canonica
from {{v_item}} join cat on p_name = descricao""")
def _(v):
    # The catalog lists unlike names only, so nothing is left to approximate matching.
    out = N.normalize_items(raw_rows(v), N.catalog_table(name_catalog(v)), company_file(v), version="v1")
    near = F.col("catmat_match_quality") == "knn"
    return out.select(
        "record_id", "quantidade", "valor_unitario", "valor_total", "award_date", "publicado_em", "quarter", "ano", "uf",
        "fornecedor_cnpj", "fornecedor_razao", "opened_on", "cnae", "esfera", "snapshot_id",
        F.when(~near, F.col("catmat")).alias("catmat"), F.when(~near, F.col("catser")).alias("catser"),
        F.when(near, "none").otherwise(F.col("catmat_match_quality")).alias("catmat_match_quality"), "unidade_canonica",
        F.round(F.col("valor_por_unidade_canonica").cast("double"), 6).alias("valor_por_unidade_canonica"))


@job("catalog_table", """
select concat('9', lpad(cast(min(p_partkey) as string), 6, '0')) as codigo, p_name as descricao,
       case when p_name like '%widget' then 'S' else 'M' end as tipo from {part} group by p_name""")
def _(v):
    raw = name_catalog(v).withColumnsRenamed({"codigo": "Código", "descricao": "Nome", "tipo": "Natureza"})
    return N.catalog_table(raw).select("codigo", "descricao", "tipo")


@job("catalog_match", f"""
with {CATALOG}, asked as (
  select distinct p_name as descricao, case when p_size % 3 = 0 then cast(p_partkey as string) end as codigo,
         case when p_size % 2 = 0 then 'M' else 'X' end as tipo from {{part}})
select descricao, a.codigo, tipo,
  case when a.codigo is not null then a.codigo when not svc then c.codigo end as catmat,
  case when a.codigo is null and svc and tipo <> 'M' then c.codigo end as catser
from asked a join cat c on c.p_name = descricao where not (a.codigo is null and svc and tipo = 'M')""")
def _(v):
    asked = v.part.select(
        F.col("p_name").alias("descricao"), F.when(F.col("p_size") % 3 == 0, F.col("p_partkey").cast("string")).alias("codigo"),
        F.when(F.col("p_size") % 2 == 0, "M").otherwise("X").alias("tipo"))
    service = F.col("descricao").endswith("widget") & F.col("codigo").isNull() & (F.col("tipo") == "M")
    out = N.match_catalog(asked.where(~service), N.catalog_table(name_catalog(v)))
    return out.drop("catmat_match_quality")


@job("unit_match", f"""
select distinct {unit_case(0)} as unidade_medida, {unit_case(1)} as unidade_canonica,
       cast({unit_case(2)} as double) as fator from {{lineitem}} where l_linenumber between 1 and 7""")
def _(v):
    out = match_units(v.lineitem.select(unit_text().alias("unidade_medida")).where(F.col("unidade_medida").isNotNull()))
    return out.select("unidade_medida", "unidade_canonica", "fator")


@job("unit_match_sizes", """
with t as (select l_partkey + 1 as n, l_linenumber % 4 as k from {lineitem}),
u as (select distinct n, k from t)
select case k when 0 then concat('Caixa c/ ', n, ' UN') when 1 then concat('resma ', n, ' Folhas') when 2 then concat('frasco ', n, ',5 ml') else concat('FARDO/', n, ' kg.') end as unidade_medida,
  case k when 0 then 'un' when 1 then 'folha' when 2 then 'l' else 'kg' end as unidade_canonica,
  case k when 2 then round((n + 0.5) * 0.001, 6)::double else n::double end as fator from u""")
def _(v):
    """Packs of every size that the lines have."""
    k, n = F.col("l_linenumber") % 4, (F.col("l_partkey") + 1).cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit("Caixa c/ "), n, F.lit(" UN"))).when(k == 1, F.concat(F.lit("resma "), n, F.lit(" Folhas")))
        .when(k == 2, F.concat(F.lit("frasco "), n, F.lit(",5 ml"))).otherwise(F.concat(F.lit("FARDO/"), n, F.lit(" kg."))))
    return match_units(v.lineitem.select(text.alias("unidade_medida"))).select("unidade_medida", "unidade_canonica", "fator")


@job("spec_fields", """
select p_partkey, case when p_size % 4 = 0 then concat(p_size, 'mg/ml') end as spec_concentracao,
  case when p_size % 4 = 1 then concat(p_size, ',5mg') when p_size % 4 = 2 then concat(p_size, 'comprimidos') end as spec_dosagem,
  case when p_size % 4 = 0 then '20ml' when p_size % 4 = 1 then 'a4' when p_size % 4 = 3 then concat(p_size, 'g') end as spec_tamanho
from {part}""")
def _(v):
    n = F.col("p_size").cast("string")
    text = (
        F.when(F.col("p_size") % 4 == 0, F.concat("p_name", F.lit(" SÓDICA "), n, F.lit(" MG / ML sol 20 ml")))
        .when(F.col("p_size") % 4 == 1, F.concat("p_name", F.lit(" "), n, F.lit(",5 Mg papel A4")))
        .when(F.col("p_size") % 4 == 2, F.concat("p_name", F.lit(" c/ "), n, F.lit(" Comprimidos")))
        .otherwise(F.concat("p_name", F.lit(" "), n, F.lit(" g"))))
    return with_spec_fields(v.part.select("p_partkey", text.alias("descricao"))).drop("descricao")


@job("price_per_unit", """
select record_id, round(case when l_linenumber % 2 = 0 then cast(valor_unitario as double)
    else cast(valor_total as double) / nullif(cast(quantidade as double), 0) end / 12 + 1e-6, 3) as price from {v_item}""")
def _(v):
    unit = F.when(F.col("l_linenumber") % 2 == 0, F.col("valor_unitario"))
    # Both sides add the same little, so that halves round alike in decimals and doubles.
    price = N.price_per_unit(F.lit("parsed"), F.lit(12).cast(X.MONEY), unit, F.col("quantidade"), F.col("valor_total"))
    return v.v_item.select("record_id", F.round(price.cast("double") + 1e-6, 3).alias("price"))


@job("unit_packs", """
select distinct t as unidade_medida, u as unidade_canonica, f as fator from (
  select concat('CX C/ ', p_size) as t, 'un' as u, cast(p_size as double) as f from {part}
  union all select concat('Frasco ', p_size, ',5 ML'), 'l', (p_size + 0.5) / 1000 from {part}
  union all select concat('resma com ', p_size, ' folhas'), 'folha', p_size from {part}
  union all select concat(p_size, ' kg'), 'kg', p_size from {part}
  union all select concat('caixa especial ', p_brand), 'cx', 1 from {part})""")
def _(v):
    n = F.col("p_size").cast("string")
    texts = F.array(
        F.concat(F.lit("CX C/ "), n), F.concat(F.lit("Frasco "), n, F.lit(",5 ML")), F.concat(F.lit("resma com "), n, F.lit(" folhas")),
        F.concat(n, F.lit(" kg")), F.concat(F.lit("caixa especial "), "p_brand"))
    out = match_units(v.part.select(F.explode(texts).alias("unidade_medida")))
    return out.select("unidade_medida", "unidade_canonica", "fator")


@job("contract_keys", """
select distinct '12345678000190' as cnpj, year(o_orderdate) as ano, o_orderkey as seq from {orders} where o_orderkey % 5 < 4""")
def _(v):
    pncp = F.when(F.col("o_orderkey") % 5 < 2, F.concat(
        F.lit("12.345.678/0001-90-1-"), F.lpad("k", 9, "0"), F.lit("/"), F.year("o_orderdate"))).when(
        F.col("o_orderkey") % 5 < 4, F.concat_ws("-", F.lit("12345678000190-1"), F.year("o_orderdate"), "k")).otherwise(
        F.concat(F.lit("not a key "), "k"))
    pncp = F.replace(pncp, F.lit("12.345.678/0001-90"), F.lit("12345678000190"))
    rows = v.orders.withColumn("k", F.col("o_orderkey").cast("string")).select(pncp.alias("numeroControlePNCP"))
    return N.contract_keys(rows)


@job("item_keys", """
select distinct '12345678000190' as cnpj, 2024 as ano, l_orderkey as seq, l_linenumber as item from {lineitem}""")
def _(v):
    return N.item_keys(v.lineitem.select(
        F.concat(F.lit("12345678000190-1-"), "l_orderkey", F.lit("/2024")).alias("numero_controle_pncp"),
        F.col("l_linenumber").cast("string").alias("numero_item")))


@job("gap_rows", """
select o_orderkey as k from {orders} where o_orderkey % 3 = 0 or o_orderkey % 10 = 1""")
def _(v):
    key = F.col("o_orderkey")
    pages = v.orders.select(
        key.alias("k"), F.when(key % 10 == 1, F.concat(F.lit("odd "), key)).otherwise(
            F.concat(F.lit("12345678000190-1-"), key, F.lit("/2024"))).alias("numero_controle_pncp"))
    bulk = v.orders.where(key % 3 != 0).select(F.concat(F.lit("12345678000190-1-2024-"), key).alias("numerocontrolepncp"))
    return N.gap_rows(pages, N.contract_keys(bulk)).select("k")


@job("gap_items", """
select concat('r', o_orderkey) as record_id, concat('Compra ', min(l_linenumber)) as descricao
from {orders} join {lineitem} on l_orderkey = o_orderkey where o_orderkey % 3 = 0 group by o_orderkey""")
def _(v):
    key = F.col("l_orderkey")
    pages = v.lineitem.select(
        F.concat(F.lit("12345678000190-1-"), key, F.lit("/2024")).alias("numero_controle_pncp"),
        F.concat(F.lit("r"), key).alias("record_id"), F.concat(F.lit("Compra "), "l_linenumber").alias("descricao"),
        F.col("l_linenumber").alias("snapshot_id"), F.lit("1").alias("codItemCatalogo"),
        F.concat(F.lit("h"), "l_linenumber").alias("record_hash"))
    bulk = v.orders.where(F.col("o_orderkey") % 3 != 0).select(
        F.concat(F.lit("12345678000190-1-2024-"), "o_orderkey").alias("numerocontrolepncp"))
    out = N.normalize_gaps(pages, bulk, N.catalog_table(name_catalog(v)))
    return out.select("record_id", "descricao")


# ---- classification ------------------------------------------------------------

KNN = """
texts as (select distinct concat(p_name, ' ', lower(p_brand), '#', p_size % 3) as t, 'q' as side, cast(null as string) as codigo, cast(null as bigint) as k from {part}
  union all select p_name, 'c', concat('9', lpad(cast(min(p_partkey) as string), 6, '0')), min(p_partkey) from {part} group by p_name),
distinct_texts as (select distinct t, concat(' ', t, ' ') as p from texts),
grams as (
  select t, substr(p, i, w) as g from distinct_texts, (values (3), (4)) n(w), range(1, 200) r(i) where i <= length(p) - w + 1),
tf as (
  select t, g, count(*) as c, sum(count(*)) over (partition by t) as total from grams group by 1, 2),
hashed as (
  select t, (cast(concat('0x', substr(sha256(g), 1, 2)) as int) + 256 * cast(concat('0x', substr(sha256(g), 3, 2)) as int)) % 4096 as b,
         case when cast(concat('0x', substr(sha256(g), 9, 2)) as int) % 2 = 0 then 1.0 else -1.0 end * c / total as x from tf),
weights as (select t, b, sum(x) as x from hashed group by 1, 2),
docs as (select t, count(*) as m from texts where side = 'c' group by 1),
idf as (select b, ln(((select sum(m) from docs) + 1.0) / (sum(m) + 1.0)) + 1.0 as idf from weights join docs using (t) group by 1),
vec as (select t, b, x * coalesce(idf, 1.0) as x from weights left join idf using (b)),
unit as (select t, b, x / sqrt(sum(x * x) over (partition by t)) as x from vec),
sims as (select q.t as q, c.t as c, least(greatest(sum(a.x * e.x), 0.0), 1.0) as s
  from texts q join unit a on a.t = q.t join unit e on e.b = a.b join texts c on c.t = e.t and c.side = 'c'
  where q.side = 'q' group by 1, 2),
ranked as (select q, k, codigo, s, row_number() over (partition by q order by s desc, k) as r
  from sims join texts c on c.side = 'c' and c.t = sims.c),
best as (select q, max(case when r = 1 then s end) as s1, coalesce(max(case when r = 2 then s end), 0) as s2,
  max(case when r = 1 then codigo end) as codigo from ranked group by 1)"""


def knn_queries(v):
    text = F.concat("p_name", F.lit(" "), F.lower("p_brand"), F.lit("#"), F.col("p_size") % 3)
    return v.part.select(X.fold(text).alias("folded"), F.lit("").alias("kind")).distinct()


def plain_catalog(v):
    return N.catalog_table(name_catalog(v).withColumn("tipo", F.lit("M")))


@job("classified_texts", f"""
with {KNN}
select q as folded, case when s1 >= 0.72 and s1 - s2 >= 0.18 then codigo end as catmat,
       case when s1 >= 0.72 and s1 - s2 >= 0.18 then 'knn' else 'none' end as quality,
       round(s1, 6) as top1, round(s2, 6) as top2 from best""")
def _(v):
    out = K.nearest_entries(knn_queries(v), plain_catalog(v))
    return out.select(
        "folded", "catmat", "quality", F.round("top1", 6).alias("top1"), F.round("top2", 6).alias("top2"))


@job("classifier_cache", f"""
with {KNN}
select concat(sha256(q), ':') as hash, case when s1 >= 0.72 and s1 - s2 >= 0.18 then codigo end as catmat,
  round(s1, 6) as top1, round(s2, 6) as top2
from best where hash(q) is not null and length(q) % 2 = 0""")
def _(v):
    """Only texts that are not in the cache are scored."""
    asked = knn_queries(v)
    cached = asked.where(F.length("folded") % 2 == 1).select(K.description_key(F.col("folded"), F.col("kind")).alias("hash"))
    return K.score_new(asked, plain_catalog(v), cached).select("hash", "catmat", F.round("top1", 6).alias("top1"), F.round("top2", 6).alias("top2"))


# ---- ids, hashes, privacy ------------------------------------------------------


@job("entity_ids", """
with h as (
  select record_id, sha1(unhex('6b1c0a7e4d2f4c919b3a0f8e2d17a5c4') || encode(concat('item:', pncp_id, ':', record_id))) as i,
         sha1(unhex('6b1c0a7e4d2f4c919b3a0f8e2d17a5c4') || encode(concat('orgao:', orgao_cnpj))) as b from {v_item})
select record_id,
  concat(substr(i, 1, 8), '-', substr(i, 9, 4), '-5', substr(i, 14, 3), '-', translate(substr(i, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab'),
         substr(i, 18, 3), '-', substr(i, 21, 12)) as item_id,
  concat(substr(b, 1, 8), '-', substr(b, 9, 4), '-5', substr(b, 14, 3), '-', translate(substr(b, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab'),
         substr(b, 18, 3), '-', substr(b, 21, 12)) as buyer_id from h""")
def _(v):
    return v.v_item.select(
        "record_id", I.item_id(F.col("pncp_id"), F.col("record_id")).alias("item_id"), I.buyer_id(F.col("orgao_cnpj")).alias("buyer_id"))


@job("record_identity", """
select case when l_linenumber = 1 then concat('line', l_partkey) else concat(l_orderkey, ':', l_linenumber) end as record_id,
       count(*) as n, count(distinct concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_quantity)) as versions
from {lineitem} group by 1""")
def _(v):
    rows = v.lineitem.select(
        F.col("l_orderkey").cast("string").alias("idcompra"), F.col("l_linenumber").cast("string").alias("numeroitemcompra"),
        F.when(F.col("l_linenumber") == 1, F.concat(F.lit("line"), "l_partkey")).alias("idcompraitem"),
        F.col("l_partkey").cast("string").alias("part"), F.col("l_quantity").cast("string").alias("quantidade"))
    out = I.with_record_identity(rows)
    return out.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("record_hash").alias("versions"))


@job("table_fingerprint", "select count(*) as n from {lineitem}")
def _(v):
    """Content id of a table; equal whatever the order of rows (see tests)."""
    one = I.fingerprint(v.lineitem)
    named = one.select("n", I.snapshot_id_of(F.col("n"), F.col("h1"), F.col("h2")).alias("snapshot_id"))
    return named.where(F.length("snapshot_id") > 0).select("n")


@job("masked_persons", """
select row_id, regexp_replace(a, '([0-9]{3})([0-9]{3})([0-9]{3})([0-9]{2})', '***.\\2.\\3-**') as a,
  regexp_replace(b, '([0-9]{3})\\.([0-9]{3})\\.([0-9]{3})-([0-9]{2})', '***.\\2.\\3-**') as b,
  regexp_replace(c, '([0-9]{3})([0-9]{3})([0-9]{3})([0-9]{2})', '***.\\2.\\3-**') as c from {v_text}""")
def _(v):
    return P.mask_frame(v.v_text)


@job("masked_documents", """
select doc_id, regexp_replace(regexp_replace(concat(' ', text, ' '), '([^0-9])[0-9]{3}\\.([0-9]{3})\\.([0-9]{3})-[0-9]{2}([^0-9])', '\\1***.\\2.\\3-**\\4', 'g'),
  '([^0-9])[0-9]{3}([0-9]{3})([0-9]{3})[0-9]{2}([^0-9])', '\\1***.\\2.\\3-**\\4', 'g') as text from {documents}""")
def _(v):
    return P.mask_frame(v.documents.select("doc_id", "text")).withColumn("text", F.concat(F.lit(" "), "text", F.lit(" ")))


CHECKSUM = """
with d as (select row_id, c, list_transform(range(1, 12), lambda i: cast(substr(c, i, 1) as int)) as x from {v_text}),
s as (select row_id, c, x, list_sum(list_transform(range(1, 10), lambda i: x[i] * (11 - i))) % 11 as r1,
        list_sum(list_transform(range(1, 11), lambda i: x[i] * (12 - i))) % 11 as r2 from d),
bad_c as (select row_id from s where len(list_distinct(x)) > 1 and x[10] = case when r1 < 2 then 0 else 11 - r1 end
        and x[11] = case when r2 < 2 then 0 else 11 - r2 end)"""


@job("person_id_leaks", CHECKSUM + """
select 'row_id' as "column", 0 as n_rows, null as example_key
union all select 'a', 0, null
union all select 'b', count(*), min(row_id) from {v_text} where b <> 'clean'
union all select 'c', count(*), min(row_id) from bad_c""")
def _(v):
    return P.leak_audit(v.v_text, "row_id")


# ---- source rules --------------------------------------------------------------


@job("slice_rows", """
select o_orderkey as k from {orders} join (select * from (values ('3306305'), ('3506003'), ('4305108')) c(code)) on true
where code = case o_orderkey % 4 when 0 then '3306305' when 1 then '3506003' when 2 then '4305108' else '1' end
  and o_orderkey % 5 <> 1 and o_orderkey % 6 <> 2""")
def _(v):
    key = F.col("o_orderkey")
    rows = v.orders.select(
        key.alias("k"),
        F.when(key % 4 == 0, "3306305.0").when(key % 4 == 1, " 3506003").when(key % 4 == 2, "4305108").otherwise("1").alias("unidadeorgaocodigoibge"),
        F.when(key % 5 == 1, "Federal").when(key % 5 == 2, "Municipal").otherwise("M").alias("orgaoentidadeesferaid"),
        F.when(key % 6 == 2, "Legislativo").otherwise("E").alias("orgaoentidadepoderid"))
    return PU.slice_rows(rows).select("k")


@job("lines_of_kept_purchases", """
select l_orderkey, l_linenumber, l_partkey from {lineitem} join {orders} on o_orderkey = l_orderkey where o_orderstatus = 'F'""")
def _(v):
    heads = v.orders.where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("idCompra"))
    lines = v.lineitem.withColumn("id_Compra", F.col("l_orderkey")).select("id_Compra", "l_orderkey", "l_linenumber", "l_partkey")
    kept = PU.lines_of(heads, lines)
    return kept.select(F.col("lorderkey").alias("l_orderkey"), F.col("llinenumber").alias("l_linenumber"), F.col("lpartkey").alias("l_partkey"))


@job("lines_with_headers", """
select l_orderkey as idcompra, l_partkey as valor, o_orderstatus as compra_status, o_orderpriority as modalidade, l_linestatus as status
from {lineitem} left join {orders} on o_orderkey = l_orderkey and o_orderkey % 2 = 0""")
def _(v):
    heads = v.orders.where(F.col("o_orderkey") % 2 == 0).select(
        F.col("o_orderkey").alias("idCompra"), F.col("o_orderstatus").alias("Status"), F.col("o_orderpriority").alias("Modalidade"))
    lines = v.lineitem.select(F.col("l_orderkey").alias("id Compra"), F.col("l_partkey").alias("valor"), F.col("l_linestatus").alias("status"))
    return PU.join_lines(heads, lines).select("idcompra", "valor", "compra_status", "modalidade", "status")


@job("rows_by_year", """
select year(o_orderdate) as year, count(*) as n from {orders} where year(o_orderdate) in (1996, 1998) group by 1""")
def _(v):
    rows = v.orders.select(F.date_format("o_orderdate", "yyyy-MM").alias("anocompra"))
    return PU.by_year(rows, (1996, 1998)).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


@job("trailing_window", """
select o_orderkey from {orders} where cast(o_orderdate as date) between date '1998-08-02' - 90 and date '1998-08-02'""")
def _(v):
    rows = v.orders.withColumn("d", F.col("o_orderdate").cast("date"))
    return PU.trailing_window(rows, "d", F.to_date(F.lit("1998-08-02"))).select("o_orderkey")


@job("month_windows", """
with span as (select o_custkey, min(cast(o_orderdate as date)) as a, max(cast(o_orderdate as date)) as z from {orders} group by 1)
select o_custkey, cast(greatest(m, a) as string) as first, cast(least(cast(m + interval 1 month as date) - 1, z) as string) as last
from (select o_custkey, a, z, cast(unnest(generate_series(date_trunc('month', a), z, interval 1 month)) as date) as m from span) w""")
def _(v):
    day = F.col("o_orderdate").cast("date")
    span = v.orders.groupBy("o_custkey").agg(F.min(day).alias("a"), F.max(day).alias("z"))
    windows = span.select("o_custkey", F.explode(X.month_windows(F.col("a"), F.col("z"))).alias("w"))
    return windows.select("o_custkey", "w.first", "w.last")
