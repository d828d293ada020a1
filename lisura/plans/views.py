"""Purchasing-shaped views over the sample star schema, for checks and timing.

Each view is one SELECT that Spark and DuckDB both run.  ``{name}`` stands for
a table or another view.  The jobs under test never appear here.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lisura.session import if_small

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

VIEWS = {
    # One purchase line with its contract, buyer and supplier.
    "v_item": """
select concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) as record_id,
       concat(l_orderkey, '-', l_linenumber) as line_id,
       cast(l_orderkey as string) as pncp_id, cast(l_orderkey as string) as id_compra,
       cast(l_linenumber as string) as id_compra_item,
       concat('b', o_custkey) as orgao_cnpj, c_name as orgao_razao, n_name as uf, n_name as uf_item,
       cast(c_nationkey as string) as municipio_ibge, n_name as municipio_nome,
       lpad(cast(l_suppkey as string), 14, '0') as fornecedor_cnpj, s_name as fornecedor_razao,
       cast(l_partkey as string) as catmat, p_type as codigo_classe, p_name as descricao,
       concat(p_name, ' ', p_brand) as objeto, 'M' as material_ou_servico, 'UN' as unidade_medida,
       o_orderpriority as modalidade, case when o_orderpriority = '5-LOW' then '8' else '6' end as modalidade_codigo,
       cast(year(o_orderdate) as string) as ano,
       cast(cast(l_quantity as decimal(18,2)) as decimal(18,6)) as quantidade,
       cast(case when l_linenumber % 3 = 0 then cast(p_retailprice as decimal(18,2))
            else cast(floor((2 * round(l_extendedprice * 100) + l_quantity) / (2 * l_quantity)) as decimal(18,0)) * 0.01
            end as decimal(18,6)) as valor_unitario,
       cast(cast(l_extendedprice as decimal(18,2)) as decimal(18,6)) as valor_total,
       cast(l_shipdate as date) as award_date, o_orderdate as publicado_em,
       concat(year(o_orderdate), '-Q', quarter(o_orderdate)) as quarter,
       date '1994-06-01' + cast((s_suppkey * 37) % 2400 as int) as opened_on,
       concat(s_suppkey, '|', s_suppkey * 7) as cnae,
       concat('snap', l_linenumber % 2) as snapshot_id, 'v1' as methodology_version, 'federal_purchases' as source,
       l_suppkey, l_orderkey, l_linenumber
from {lineitem} join {orders} on l_orderkey = o_orderkey
  join {part} on l_partkey = p_partkey
  join {customer} on o_custkey = c_custkey
  join {nation} on c_nationkey = n_nationkey
  join {supplier} on l_suppkey = s_suppkey""",
    # Same lines with planted zeroes for the non-positive rule.
    "v_item_zero": """
select record_id, pncp_id, snapshot_id, methodology_version,
       cast(case when l_linenumber = 7 then 0 else quantidade end as decimal(18,6)) as quantidade,
       cast(case when l_suppkey % 10 = 3 then -valor_unitario else valor_unitario end as decimal(18,6)) as valor_unitario,
       cast(case when l_suppkey % 25 = 4 then -valor_total else valor_total end as decimal(18,6)) as valor_total
from {v_item}""",
    # Same lines with coarse money, so that many repeat.
    "v_item_repeat": """
select record_id, pncp_id, snapshot_id, methodology_version, id_compra_item, descricao,
       cast(floor(quantidade / 25) as decimal(18,6)) as quantidade,
       cast(5 as decimal(18,6)) as valor_unitario, cast(null as decimal(18,6)) as valor_total
from {v_item}""",
    "v_limit": """
select distinct cast(year(l_shipdate) as int) as year, 'other' as kind, cast(60000 as decimal(18,6)) as amount, 'd1' as decree
from {lineitem}
union all
select distinct cast(year(l_shipdate) as int) as year, 'obras' as kind, cast(110000 as decimal(18,6)) as amount, 'd1' as decree
from {lineitem}""",
    # Purchases just under a limit, so that runs inside 90 days exist.
    "v_item_band": """
select record_id, pncp_id, pncp_id as id_compra, uf as orgao_cnpj, codigo_classe, cast(null as string) as catmat,
       descricao, objeto, modalidade_codigo, modalidade, valor_total, award_date, ano, snapshot_id, methodology_version
from {v_item}""",
    "v_sanction": """
select lpad(cast(s_suppkey as string), 14, '0') as cnpj,
       date '1996-01-01' + cast((s_suppkey * 11) % 900 as int) as start_on,
       date '1996-01-01' + cast((s_suppkey * 11) % 900 + 365 as int) as end_on,
       case when s_suppkey % 2 = 0 then 'CEIS' else 'CNEP' end as register,
       concat('S-', s_suppkey) as ref, cast(1 as bigint) as ordinal
from {supplier} where s_suppkey % 7 = 0
union all
select lpad(cast(s_suppkey as string), 14, '0') as cnpj, date '1997-01-01' as start_on, cast(null as date) as end_on,
       'CEIS' as register, concat('T-', s_suppkey) as ref, cast(2 as bigint) as ordinal
from {supplier} where s_suppkey % 14 = 0""",
    # Lines sharing order and line number are versions of one record.
    "v_version": """
select line_id as record_id, concat('h-', record_id, '-', valor_total) as record_hash, award_date as snapped_on,
       cast(valor_total as string) as snapshot_id, pncp_id, cast(publicado_em as date) as gate, '' as source_url,
       methodology_version, valor_unitario as valor_unitario_resultado,
       cast(null as decimal(18,6)) as valor_unitario_estimado, cast(null as decimal(18,6)) as valor_unitario_homologado,
       quantidade, fornecedor_cnpj, lower(fornecedor_razao) as fornecedor_razao
from {v_item}""",
    "v_bid": """
select cast(l_orderkey as string) as "licitacaoId", case when l_orderkey % 2 = 0 then 'SP' else 'RS' end as uf,
       cast(o_custkey as string) as orgao, o_orderstatus as classe, '' as "itemLote",
       lpad(cast(l_suppkey as string), 14, '0') as participante, price as proposta,
       row_number() over (partition by l_orderkey order by price, l_suppkey) = 1 as winner,
       case when l_orderkey % 2 = 0 then 'tce_sp' else 'tce_rs' end as source, '' as "plantedId",
       'snap' as snapshot_id, 'v1' as methodology_version
from (select l_orderkey, l_suppkey, cast(cast(min(l_extendedprice) as decimal(18,2)) as decimal(18,6)) as price
      from {lineitem} group by l_orderkey, l_suppkey) b
  join {orders} on l_orderkey = o_orderkey""",
    "v_company": """
select lpad(cast(cast(floor(c_custkey / 2) as bigint) as string), 8, '0') as cnpj_basico,
       lpad(cast(1 + c_custkey % 2 as string), 4, '0') as cnpj_ordem, lpad(cast(c_custkey % 97 as string), 2, '0') as cnpj_dv,
       'Rua' as tipo_logradouro, c_mktsegment as logradouro,
       concat(c_nationkey, '-', cast(floor(c_custkey / 1500) as bigint)) as numero,
       cast(null as string) as cep, concat('Município ', c_nationkey) as municipio,
       lpad(cast(c_nationkey as string), 2, '0') as ddd1, lpad(cast(cast(floor(c_custkey / 50) as bigint) as string), 8, '3') as telefone1,
       lpad(cast(c_nationkey as string), 2, '0') as ddd2, lpad(cast((c_custkey * 7) % 389 as string), 9, '9') as telefone2,
       case when c_custkey % 3 = 0 then concat('Contato', cast(floor(c_custkey / 12) as bigint), '@Exemplo.example')
            when c_custkey % 3 = 1 then 'sem correio' end as correio_eletronico
from {customer}""",
    "v_partner": """
select lpad(cast(cast(floor(c_custkey / 2) as bigint) as string), 8, '0') as cnpj_basico,
       case when c_custkey % 4 = 0 then '1' else '2' end as identificador_de_socio, concat('Socio ', c_name) as nome_socio,
       case when c_custkey % 4 = 0 then lpad(cast(cast(floor(c_custkey / 20) as bigint) as string), 14, '7')
            else concat('111', lpad(cast(cast(floor(c_custkey / 6) as bigint) as string), 6, '0'), '11') end as cnpj_cpf_do_socio,
       cast(c_nationkey as string) as qualificacao_do_socio
from {customer}""",
    "v_buyer": """
select concat('b', c_custkey) as id, concat('b', c_custkey) as cnpj, c_name as "razaoSocial",
       case when c_mktsegment = 'HOUSEHOLD' then 'federal' when c_mktsegment = 'MACHINERY' then 'estadual'
            else 'municipal' end as esfera, 'executivo' as poder, n_name as uf,
       cast(c_nationkey as string) as "municipioIbge", concat('City ', n_name) as "municipioNome",
       c_custkey % 17 = 0 as suspended
from {customer} join {nation} on c_nationkey = n_nationkey""",
    "v_seller": """
select concat('s', s_suppkey) as id, lpad(cast(s_suppkey as string), 14, '0') as cnpj, s_name as "razaoSocial",
       date '1994-06-01' + cast((s_suppkey * 37) % 2400 as int) as "openedOn",
       case when s_suppkey % 9 <> 0 then concat('00-', s_nationkey) end as cnae, s_suppkey % 13 = 0 as suspended
from {supplier}""",
    "v_contract": """
select concat('c', o_orderkey) as id, cast(o_orderkey as string) as "pncpId", concat('b', o_custkey) as "orgaoId",
       o_orderpriority as modalidade, concat('Objeto ', o_orderpriority) as objeto, cast(year(o_orderdate) as int) as ano,
       case when o_orderkey % 50 <> 0 then o_orderdate end as "publicadoEm", 'federal_purchases' as source, 'snap' as "snapshotId",
       case when o_orderkey % 4 = 0 then 'v0' else 'v1' end as "methodologyVersion", o_orderkey % 19 = 0 as suspended
from {orders}""",
    "v_line": """
select record_id as id, concat('c', l_orderkey) as "contratacaoId",
       case when l_suppkey % 10 <> 0 then concat('s', l_suppkey) end as "fornecedorId", descricao,
       case when l_suppkey % 6 <> 0 then catmat end as catmat, cast(null as string) as catser,
       quantidade, valor_unitario as "valorUnitario", uf, quarter, 'v1' as "methodologyVersion",
       (l_orderkey + l_linenumber) % 23 = 0 as suspended
from {v_item}""",
    "v_event": """
select user_id as flag_id, event_id, ts,
       case event_type when 'view' then 'review' when 'click' then 'notify' when 'purchase' then 'publish'
            when 'signup' then 'retract' else case when event_id % 3 = 0 then 'reply' else 'resolve' end end as action
from {events}""",
    "v_flag": """
select distinct user_id as flag_id, timestamp '2023-12-31 00:00:00' as detected_at, user_id % 11 = 0 as blocked
from {events}""",
    # Texts with person ids planted from keys.
    "v_text": """
select cast(o_orderkey as string) as row_id,
       concat('doc ', lpad(cast(o_orderkey * 7919 % 100000000000 as string), 11, '1'), ' end') as a,
       case when o_orderkey % 3 = 0
            then concat('x ', lpad(cast(o_orderkey % 1000 as string), 3, '0'), '.456.789-01') else 'clean' end as b,
       lpad(cast(o_orderkey * 104729 % 100000000000 as string), 11, '0') as c
from {orders}""",
}

#: Rows of suppliers, two short columns, up to which every task gets all of them.
FEW_SUPPLIERS = 500_000

NAME = r"{([a-z]\w+)}"


def _uses(sql: str) -> list[str]:
    return re.findall(NAME, sql)


def for_duckdb(sql: str) -> str:
    """The query with every view it needs as a common table expression."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in _uses(text):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    strip = lambda text: re.sub(NAME, r"\1", text)
    if not needed:
        return strip(sql)
    return "with recursive " + ",\n".join(f"{n} as ({strip(VIEWS[n])})" for n in needed) + strip(
        re.sub(r"^\s*with\b(?:\s+recursive)?", ",", sql, count=1) if sql.lstrip().lower().startswith("with") else "\n" + sql)


class Views:
    """Lazy frames of the tables and views in one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder, self._made = spark, folder.rstrip("/"), {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self._spark.read.parquet(f"{self._folder}/{name}.parquet")
            else:
                # Double quotes mark identifiers in the shared text; Spark writes them as backticks.
                sql = VIEWS[name].replace('"', "`")
                frames = {n: getattr(self, n) for n in _uses(sql)}
                if name == "v_item":
                    frames["supplier"] = if_small(frames["supplier"].select("s_suppkey", "s_name"), FEW_SUPPLIERS)
                if name == "v_bid":
                    # Grouping, join and ranking all find the lines of an order together.
                    frames["lineitem"] = frames["lineitem"].select("l_orderkey", "l_suppkey", "l_extendedprice").repartition("l_orderkey")
                self._made[name] = self._spark.sql(sql, **frames)
        return self._made[name]
