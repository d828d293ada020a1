"""Checkable jobs that write: tables in key ranges, landed snapshots, files, streams.

Each writes into a new folder of the session's shared folder and returns what
is read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lisura.operators import entities as EN
from lisura.operators import search as SE
from lisura.operators import search_index as SI
from lisura.plans.jobs import job
from lisura.plans.jobs_browse import DOCS, REPLAY, tables
from lisura.session import new_folder
from lisura.sources import delimited as DE
from lisura.sources import landing as LA
from lisura.sources import tables as TB
from lisura.streaming import landing_stream as LS
from lisura.streaming import lifecycle_stream as LC

PAST, NOW = "timestamp '2020-01-01 00:00:00'", "timestamp '2024-05-01 00:00:00'"
#: Small ranges, so that the samples have several.
RANGE_ROWS = 500


def _upserted(name, keys, base, more, **how):
    """``base`` as a new table, then ``more`` on top of it."""
    root = new_folder(base.sparkSession)
    for rows, at in ((base, PAST), (more, NOW)):
        out = TB.upsert_table(rows, root, name, keys, lambda old, new, at=at: EN.upsert(old, new, keys, F.expr(at), **how), RANGE_ROWS)
    return out


STAMPS = """case when b.k is null then '2024-05-01 00:00:00' else '2020-01-01 00:00:00' end as "createdAt",
  case when m.k is null then '2020-01-01 00:00:00' else '2024-05-01 00:00:00' end as "updatedAt" """


# ---- tables ----------------------------------------------------------------------


@job("stored_buyers", f"""
with b as (select distinct orgao_cnpj as k, orgao_razao as r from {{v_item}} where l_orderkey % 3 > 0),
m as (select distinct orgao_cnpj as k, concat(orgao_razao, ' SA') as r from {{v_item}} where l_orderkey % 3 = 0)
select coalesce(b.k, m.k) as cnpj, coalesce(m.r, b.r) as "razaoSocial", {STAMPS} from b full join m on b.k = m.k""")
def _(v):
    base, more = v.v_item.where("l_orderkey % 3 > 0"), v.v_item.where("l_orderkey % 3 = 0")
    more = more.withColumn("orgao_razao", F.concat("orgao_razao", F.lit(" SA")))
    out = _upserted("orgao", ["cnpj"], EN.buyers(base), EN.buyers(more))
    return out.select("cnpj", "razaoSocial", "createdAt", "updatedAt")


@job("stored_suppliers", f"""
with b as (select distinct fornecedor_cnpj as k, opened_on as o from {{v_item}} where l_linenumber < 4 and l_suppkey % 4 > 0),
m as (select distinct fornecedor_cnpj as k, case when l_suppkey % 2 = 0 then opened_on end as o from {{v_item}} where l_suppkey % 5 > 0)
select coalesce(b.k, m.k) as cnpj, cast(coalesce(m.o, b.o) as string) as "openedOn", {STAMPS} from b full join m on b.k = m.k""")
def _(v):
    base = v.v_item.where("l_linenumber < 4 and l_suppkey % 4 > 0")
    more = v.v_item.where("l_suppkey % 5 > 0").withColumn("opened_on", F.expr("case when l_suppkey % 2 = 0 then opened_on end"))
    out = _upserted("fornecedor", ["cnpj"], EN.suppliers(base), EN.suppliers(more), keep_old_if_null=("openedOn", "cnae"))
    return out.select("cnpj", "openedOn", "createdAt", "updatedAt")


@job("stored_contracts", f"""
with b as (select distinct pncp_id as k, objeto_ as o from (select *, 'old' as objeto_ from {{v_item}}) x where l_orderkey % 3 > 0),
m as (select distinct pncp_id as k, 'new' as o from {{v_item}} where l_orderkey % 2 = 0)
select coalesce(b.k, m.k) as "pncpId", coalesce(m.o, b.o) as objeto, {STAMPS} from b full join m on b.k = m.k""")
def _(v):
    base = v.v_item.where("l_orderkey % 3 > 0").withColumn("objeto", F.lit("old"))
    more = v.v_item.where("l_orderkey % 2 = 0").withColumn("objeto", F.lit("new"))
    out = _upserted("contratacao", ["pncpId"], EN.contracts(base), EN.contracts(more))
    return out.select("pncpId", "objeto", "createdAt", "updatedAt")


@job("stored_items", f"""
with b as (select distinct record_id as k, uf as u from {{v_item}} where l_linenumber % 3 > 0),
m as (select distinct record_id as k, 'XX' as u from {{v_item}} where l_linenumber % 2 = 0)
select coalesce(b.k, m.k) as record, coalesce(m.u, b.u) as uf, {STAMPS} from b full join m on b.k = m.k""")
def _(v):
    items = v.v_item.withColumn("descricao", F.col("record_id"))
    more = items.where("l_linenumber % 2 = 0").withColumn("uf_item", F.lit("XX"))
    out = _upserted("item", ["id"], EN.item_rows(items.where("l_linenumber % 3 > 0")), EN.item_rows(more))
    return out.select(F.col("descricao").alias("record"), "uf", "createdAt", "updatedAt")


@job("stored_exclusions", f"""
with z as (select distinct record_id as k, l_orderkey % 3 as g from {{v_item}} where l_linenumber < 5),
b as (select k from z where g > 0), m as (select k from z where g <> 1)
select coalesce(m.d, b.d) as detail, "createdAt", "updatedAt", count(*) as n from (
  select coalesce(b.k, m.k) as k, case when m.k is not null then 'new' end as d1, {STAMPS} from b full join m on b.k = m.k) x,
  lateral (select d1 as d) m, lateral (select 'old' as d) b group by 1, 2, 3""")
def _(v):
    few = v.v_item.where("l_linenumber < 5")

    def tags(rows, detail):
        return rows.select(
            "record_id", F.lit("zero_or_negative").alias("reason"), F.lit(detail).alias("detail"), "snapshot_id", "methodology_version")

    base, more = tags(few.where("l_orderkey % 3 > 0"), "old"), tags(few.where("l_orderkey % 3 <> 1"), "new")
    out = _upserted("item_exclusion", ["itemId", "reason"], EN.exclusion_rows(base, v.v_item), EN.exclusion_rows(more, v.v_item))
    return out.groupBy("detail", "createdAt", "updatedAt").agg(F.count(F.lit(1)).alias("n"))


@job("stored_edges", f"""
with e as (select distinct least(l_partkey, l_suppkey) as x, greatest(l_partkey, l_suppkey) as y, l_linenumber % 2 as g from {{lineitem}} where l_partkey <> l_suppkey),
b as (select concat(x, '|', y) as k, x, y from e where g = 0), m as (select concat(x, '|', y) as k, x, y from e where g = 1)
select coalesce(b.x, m.x) as "leftCnpj", coalesce(b.y, m.y) as "rightCnpj", {STAMPS} from b full join m on b.k = m.k""")
def _(v):
    def edges(rows):
        pairs = rows.select(F.lit("shared_partner").alias("kind"), F.col("l_partkey").alias("leftCnpj"), F.col("l_suppkey").alias("rightCnpj"))
        return EN.ordered_edges(pairs).distinct().withColumn("snapshotId", F.lit("s"))

    base, more = edges(v.lineitem.where("l_linenumber % 2 = 0")), edges(v.lineitem.where("l_linenumber % 2 = 1"))
    out = _upserted("fornecedor_adjacency", ["kind", "leftCnpj", "rightCnpj"], base, more)
    return out.select("leftCnpj", "rightCnpj", "createdAt", "updatedAt")


@job("stored_participants", f"""
with b as (select concat("licitacaoId", '|', participante) as k, "licitacaoId" as l, participante as p, proposta as x from {{v_bid}} where uf = 'SP'),
m as (select concat("licitacaoId", '|', participante) as k, "licitacaoId" as l, participante as p, proposta + 1 as x from {{v_bid}} where cast("licitacaoId" as bigint) % 3 = 0)
select coalesce(b.l, m.l) as "licitacaoId", coalesce(b.p, m.p) as participante, cast(coalesce(m.x, b.x) as double) as proposta, {STAMPS}
from b full join m on b.k = m.k""")
def _(v):
    more = v.v_bid.where(F.col("licitacaoId").cast("bigint") % 3 == 0).withColumn("proposta", F.col("proposta") + 1)
    out = _upserted("licitacao_participante", ["id"], EN.participant_rows(v.v_bid.where("uf = 'SP'")), EN.participant_rows(more))
    return out.select("licitacaoId", "participante", "proposta", "createdAt", "updatedAt")


@job("stored_screens", f"""
with c as (select "licitacaoId" as k, count(*) as n from {{v_bid}} group by 1),
b as (select * from c where n >= 4), m as (select * from c where n % 2 = 0)
select coalesce(b.k, m.k) as "subjectId", case when m.k is null then 'old' else 'new' end as evidence, {STAMPS} from b full join m on b.k = m.k""")
def _(v):
    lots = v.v_bid.groupBy("licitacaoId").agg(F.count(F.lit(1)).alias("n"))

    def screens(rows, evidence):
        return EN.screen_rows(rows.select(
            F.lit("bid_variance").alias("kind"), F.col("licitacaoId").alias("subjectId"), "licitacaoId", F.lit("detected").alias("state"),
            F.lit(evidence).alias("evidence"), F.lit("s").alias("snapshot_id"), F.lit("v1").alias("methodology_version")))

    out = _upserted("co_bid_screen", ["id"], screens(lots.where("n >= 4"), "old"), screens(lots.where("n % 2 = 0"), "new"))
    return out.select("subjectId", "evidence", "createdAt", "updatedAt")


@job("partners_refreshed", """
with s as (select concat(lpad(cast(s_suppkey as string), 8, '0'), '000199') as cnpj from {supplier})
select distinct s.cnpj as "fornecedorCnpj", nome_socio as nome from {v_partner} p join s on substr(s.cnpj, 1, 8) = cnpj_basico
where cast(cnpj_basico as bigint) % 2 = 1""")
def _(v):
    """A second load replaces the first one whole."""
    suppliers = v.supplier.select(
        F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lpad(F.col("s_suppkey").cast("string"), 8, "0"), F.lit("000199")).alias("cnpj"))
    root = new_folder(suppliers.sparkSession)
    for part in ("cast(cnpj_basico as bigint) % 2 = 0", "cast(cnpj_basico as bigint) % 2 = 1"):
        out = TB.write_table(EN.partner_rows(v.v_partner.where(part), suppliers), root, "fornecedor_socio", ["id"], RANGE_ROWS)
    return out.select("fornecedorCnpj", "nome").distinct()


# ---- ordered scans -----------------------------------------------------------------


@job("scan_flags", """
select 'company_age' as kind, concat('i', l_suppkey) as "itemId", concat(l_orderkey, '-', l_linenumber, '-', l_partkey) as id from {lineitem}
where l_suppkey % 2 = 0""")
def _(v):
    flags = v.lineitem.select(
        F.when(F.col("l_suppkey") % 2 == 0, "company_age").otherwise("sanctioned").alias("kind"), F.concat(F.lit("i"), "l_suppkey").alias("itemId"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"))
    return EN.scan(flags, "flag", kind="company_age")


@job("scan_exclusions", """
select distinct 'duplicate' as reason, record_id as "itemId" from {v_item} where l_linenumber = 2""")
def _(v):
    rows = v.v_item.select(F.when(F.col("l_linenumber") == 2, "duplicate").otherwise("decimal_shift").alias("reason"), F.col("record_id").alias("itemId"))
    return EN.scan(rows.distinct(), "item_exclusion", reason="duplicate")


@job("scan_screens", """
select distinct 'tight' as kind, "licitacaoId" as "subjectId" from {v_bid} where uf = 'RS'""")
def _(v):
    rows = v.v_bid.select(F.when(F.col("uf") == "RS", "tight").otherwise("cover").alias("kind"), F.col("licitacaoId").alias("subjectId"))
    return EN.scan(rows.distinct(), "co_bid_screen", kind="tight")


# ---- files, snapshots, streams -------------------------------------------------------


@job("delimited_files", """
select cast(o_orderkey as string) as id, case when o_orderkey % 2 = 0 then concat('a;"', o_orderpriority, '"') end as nome,
  case when o_orderkey % 2 = 1 then o_orderstatus end as situacao from {orders}""")
def _(v):
    """Files of two separators and layouts, with quoted separators and quotes."""
    folder = new_folder(v.orders.sparkSession)
    key = F.col("o_orderkey")
    even = v.orders.where(key % 2 == 0).select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit('a;"'), "o_orderpriority", F.lit('"')).alias("nome"))
    odd = v.orders.where(key % 2 == 1).select(F.col("o_orderstatus").alias("situacao"), F.col("o_orderkey").alias("id"))
    for rows, sep in ((even, ";"), (odd, ",")):
        rows.repartition(3, "id").write.mode("append").csv(f"{folder}/kind={ord(sep)}", sep=sep, header=True, quote='"', escape='"')
    found = DE.read_delimited(v.orders.sparkSession, [f"{folder}/kind=59", f"{folder}/kind=44"])
    return found.select("id", "nome", "situacao")


@job("landed_snapshots", """
select year, n, rows, plain, extra from (
  select cast(year(o_orderdate) as bigint) as year, count(*) as n, 2 * count(*) as rows, count(*) as plain, count(*) as extra from {orders} group by 1) x""")
def _(v):
    """Two snapshots a year, the second with another column, the first landed twice; a folder that is not listed is not read."""
    spark = v.orders.sparkSession
    root = new_folder(spark)
    rows = v.orders.select(F.year("o_orderdate").alias("year"), F.col("o_orderkey").cast("string").alias("record_id"), F.col("o_orderstatus").alias("plain"))
    years = tuple(range(1990, 2005))
    LA.land_by_year(rows, root, "s", years)
    LA.land_by_year(rows.repartition(5), root, "s", years)
    LA.land_by_year(rows.select("year", "record_id", F.lit("x").alias("extra")), root, "s", years)
    rows.drop("year").write.parquet(f"{LA.data_path(root, 's')}/year=1995/date=1995-12-31/snapshot_id=lost")
    landed = LA.read_landed(spark, root, "s")
    return landed.groupBy(F.col("_year").alias("year")).agg(
        F.count_distinct("record_id").alias("n"), F.count(F.lit(1)).alias("rows"), F.count("plain").alias("plain"), F.count("extra").alias("extra"))


@job("landing_stream", """
select cast(l_orderkey as string) as record_id, count(*) as n from (select distinct l_orderkey, l_partkey from {lineitem}) x group by 1""")
def _(v):
    """Files arrive in two runs of a stream and partly again for a stream that lost its checkpoint: each content lands once."""
    spark = v.lineitem.sparkSession
    folder = new_folder(spark)
    columns = [F.col("l_orderkey").alias("idcompraitem"), F.concat(F.lit("part "), "l_partkey").alias("descricao")]
    schema = DE.text_schema(["idcompraitem", "descricao"])
    for run, (part, mark) in enumerate((("l_linenumber < 4", "a"), ("l_linenumber > 2", "a"), ("l_linenumber = 1", "b"))):
        v.lineitem.where(part).select(*columns).repartition(4).write.csv(f"{folder}/in/run={run}", sep=";", header=True)
        LS.land_new_files(spark, f"{folder}/in/*", schema, f"{folder}/root", "api", f"{folder}/mark-{mark}", "2024-01-01").awaitTermination()
    return LA.read_landed(spark, f"{folder}/root", "api").groupBy("record_id").agg(F.count(F.lit(1)).alias("n"))


# ---- search by index -----------------------------------------------------------------


def _indexed(v):
    """Folder of an index over all documents, in small places and parts, so that the samples have several."""
    root = new_folder(v.documents.sparkSession)
    SI.write_index(SE.search_documents(tables(v)), root, place_rows=500, part_rows=20_000)
    return root


@job("search_index_totals", f"""
with {DOCS}, kinds as (select * from (values ('orgao'), ('fornecedor'), ('item')) k(kind))
select kinds.kind, count(docs.id) as total from kinds left join docs on docs.kind = kinds.kind and lower(text) like '%bolt%'
group by 1""")
def _(v):
    return SI.index_totals(v.documents.sparkSession, _indexed(v), "BÓLT")


@job("search_index_page", f"""
with {DOCS}, ranked as (select *, row_number() over (partition by kind order by lower(text), id) as rank from docs where lower(text) like '%bolt%')
select id, kind, "entityId", text, rank from ranked where rank > 30 and rank <= 500""")
def _(v):
    return SI.index_page(v.documents.sparkSession, _indexed(v), "BÓLT", skip=30, take=470)


@job("lifecycle_stream", f"""
with recursive {REPLAY}
select event_id, from_state, accepted, case when accepted then state end as to_state from walk where k > 0""")
def _(v):
    """Events arrive in four batches and up to two days late; a far later one of no flag lets the watermark pass them all."""
    spark = v.events.sparkSession
    folder = new_folder(spark)
    events = v.v_event.join(v.v_flag.select("flag_id", "blocked"), "flag_id")
    arrival = F.unix_timestamp("ts") + F.pmod(F.xxhash64("event_id"), F.lit(2 * 86_400))
    span = events.select(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    low, width = span["low"].timestamp(), (span["high"].timestamp() - span["low"].timestamp()) / 4
    late = "2 days"
    for k in range(4):
        inside = (arrival >= low + k * width if k else F.lit(True)) & (arrival < low + (k + 1) * width if k < 3 else F.lit(True))
        events.where(inside).coalesce(1).write.mode("append").parquet(f"{folder}/events")
    after = spark.range(1).select(
        F.lit(-1).cast("long").alias("flag_id"), F.lit(-1).cast("long").alias("event_id"), F.lit(span["high"]).alias("ts") + F.expr("interval 60 days"),
        F.lit("reply").alias("action"), F.lit(False).alias("blocked")).toDF("flag_id", "event_id", "ts", "action", "blocked")
    after.select(*events.columns).write.mode("append").parquet(f"{folder}/events")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/events")
    LC.judge_stream(stream, late).writeStream.format("parquet").option("path", f"{folder}/out").option(
        "checkpointLocation", f"{folder}/mark").trigger(availableNow=True).start().awaitTermination()
    judged = spark.read.parquet(f"{folder}/out").where((F.col("action") != LC.HOLD_OVER) & (F.col("flag_id") >= 0))
    return judged.select("event_id", "from_state", "accepted", "to_state")
