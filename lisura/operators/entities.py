"""Warehouse tables out of normalized items and detector results, and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lisura.functions import identity as I
from lisura.functions import person_ids as P
from lisura.functions import text as X
from lisura.functions.text import column
from lisura.operators.exclusions import money
from lisura.operators.stats import keep_first, keep_latest


def _or_empty(df: DataFrame, name: str, default: str = "") -> Column:
    return F.coalesce(X.blank_to_null(column(df, name)), F.lit(default))


def _order(items: DataFrame, seq: str | None) -> Column:
    """Arrival order: ``seq`` where given, else publication then record."""
    if seq:
        return F.col(seq)
    return F.struct(column(items, "publicado_em", "timestamp"), _or_empty(items, "record_id"))


def buyers(items: DataFrame, seq: str | None = None) -> DataFrame:
    """One row per buyer id, last wins."""
    cnpj = X.blank_to_null(column(items, "orgao_cnpj"))
    rows = items.select(
        cnpj.alias("cnpj"), _or_empty(items, "orgao_razao").alias("razaoSocial"),
        _or_empty(items, "esfera", "municipal").alias("esfera"), _or_empty(items, "poder", "executivo").alias("poder"),
        _or_empty(items, "uf").alias("uf"), _or_empty(items, "municipio_ibge").alias("municipioIbge"),
        _or_empty(items, "municipio_nome").alias("municipioNome"), _order(items, seq).alias("_o"),
    ).where(F.col("cnpj").isNotNull())
    return keep_latest(rows, ["cnpj"], ["_o"]).drop("_o").withColumn("id", I.buyer_id(F.col("cnpj")))


def suppliers(items: DataFrame, seq: str | None = None) -> DataFrame:
    """One row per 14-digit supplier id, last wins."""
    rows = items.select(
        column(items, "fornecedor_cnpj").alias("cnpj"), _or_empty(items, "fornecedor_razao").alias("razaoSocial"),
        column(items, "opened_on", "date").cast("date").alias("openedOn"),
        X.blank_to_null(column(items, "cnae")).alias("cnae"), _order(items, seq).alias("_o"),
    ).where(F.length("cnpj") == 14)
    return keep_latest(rows, ["cnpj"], ["_o"]).drop("_o").withColumn("id", I.supplier_id(F.col("cnpj")))


def contracts(items: DataFrame, seq: str | None = None) -> DataFrame:
    """One row per contract id, last wins."""
    buyer = X.blank_to_null(column(items, "orgao_cnpj"))
    year = F.substring(_or_empty(items, "ano", "0"), 1, 4).try_cast("int")
    rows = items.select(
        _or_empty(items, "pncp_id").alias("pncpId"), F.when(buyer.isNotNull(), I.buyer_id(buyer)).alias("orgaoId"),
        _or_empty(items, "modalidade").alias("modalidade"), _or_empty(items, "objeto").alias("objeto"),
        F.coalesce(year, F.lit(0)).alias("ano"),
        column(items, "valor_homologado", "decimal(18,6)").cast(X.MONEY).alias("valorHomologado"),
        column(items, "publicado_em", "timestamp").alias("publicadoEm"),
        _or_empty(items, "source", "federal_purchases").alias("source"), _or_empty(items, "snapshot_id").alias("snapshotId"),
        _or_empty(items, "methodology_version").alias("methodologyVersion"), _order(items, seq).alias("_o"),
    )
    return keep_latest(rows, ["pncpId"], ["_o"]).drop("_o").withColumn("id", I.contract_id(F.col("pncpId")))


def item_rows(items: DataFrame, seq: str | None = None) -> DataFrame:
    """One row per item id, last wins."""
    pncp, record = _or_empty(items, "pncp_id"), _or_empty(items, "record_id")
    cnpj = column(items, "fornecedor_cnpj")
    rows = items.select(
        I.item_id(pncp, record).alias("id"), I.contract_id(pncp).alias("contratacaoId"),
        F.when(F.length(cnpj) == 14, I.supplier_id(cnpj)).alias("fornecedorId"),
        _or_empty(items, "descricao").alias("descricao"), X.blank_to_null(column(items, "catmat")).alias("catmat"),
        X.blank_to_null(column(items, "catser")).alias("catser"),
        F.coalesce(money("quantidade"), F.lit(0).cast(X.MONEY)).alias("quantidade"),
        _or_empty(items, "unidade_medida").alias("unidadeMedida"),
        X.blank_to_null(column(items, "unidade_canonica")).alias("unidadeCanonica"),
        money("valor_unitario").alias("valorUnitario"), money("valor_total").alias("valorTotal"),
        column(items, "valor_por_unidade_canonica", "decimal(18,6)").cast(X.MONEY).alias("valorPorUnidadeCanonica"),
        X.blank_to_null(column(items, "spec_concentracao")).alias("specConcentracao"),
        X.blank_to_null(column(items, "spec_dosagem")).alias("specDosagem"),
        X.blank_to_null(column(items, "spec_tamanho")).alias("specTamanho"),
        F.coalesce(X.blank_to_null(column(items, "uf_item")), _or_empty(items, "uf")).alias("uf"),
        _or_empty(items, "quarter").alias("quarter"), _or_empty(items, "snapshot_id").alias("snapshotId"),
        _or_empty(items, "methodology_version").alias("methodologyVersion"), _order(items, seq).alias("_o"),
    )
    return keep_latest(rows, ["id"], ["_o"]).drop("_o")


def item_facts(items: DataFrame) -> DataFrame:
    """Wide fact rows with ids attached and decimals as doubles."""
    pncp, record = _or_empty(items, "pncp_id"), _or_empty(items, "record_id")
    cnpj, buyer = column(items, "fornecedor_cnpj"), X.blank_to_null(column(items, "orgao_cnpj"))
    base = column(items, "valor_por_unidade_canonica", "decimal(18,6)").cast("double")
    return items.select(
        I.item_id(pncp, record).alias("item_id"), I.contract_id(pncp).alias("contratacao_id"),
        F.when(F.length(cnpj) == 14, I.supplier_id(cnpj)).alias("fornecedor_id"),
        F.when(buyer.isNotNull(), I.buyer_id(buyer)).alias("orgao_id"), pncp.alias("pncp_id"),
        _or_empty(items, "descricao").alias("descricao"), X.blank_to_null(column(items, "catmat")).alias("catmat"),
        X.blank_to_null(column(items, "catser")).alias("catser"),
        F.coalesce(money("quantidade").cast("double"), F.lit(0.0)).alias("quantidade"),
        _or_empty(items, "unidade_medida").alias("unidade_medida"),
        X.blank_to_null(column(items, "unidade_canonica")).alias("unidade_canonica"),
        money("valor_unitario").cast("double").alias("valor_unitario"),
        money("valor_total").cast("double").alias("valor_total"),
        base.alias("valor_unitario_base"), base.alias("valor_por_unidade_canonica"),
        *[X.blank_to_null(column(items, c)).alias(c) for c in ("spec_concentracao", "spec_dosagem", "spec_tamanho")],
        F.coalesce(X.blank_to_null(column(items, "uf_item")), _or_empty(items, "uf")).alias("uf"),
        _or_empty(items, "quarter").alias("quarter"), _or_empty(items, "snapshot_id").alias("snapshot_id"),
        _or_empty(items, "methodology_version").alias("methodology_version"),
        _or_empty(items, "source", "federal_purchases").alias("source"), _or_empty(items, "record_hash").alias("record_hash"),
        column(items, "publicado_em", "timestamp").alias("publicado_em"),
    )


#: Columns that ``item_facts`` reads, besides those of an item fact's key and order.
FACT_COLUMNS = (
    "fornecedor_cnpj orgao_cnpj valor_por_unidade_canonica descricao catmat catser quantidade unidade_medida unidade_canonica valor_unitario"
    " valor_total spec_concentracao spec_dosagem spec_tamanho methodology_version source publicado_em").split()


def latest_facts(facts: DataFrame, inserted: str) -> DataFrame:
    """One fact per (uf, quarter, item_id): the last inserted."""
    return keep_latest(facts, ["uf", "quarter", "item_id"], [inserted, "snapshot_id", "record_hash"])


def latest_item_facts(items: DataFrame, inserted: str) -> DataFrame:
    """One fact per (uf, quarter, item), the last inserted, straight from item rows.

    Versions are reduced on their raw columns first; ids are hashed and numbers
    converted for the rows that stay only.  Equal to ``latest_facts`` of
    ``item_facts`` with ``inserted`` as the order of arrival.
    """
    key = {
        "_uf": F.coalesce(X.blank_to_null(column(items, "uf_item")), _or_empty(items, "uf")), "_quarter": _or_empty(items, "quarter"),
        "_pncp": _or_empty(items, "pncp_id"), "_record": _or_empty(items, "record_id"),
    }
    order = [
        F.col(inserted).alias("_at"), _or_empty(items, "snapshot_id").alias("snapshot_id"), _or_empty(items, "record_hash").alias("record_hash")]
    # Only what a fact is made of goes through the shuffle, once; the key has the other columns, as they are read.
    kept = [F.col(c) for c in FACT_COLUMNS if c in items.columns]
    best = items.withColumns(key).groupBy(*key).agg(F.max(F.struct(*order, *kept)).alias("_row"))
    named = [F.col(f"_{c}").alias(full) for c, full in (("uf", "uf"), ("quarter", "quarter"), ("pncp", "pncp_id"), ("record", "record_id"))]
    return item_facts(best.select(*named, "_row.*"))


def new_items(items: DataFrame, written: DataFrame) -> DataFrame:
    """Items whose id is not in the written item table."""
    ids = written.select(F.col("id").alias("_id"))
    keyed = items.withColumn("_id", I.item_id(_or_empty(items, "pncp_id"), _or_empty(items, "record_id")))
    return keyed.join(ids, "_id", "left_anti").drop("_id")


def record_items(items: DataFrame, seq: str | None = None) -> DataFrame:
    """(record_id, itemId, snapshot, version), last wins per record; ids are hashed for the rows that stay."""
    rows = items.select(
        _or_empty(items, "record_id").alias("record_id"), _or_empty(items, "pncp_id").alias("_pncp"),
        _or_empty(items, "snapshot_id").alias("_snap"), _or_empty(items, "methodology_version").alias("_meth"),
        _order(items, seq).alias("_o"),
    )
    return keep_latest(rows, ["record_id"], ["_o"]).select(
        "record_id", I.item_id(F.col("_pncp"), F.col("record_id")).alias("itemId"), "_snap", "_meth")


def flag_rows(flags: DataFrame, items: DataFrame, version: str | None = None, seq: str | None = None) -> DataFrame:
    """Flags attached to item ids; flags of unknown records are dropped."""
    joined = flags.join(record_items(items, seq), "record_id")
    snap = F.coalesce(X.blank_to_null("snapshot_id"), F.col("_snap"))
    own = F.coalesce(X.blank_to_null("methodology_version"), F.col("_meth"))
    rows = joined.select(
        I.flag_id(F.col("itemId"), F.col("kind"), snap).alias("id"), "itemId", "kind", "delta",
        X.text_or_empty("source_url").alias("sourceUrl"), snap.alias("snapshotId"),
        (F.lit(version) if version else own).alias("methodologyVersion"),
        F.lit("detected").alias("state"),
    )
    return keep_latest(rows, ["id"], ["delta"])


def exclusion_rows(exclusions: DataFrame, items: DataFrame, seq: str | None = None) -> DataFrame:
    """Exclusions attached to item ids, one per (item, reason)."""
    rows = exclusions.join(record_items(items, seq), "record_id").select(
        "itemId", "reason", "detail", F.coalesce(X.blank_to_null("snapshot_id"), F.col("_snap")).alias("snapshotId"),
        F.coalesce(X.blank_to_null("methodology_version"), F.col("_meth")).alias("methodologyVersion"),
    )
    return keep_latest(rows, ["itemId", "reason"], ["detail"])


def participant_rows(participants: DataFrame) -> DataFrame:
    rows = participants.where(
        (F.col("licitacaoId") != "") & F.col("participante").isNotNull()
        & F.col("source").isin("tce_sp", "tce_rs") & F.upper("uf").isin("SP", "RS")
    ).select(
        I.participant_id(F.col("licitacaoId"), F.col("itemLote"), F.col("participante"), F.col("source")).alias("id"),
        "licitacaoId", F.upper("uf").alias("uf"), "orgao", "classe", "itemLote", "participante",
        F.col("proposta").cast(X.MONEY).alias("proposta"), "winner", "source",
        F.col("snapshot_id").alias("snapshotId"), F.col("methodology_version").alias("methodologyVersion"),
    )
    return keep_latest(rows, ["id"], ["snapshotId", "proposta", "winner"])


def screen_rows(screens: DataFrame) -> DataFrame:
    rows = screens.where((F.col("kind") != "") & (F.col("subjectId") != "")).select(
        I.screen_id(F.col("kind"), F.col("subjectId"), F.col("snapshot_id")).alias("id"), "kind", "state", "subjectId",
        "licitacaoId", "evidence", F.col("snapshot_id").alias("snapshotId"),
        F.col("methodology_version").alias("methodologyVersion"),
    )
    return keep_latest(rows, ["id"], ["licitacaoId", "evidence"])


def ordered_edges(edges: DataFrame, swap: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """Edges with left < right, self-edges dropped; paired columns follow their side."""
    flip = F.col("leftCnpj") > F.col("rightCnpj")
    pairs = (("leftCnpj", "rightCnpj"), *swap)
    cols = {}
    for a, b in pairs:
        cols[a] = F.when(flip, F.col(b)).otherwise(F.col(a))
        cols[b] = F.when(flip, F.col(a)).otherwise(F.col(b))
    ok = (X.text_or_empty("leftCnpj") != "") & (X.text_or_empty("rightCnpj") != "") & (F.col("leftCnpj") != F.col("rightCnpj"))
    return edges.where(ok).withColumns(cols)


def partner_rows(partners: DataFrame, supplier_table: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """Registry partners of known suppliers, one row per id; person ids stay masked."""
    ident = F.trim(X.text_or_empty(column(partners, "identificador_de_socio")))
    doc = F.trim(X.text_or_empty(column(partners, "cnpj_cpf_do_socio")))
    masked = F.when((ident == "1") | P.is_company(doc), F.lit(None).cast("string")).when(
        (ident == "2") | F.contains(doc, F.lit("*")), F.nullif(P.mask_person(doc), F.lit("")))
    root = F.substring(F.lpad(F.nullif(X.digits(column(partners, "cnpj_basico")), F.lit("")), 8, "0"), 1, 8)
    rows = partners.select(
        root.alias("root"), X.blank_to_null(column(partners, "nome_socio")).alias("nome"), masked.alias("cpfMasked"),
        F.trim(X.text_or_empty(column(partners, "qualificacao_do_socio"))).alias("_role"),
    ).where(F.col("root").isNotNull() & F.col("nome").isNotNull())
    if roles is not None:
        lookup = roles.select(F.trim("codigo").alias("_role"), X.blank_to_null("descricao").alias("_text"))
        rows = rows.join(lookup.where(F.col("_text").isNotNull()).groupBy("_role").agg(F.max("_text").alias("_text")),
                         "_role", "left")
    else:
        rows = rows.withColumn("_text", F.lit(None).cast("string"))
    rows = rows.withColumn("qualificacao", F.coalesce("_text", F.nullif(F.col("_role"), F.lit(""))))
    known = supplier_table.select(
        F.col("id").alias("fornecedorId"), F.col("cnpj").alias("fornecedorCnpj"),
        F.substring("cnpj", 1, 8).alias("root"))
    joined = rows.join(known.where(F.length("fornecedorCnpj") >= 8), "root")
    return joined.select(
        I.partner_id(F.col("fornecedorCnpj"), F.col("nome"), F.col("cpfMasked"), F.col("qualificacao")).alias("id"),
        "fornecedorId", "fornecedorCnpj", "nome", "cpfMasked", "qualificacao",
    ).distinct()


def activity_lookup(rows: DataFrame, seq: str | None = None) -> DataFrame:
    """(codigo, descricao): digits-only code, first non-empty description."""
    clean = rows.select(
        F.nullif(X.digits("codigo"), F.lit("")).alias("codigo"), X.blank_to_null("descricao").alias("descricao"),
        (F.col(seq) if seq else F.col("descricao")).alias("_o"),
    ).where(F.col("codigo").isNotNull() & F.col("descricao").isNotNull())
    return clean.groupBy("codigo").agg(F.min_by("descricao", "_o").alias("descricao"))


# ---- upserts -----------------------------------------------------------------


def upsert(
    current: DataFrame | None, incoming: DataFrame, keys: list[str], now: Column,
    keep_old_if_null: tuple[str, ...] = (), preserve: tuple[str, ...] = (), refresh_only: tuple[str, ...] | None = None,
    order: list[str] | None = None,
) -> DataFrame:
    """The table after inserting or updating ``incoming`` on its natural key.

    ``keep_old_if_null``: columns whose old value survives a null.
    ``preserve``: columns an update never touches (``suspended``, ``createdAt``
    always are).  ``refresh_only``: if given, an update changes just these.
    Inside ``incoming`` the last row by ``order`` wins.
    """
    fresh = keep_latest(incoming, keys, order) if order else incoming.dropDuplicates(keys)
    values = [c for c in incoming.columns if c not in keys]
    stamps = ["suspended", "createdAt", "updatedAt"]
    if current is None:
        return fresh.withColumns({"suspended": F.lit(False), "createdAt": now, "updatedAt": now})
    old = current.select(*keys, F.struct(*[c for c in current.columns if c not in keys]).alias("_old"))
    new = fresh.select(*keys, F.struct(*values).alias("_new"))
    had = {c for c in current.columns}
    out = []
    for c in values:
        before = F.col("_old")[c] if c in had else F.lit(None)
        after = F.col("_new")[c]
        if c in preserve or (refresh_only is not None and c not in refresh_only):
            both = before
        elif c in keep_old_if_null:
            both = F.coalesce(after, before)
        else:
            both = after
        out.append(
            F.when(F.col("_new").isNull(), before).when(F.col("_old").isNull(), after).otherwise(both).alias(c))
    for c, first in (("suspended", F.lit(False)), ("createdAt", now), ("updatedAt", now)):
        before = F.coalesce(F.col("_old")[c] if c in had else F.lit(None), first)
        out.append((F.when(F.col("_new").isNotNull(), now).otherwise(before) if c == "updatedAt" else before).alias(c))
    extra = [F.col("_old")[c].alias(c) for c in current.columns if c not in keys + values + stamps]
    return old.join(new, keys, "full_outer").select(*keys, *out, *extra)


def insert_absent(current: DataFrame | None, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``incoming`` to append: those whose key is not in the table yet."""
    fresh = keep_first(incoming, keys, []) if set(incoming.columns) - set(keys) else incoming.distinct()
    return fresh if current is None else fresh.join(current.select(*keys), keys, "left_anti")


# ---- ordered scans -----------------------------------------------------------

# Row order of each table scan.
SCAN_ORDER = {
    "licitacao_participante": ["licitacaoId", "itemLote", "participante"],
    "fornecedor_adjacency": ["kind", "leftCnpj", "rightCnpj"],
    "flag": ["kind", "itemId", "id"],
    "item_exclusion": ["reason", "itemId"],
    "co_bid_screen": ["kind", "subjectId"],
    "co_bid_edge": ["kind", "leftCnpj", "rightCnpj", "licitacaoId"],
    "orgao": ["municipioIbge", "cnpj"],
    "fornecedor": ["razaoSocial", "id"],
    "item": ["descricao", "id"],
}


def scan(df: DataFrame, table: str, endpoint: str | None = None, **equal) -> DataFrame:
    """Rows matching every given equality (and, for edges, either endpoint), in table order."""
    for name, value in equal.items():
        if value:
            df = df.where(F.col(name) == value)
    if endpoint:
        df = df.where((F.col("leftCnpj") == endpoint) | (F.col("rightCnpj") == endpoint))
    return df.orderBy(*SCAN_ORDER[table])
