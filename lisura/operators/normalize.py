"""Landed purchase rows to typed, coded, comparable items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lisura.functions import fixed
from lisura.functions import text as X
from lisura.operators.classify import description_key, nearest_entries, score_new
from lisura.operators.specs import with_spec_fields
from lisura.operators.stats import keep_first
from lisura.operators.units import match_units
from lisura.session import cut_lineage


class Fields:
    """Alias-first lookup of columns by folded header name."""

    def __init__(self, df: DataFrame):
        self.have = {X.fold_name(c): c for c in df.columns}

    def __call__(self, *names: str) -> Column:
        found = [F.col(f"`{self.have[k]}`").cast("string") for k in map(X.fold_name, names) if k in self.have]
        return F.coalesce(*[F.nullif(c, F.lit("")) for c in found], F.lit(None).cast("string"))


# ---- contract id keys ---------------------------------------------------------


def contract_key(pncp: Column) -> Column:
    """Struct (cnpj, ano, seq) of ``id-1-seq/year`` and ``id-1-year-seq``; null if neither."""
    raw = F.trim(pncp)
    head, year = F.substring_index(raw, "/", 1), F.substring_index(raw, "/", -1)
    slashed = F.contains(raw, F.lit("/"))
    # The year follows the last slash; everything before it is the head.
    head = F.when(slashed, F.substring(raw, F.lit(1), F.length(raw) - F.length(year) - 1)).otherwise(raw)
    parts = F.split(head, "-")
    cnpj = X.digits(F.element_at(parts, 1))
    last, before = F.try_element_at(parts, F.lit(-1)), F.try_element_at(parts, F.lit(-2))

    def number(c: Column) -> Column:
        return F.when(c.rlike("^[0-9]+$"), c).try_cast("long")

    ok_slash = slashed & (F.size(parts) >= 3) & number(year).isNotNull() & number(last).isNotNull()
    ok_dash = ~slashed & (F.size(parts) >= 4) & number(before).isNotNull() & number(last).isNotNull()
    ano = F.when(slashed, number(year)).otherwise(number(before))
    return F.when(
        (ok_slash | ok_dash) & (F.length(cnpj) == 14),
        F.struct(cnpj.alias("cnpj"), ano.alias("ano"), number(last).alias("seq")),
    )


def contract_keys(rows: DataFrame) -> DataFrame:
    """Distinct (cnpj, ano, seq) named by a landed frame."""
    pick = Fields(rows)
    key = contract_key(pick("numerocontrolepncp", "idcontratacaopncp", "numero_controle_pncp", "pncp_id"))
    return rows.select(key.alias("k")).where(F.col("k").isNotNull()).select("k.*").distinct()


def item_keys(rows: DataFrame) -> DataFrame:
    """Distinct (cnpj, ano, seq, item) named by a landed frame."""
    pick = Fields(rows)
    key = contract_key(pick("numerocontrolepncp", "idcontratacaopncp", "numero_controle_pncp", "pncp_id"))
    number = F.trim(pick("numeroitem", "numero_item", "numeroitemcompra"))
    item = F.when(number.rlike("^-*[0-9]+$"), number).try_cast("long")
    return (
        rows.select(key.alias("k"), item.alias("item"))
        .where(F.col("k").isNotNull() & F.col("item").isNotNull()).select("k.*", "item").distinct()
    )


def gap_rows(rows: DataFrame, covered: DataFrame) -> DataFrame:
    """Rows whose contract the bulk files lack; rows with an unreadable id stay."""
    pick = Fields(rows)
    key = contract_key(pick("numerocontrolepncp", "idcontratacaopncp", "numero_controle_pncp", "pncp_id"))
    keyed = rows.withColumn("_k", key)
    names = ("cnpj", "ano", "seq")
    keyed = keyed.withColumns({f"_{n}": F.col("_k")[n] for n in names})
    have = covered.select(*[F.col(n).alias(f"_{n}") for n in names])
    return keyed.join(have, [f"_{n}" for n in names], "left_anti").select(*rows.columns)


# ---- lookups ---------------------------------------------------------------------


def registry_index(registry: DataFrame) -> DataFrame:
    """(cnpj, opened_on, cnae, cnae_secundaria, razao_social), one row per 14-digit id."""
    pick = Fields(registry)
    built = F.concat(
        F.coalesce(pick("cnpj_basico"), F.lit("")), F.lpad(F.coalesce(pick("cnpj_ordem"), F.lit("0001")), 4, "0"),
        F.lpad(F.coalesce(pick("cnpj_dv"), F.lit("")), 2, "0"))
    rows = registry.select(
        X.digits(F.coalesce(pick("cnpj"), built)).alias("cnpj"),
        X.parse_date(pick("data_inicio_atividade", "opened_on")).alias("opened_on"),
        pick("cnae_fiscal_principal", "cnae").alias("cnae"),
        pick("cnae_fiscal_secundaria", "cnae_secundaria").alias("cnae_secundaria"),
        pick("razao_social", "nome_fantasia").alias("razao_social"),
    ).where(F.length("cnpj") == 14)
    rest = ["opened_on", "cnae", "cnae_secundaria", "razao_social"]
    return rows.groupBy("cnpj").agg(F.max(F.struct(*rest)).alias("r")).select("cnpj", "r.*")


def catalog_table(*frames: DataFrame) -> DataFrame:
    """Catalog frames of any header spelling as (codigo, descricao, tipo, codigo_classe, codigo_grupo, seq)."""
    out = None
    for i, df in enumerate(frames):
        pick = Fields(df)
        rows = df.select(
            F.trim(pick("codigo", "codigoitem", "coditemcatalogo", "codigoitemcatalogo", "coditem")).alias("codigo"),
            F.coalesce(pick("descricao", "descricaoitem", "descricaoitemcatalogo", "nome"), F.lit("")).alias("descricao"),
            F.coalesce(F.nullif(F.upper(F.substring(F.trim(pick("tipo", "materialouservico", "natureza")), 1, 1)), F.lit("")),
                       F.lit("M")).alias("tipo"),
            pick("codigo_classe", "classe").alias("codigo_classe"),
            pick("codigo_grupo", "grupo").alias("codigo_grupo"),
            (F.col("seq").cast("long") if "seq" in df.columns else F.lit(0).cast("long")).alias("_s"),
        ).where(F.col("codigo").isNotNull())
        rows = rows.withColumn("seq", F.struct(F.lit(i).alias("frame"), F.col("_s").alias("row"), "codigo")).drop("_s")
        out = rows if out is None else out.unionByName(rows)
    return out


def match_catalog(rows: DataFrame, catalog: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """(descricao, codigo, tipo) distinct, with catmat, catser and match quality.

    A given code is taken as it is (a service if the row says so or the code
    is one).  Otherwise the folded text is looked up exactly, materials before
    services, and what is left is scored once per distinct text.
    """
    # The wide rows are read once for their distinct texts; all that follows works on those.
    asked = cut_lineage(rows.select("descricao", "codigo", "tipo").distinct())
    kind = F.upper(F.substring(F.trim(X.text_or_empty("tipo")), 1, 1))
    keyed = asked.withColumn("kind", kind).withColumn("code", X.blank_to_null("codigo")).withColumn(
        "folded", X.fold("descricao"))
    services = catalog.where(F.col("tipo") == "S").select(F.col("codigo").alias("code")).distinct().withColumn(
        "is_service", F.lit(True))
    texts = catalog.select(X.fold("descricao").alias("folded"), "codigo", (F.col("tipo") == "S").alias("s"), "seq").where(
        F.col("folded") != "")
    by_text = texts.groupBy("folded").agg(
        F.max(F.when(~F.col("s"), F.struct("seq", "codigo")))["codigo"].alias("m_code"),
        F.max(F.when(F.col("s"), F.struct("seq", "codigo")))["codigo"].alias("s_code"),
    )
    joined = keyed.join(services, "code", "left").join(by_text, "folded", "left")
    coded = F.col("code").isNotNull()
    as_service = (F.col("kind") == "S") | F.coalesce("is_service", F.lit(False))
    m_hit = ~coded & (F.col("kind") != "S") & F.col("m_code").isNotNull()
    s_hit = ~coded & ~m_hit & (F.col("kind") != "M") & F.col("s_code").isNotNull()
    exact = joined.withColumn("catmat", F.when(coded & ~as_service, F.col("code")).when(m_hit, F.col("m_code"))).withColumn(
        "catser", F.when(coded & as_service, F.col("code")).when(s_hit, F.col("s_code"))).withColumn(
        "done", coded | m_hit | s_hit)
    left_over = exact.where(~F.col("done") & (F.col("folded") != "")).select("folded", "kind")
    key = ["folded", "kind"]
    names = [F.col("catmat").alias("k_m"), F.col("catser").alias("k_s"), F.col("quality").alias("k_q")]
    if cache is None:
        scores = nearest_entries(left_over, catalog).select(*key, *names)
        final = exact.join(scores, key, "left")
    else:
        # Texts that the cache does not know are scored now.
        scores = cache.select("hash", *names).unionByName(score_new(left_over, catalog, cache).select("hash", *names))
        final = exact.withColumn("hash", description_key(F.col("folded"), F.col("kind"))).join(scores, "hash", "left")
    quality = F.when(F.col("done"), "exact").otherwise(F.coalesce("k_q", F.lit("none")))
    return final.select(
        "descricao", "codigo", "tipo",
        F.when(F.col("done"), F.col("catmat")).otherwise(F.col("k_m")).alias("catmat"),
        F.when(F.col("done"), F.col("catser")).otherwise(F.col("k_s")).alias("catser"),
        quality.alias("catmat_match_quality"),
    )


def price_per_unit(confidence: Column, factor: Column, unit: Column, qty: Column, total: Column) -> Column:
    """Unit price over the unit's factor, else total over quantity over factor; six places."""
    price = F.coalesce(unit.cast(X.WIDE), F.try_divide(total.cast(X.WIDE), F.nullif(qty, F.lit(0).cast(X.MONEY)).cast(X.WIDE)))
    value = F.bround(F.try_divide(price.cast(X.WIDE), F.nullif(factor, F.lit(0).cast(X.MONEY)).cast(X.WIDE)).cast(X.WIDE), 6)
    return F.when(confidence != "unknown", value).cast(X.MONEY)


# Which headers feed each field, first non-empty wins.
ALIASES = {
    "orgao_cnpj": ("orgaoentidadecnpj", "orgao_cnpj"),
    "orgao_razao": ("orgaoentidaderazaosocial", "orgao_razao"),
    "esfera": ("orgaoentidadeesferaid", "esfera"),
    "poder": ("orgaoentidadepoderid", "poder"),
    "uf": ("unidadeorgaoufsigla", "uf"),
    "municipio_ibge": ("unidadeorgaocodigoibge", "municipio_ibge"),
    "municipio_nome": ("unidadeorgaomunicipionome", "municipio_nome"),
    "fornecedor_cnpj": ("codfornecedor", "nifornecedor", "fornecedor_cnpj"),
    "fornecedor_razao": ("nomefornecedor", "fornecedor_razao"),
    "pncp_id": ("numerocontrolepncp", "idcontratacaopncp", "pncp_id"),
    "modalidade": ("modalidadenome", "modalidade"),
    "modalidade_codigo": ("codigomodalidade", "modalidade_codigo"),
    "objeto": ("objetocompra", "objeto"),
    "ano": ("anocomprapncp", "anocompra", "ano"),
    "valor_homologado": ("valortotalhomologado",),
    "publicado_em": ("datapublicacaopncp", "datainclusaopncp"),
    "data_resultado": ("dataresultado", "data_resultado"),
    "award_date": ("award_date",),
    "included_on": ("datainclusaopncp",),
    "descricao": ("descricaodetalhada", "descricao_detalhada", "descricaoresumida", "descricao"),
    "codigo": ("coditemcatalogo", "codigoitemcatalogo", "coditem"),
    "material_ou_servico": ("materialouservico",),
    "quantidade": ("quantidaderesultado", "quantidade"),
    "unidade_medida": ("unidademedida", "nomeunidademedida", "siglaunidademedida"),
    "valor_unitario": ("valorunitarioresultado", "valorunitariohomologado", "valorunitario", "valorunitarioestimado"),
    "valor_total": ("valortotalresultado", "valortotal"),
    "valor_referencia": ("valor_referencia", "preco_referencia", "valor_referencia_catalogo"),
    "preco_referencia": ("preco_referencia",),
    "source": ("source",),
    "record_id": ("record_id",),
    "record_hash": ("record_hash",),
    "id_compra": ("idcompra",),
    "id_compra_item": ("idcompraitem",),
}
NUMBERS = ("valor_homologado", "quantidade", "valor_unitario", "valor_total", "valor_referencia", "preco_referencia")


def read_fields(raw: DataFrame, snapshot: Column, version: str) -> DataFrame:
    """Landed text columns to typed fields (before lookups), in two projections.

    Headers are resolved once, on the frame; the first projection picks the
    text, the second parses each text once.
    """
    pick = Fields(raw)
    texts = raw.select(snapshot.alias("snapshot_id"), *[pick(*names).alias(name) for name, names in ALIASES.items()])
    spheres = F.create_map(*[F.lit(x) for pair in fixed.SPHERES.items() for x in pair])
    parsed = texts.withColumns({
        **{name: X.parse_decimal(name) for name in NUMBERS},
        "publicado_em": X.parse_timestamp("publicado_em"),
        "data_resultado": X.parse_date("data_resultado"), "award_date": X.parse_date("award_date"),
        "included_on": X.parse_date("included_on"),
        "esfera": F.coalesce(F.try_element_at(spheres, X.fold("esfera")), F.lit("municipal")),
        "poder": F.coalesce(F.nullif(X.fold("poder"), F.lit("")), F.lit("executivo")),
        "fornecedor_cnpj": X.digits("fornecedor_cnpj"), "orgao_cnpj": F.nullif(X.digits("orgao_cnpj"), F.lit("")),
        "uf": F.upper("uf"),
    })
    return parsed.withColumns({
        "award_date": F.coalesce("award_date", "data_resultado", "included_on"),
        "ano": F.coalesce(F.col("ano"), F.year("publicado_em").cast("string")),
        "quantidade": F.coalesce(F.col("quantidade"), F.lit(0).cast(X.MONEY)),
        "fornecedor_cnpj": F.when(F.length("fornecedor_cnpj") == 14, F.col("fornecedor_cnpj")),
        "_supplier_name": F.col("fornecedor_razao"), "uf_item": F.col("uf"),
        "quarter": X.quarter_label(F.col("publicado_em")), "methodology_version": F.lit(version),
        "source": F.coalesce(F.col("source"), F.lit("federal_purchases")),
    }).drop("included_on", "fornecedor_razao")


# The item columns, in order.
ITEM_COLUMNS = (
    "orgao_cnpj", "orgao_razao", "esfera", "poder", "uf", "municipio_ibge", "municipio_nome",
    "fornecedor_cnpj", "fornecedor_razao", "opened_on", "cnae", "cnae_secundaria", "pncp_id", "modalidade",
    "modalidade_codigo", "objeto", "ano", "valor_homologado", "publicado_em", "data_resultado", "award_date",
    "descricao", "catmat", "catser", "catmat_match_quality", "spec_concentracao", "spec_dosagem",
    "spec_tamanho", "quantidade", "unidade_medida", "unidade_canonica", "unit_parse_confidence",
    "valor_unitario", "valor_total", "valor_referencia", "preco_referencia", "valor_por_unidade_canonica",
    "valor_unitario_base", "base_unit", "uf_item", "quarter", "snapshot_id", "methodology_version", "source",
    "record_id", "record_hash", "material_ou_servico", "id_compra", "id_compra_item",
)


def normalize_items(
    raw: DataFrame, catalog: DataFrame, registry: DataFrame | None = None, units: DataFrame | None = None,
    snapshot: Column | None = None, version: str = "", cache: DataFrame | None = None,
) -> DataFrame:
    """Typed item rows.  Catalog and unit work is done once per distinct text and joined back."""
    if snapshot is None:
        snapshot = F.col("snapshot_id") if "snapshot_id" in raw.columns else F.lit("")
    rows = read_fields(raw, snapshot, version)
    texts = rows.select("descricao", "codigo", F.col("material_ou_servico").alias("tipo"))
    codes = match_catalog(texts, catalog, cache)
    units_of = match_units(rows.where(F.col("unidade_medida").isNotNull()), units)
    # Null-safe on the three text columns: absent stays absent.
    marked = {c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for c in ("descricao", "codigo")}
    left = rows.withColumns({"_d": marked["descricao"], "_c": marked["codigo"],
                             "_t": F.coalesce(F.concat(F.lit("="), F.col("material_ou_servico")), F.lit("-"))})
    specs = ["spec_concentracao", "spec_dosagem", "spec_tamanho"]
    right = with_spec_fields(codes).select(
        marked["descricao"].alias("_d"), marked["codigo"].alias("_c"),
        F.coalesce(F.concat(F.lit("="), F.col("tipo")), F.lit("-")).alias("_t"), "catmat", "catser", "catmat_match_quality",
        *specs)
    joined = left.join(right, ["_d", "_c", "_t"], "left").join(units_of, "unidade_medida", "left")
    if registry is None:
        nothing = F.lit(None).cast("string")
        joined = joined.withColumns({"opened_on": F.lit(None).cast("date"), "cnae": nothing, "cnae_secundaria": nothing,
                                     "fornecedor_razao": F.col("_supplier_name")})
    else:
        index = registry_index(registry).withColumnRenamed("cnpj", "fornecedor_cnpj")
        joined = joined.join(index, "fornecedor_cnpj", "left").withColumn(
            "fornecedor_razao", F.coalesce("_supplier_name", "razao_social"))
    confidence = F.coalesce("unit_parse_confidence", F.lit("unknown"))
    price = price_per_unit(
        confidence, F.coalesce("fator", F.lit(1).cast(X.MONEY)), F.col("valor_unitario"), F.col("quantidade"), F.col("valor_total"))
    done = joined.withColumns({
        "unit_parse_confidence": confidence, "unidade_canonica": F.coalesce("unidade_canonica", F.lit("unknown")),
        "base_unit": F.coalesce("base_unit", F.lit("unknown")), "valor_por_unidade_canonica": price,
        "valor_unitario_base": price,
    })
    return done.select(*ITEM_COLUMNS)


def normalize_gaps(pages: DataFrame, bulk: DataFrame, catalog: DataFrame, seq: str = "snapshot_id", **options) -> DataFrame:
    """Gap rows of the API landing as items, the first per record across snapshots."""
    gaps = gap_rows(pages, contract_keys(bulk))
    first = keep_first(gaps.where(X.blank_to_null("record_id").isNotNull()), ["record_id"], [seq, "record_hash"])
    unnamed = gaps.where(X.blank_to_null("record_id").isNull()).select(*first.columns)
    return normalize_items(first.unionByName(unnamed), catalog, **options)
