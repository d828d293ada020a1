"""Browse lists, details and their denominators.

Tables: ``buyers`` (orgao), ``suppliers`` (fornecedor), ``contracts``
(contratacao), ``items``.  Each has ``id`` and a boolean ``suspended``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lisura.functions import text as X

DEFAULT_TAKE, MAX_TAKE = 50, 100


@dataclass(frozen=True)
class Tables:
    buyers: DataFrame
    suppliers: DataFrame
    contracts: DataFrame
    items: DataFrame


# ---- visibility --------------------------------------------------------------


def suspend(tables: Tables, suspensions: DataFrame) -> Tables:
    """Apply a suspension list (kind, id) to the four tables."""

    def mark(df: DataFrame, kind: str) -> DataFrame:
        ids = suspensions.where(F.col("kind") == kind).select("id").distinct().withColumn("_hit", F.lit(True))
        old = F.coalesce("suspended", F.lit(False)) if "suspended" in df.columns else F.lit(False)
        return (
            df.join(ids, "id", "left")
            .withColumn("suspended", old | F.coalesce("_hit", F.lit(False)))
            .drop("_hit")
        )

    return Tables(
        mark(tables.buyers, "orgao"), mark(tables.suppliers, "fornecedor"),
        mark(tables.contracts, "contratacao"), mark(tables.items, "item"),
    )


def visible_buyers(t: Tables) -> DataFrame:
    return t.buyers.where(~F.col("suspended"))


def visible_suppliers(t: Tables) -> DataFrame:
    return t.suppliers.where(~F.col("suspended"))


def visible_contracts(t: Tables) -> DataFrame:
    """Contracts that are not suspended, of buyers that are not either."""
    shown = visible_buyers(t).select(F.col("id").alias("orgaoId"))
    return t.contracts.where(~F.col("suspended")).join(shown, "orgaoId", "left_semi")


def _supplier_ok(items: DataFrame, t: Tables) -> DataFrame:
    """Unsuspended items whose supplier, if any, is not suspended.

    Written against the suspended suppliers, the short side: items without a
    supplier never match and stay.
    """
    hidden = t.suppliers.where(F.col("suspended")).select(F.col("id").alias("fornecedorId"))
    return items.where(~F.col("suspended")).join(hidden, "fornecedorId", "left_anti")


def visible_items(t: Tables) -> DataFrame:
    shown = visible_contracts(t).select(F.col("id").alias("contratacaoId"))
    return _supplier_ok(t.items, t).join(shown, "contratacaoId", "left_semi")


# ---- paging and coverage -----------------------------------------------------


def page(df: DataFrame, order: list[Column | str], skip: int | None = None, take: int | None = None) -> DataFrame:
    """One page in a total order: a distributed top-k, never a full sort."""
    skip = skip if skip is not None and skip >= 0 else 0
    take = DEFAULT_TAKE if take is None or take <= 0 else min(take, MAX_TAKE)
    return df.orderBy(*order).offset(skip).limit(take)


def page_coverage(rows: DataFrame, version: str, uf: str | None = None, quarter: str | None = None) -> DataFrame:
    """(n, uf, quarter, methodologyVersion) of a filtered list."""
    return rows.agg(F.count(F.lit(1)).alias("n")).select(
        "n", F.lit(uf or "").alias("uf"), F.lit(quarter or "").alias("quarter"),
        F.lit(version).alias("methodologyVersion"),
    )


def _contains(name: str, q: str) -> Column:
    return F.contains(F.col(name), F.lit(q))


def _coverage(n: str, uf: Column, quarter: Column, version: Column) -> Column:
    return F.struct(
        F.coalesce(F.col(n), F.lit(0)).cast("long").alias("n"), uf.alias("uf"),
        quarter.alias("quarter"), version.alias("methodologyVersion"),
    ).alias("coverage")


# ---- denominators --------------------------------------------------------------


def buyer_counts(t: Tables, version: str, quarter: str | None = None) -> DataFrame:
    """(orgaoId, n): visible items of a buyer's unsuspended contracts."""
    items = _supplier_ok(t.items, t).where(F.col("methodologyVersion") == version)
    if quarter is not None:
        items = items.where(F.col("quarter") == quarter)
    # Counting per contract first shrinks the join to one row per contract.
    per_contract = items.groupBy("contratacaoId").agg(F.count(F.lit(1)).alias("k"))
    contracts = t.contracts.where(~F.col("suspended")).select(F.col("id").alias("contratacaoId"), "orgaoId")
    return per_contract.join(contracts, "contratacaoId").groupBy("orgaoId").agg(F.sum("k").alias("n"))


def supplier_counts(t: Tables, version: str, uf: str | None = None, quarter: str | None = None) -> DataFrame:
    """(fornecedorId, n): items of a supplier under visible contracts."""
    items = t.items.where(~F.col("suspended") & (F.col("methodologyVersion") == version) & F.col("fornecedorId").isNotNull())
    if uf is not None:
        items = items.where(F.col("uf") == uf)
    if quarter is not None:
        items = items.where(F.col("quarter") == quarter)
    shown = visible_contracts(t).select(F.col("id").alias("contratacaoId"))
    return items.join(shown, "contratacaoId", "left_semi").groupBy("fornecedorId").agg(F.count(F.lit(1)).alias("n"))


def contract_counts(t: Tables) -> DataFrame:
    """(contratacaoId, n, latest_quarter); only ``n`` looks at suspension."""
    hidden = t.suppliers.where(F.col("suspended")).select(F.col("id").alias("fornecedorId")).withColumn("_h", F.lit(True))
    shown = ~F.col("suspended") & F.col("_h").isNull()
    return (
        t.items.join(hidden, "fornecedorId", "left")
        .groupBy("contratacaoId")
        .agg(F.count_if(shown).alias("n"), F.max("quarter").alias("latest_quarter"))
    )


def item_counts(universe: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Peer counts of a set of items: per slice and code, and per slice."""
    slice_ = ["uf", "quarter", "methodologyVersion"]
    coded = universe.groupBy(*slice_, "catmat").agg(F.count(F.lit(1)).alias("n_code"))
    total = coded.groupBy(*slice_).agg(F.sum("n_code").alias("n_all"))
    return coded.where(F.col("catmat").isNotNull()), total


def with_item_coverage(items: DataFrame, universe: DataFrame) -> DataFrame:
    """Add the peer denominator; an item without a code counts its whole slice."""
    coded, total = item_counts(universe)
    slice_ = ["uf", "quarter", "methodologyVersion"]
    joined = items.join(coded, [*slice_, "catmat"], "left").join(total, slice_, "left")
    n = F.when(F.col("catmat").isNull(), F.col("n_all")).otherwise(F.col("n_code"))
    joined = joined.withColumn("_n", n)
    return joined.withColumn(
        "coverage", _coverage("_n", F.col("uf"), F.col("quarter"), F.col("methodologyVersion"))
    ).drop("_n", "n_code", "n_all")


# ---- lists ---------------------------------------------------------------------


def with_buyer_coverage(buyers: DataFrame, t: Tables, version: str, quarter: str | None = None) -> DataFrame:
    counts = buyer_counts(t, version, quarter).withColumnRenamed("orgaoId", "id")
    return buyers.join(counts, "id", "left").withColumn(
        "coverage", _coverage("n", F.col("uf"), F.lit(quarter or ""), F.lit(version))).drop("n")


def with_supplier_coverage(
    suppliers: DataFrame, t: Tables, version: str, uf: str | None = None, quarter: str | None = None
) -> DataFrame:
    counts = supplier_counts(t, version, uf, quarter).withColumnRenamed("fornecedorId", "id")
    return suppliers.join(counts, "id", "left").withColumn(
        "coverage", _coverage("n", F.lit(uf or ""), F.lit(quarter or ""), F.lit(version))).drop("n")


def with_contract_coverage(contracts: DataFrame, t: Tables) -> DataFrame:
    counts = contract_counts(t).withColumnRenamed("contratacaoId", "id")
    owners = t.buyers.select(
        F.col("id").alias("orgaoId"), F.col("razaoSocial").alias("orgaoRazaoSocial"), F.col("uf").alias("_uf"))
    joined = contracts.join(owners, "orgaoId").join(counts, "id", "left")
    return joined.withColumn(
        "coverage",
        _coverage("n", F.col("_uf"), F.coalesce("latest_quarter", F.lit("")), F.col("methodologyVersion")),
    ).drop("n", "_uf", "latest_quarter")


def filter_buyers(
    t: Tables, q: str | None = None, esfera: str | None = None, uf: str | None = None, ibge: str | None = None
) -> DataFrame:
    rows = visible_buyers(t)
    if q:
        rows = rows.where(_contains("razaoSocial", q) | _contains("cnpj", q))
    for name, value in (("esfera", esfera), ("uf", uf), ("municipioIbge", ibge)):
        if value:
            rows = rows.where(F.col(name) == value)
    return rows


def list_buyers(
    t: Tables, version: str, q: str | None = None, esfera: str | None = None, uf: str | None = None,
    ibge: str | None = None, quarter: str | None = None, skip: int | None = None, take: int | None = None,
) -> DataFrame:
    """One page of buyers by name and id; only the page's rows get coverage."""
    rows = page(filter_buyers(t, q, esfera, uf, ibge), ["razaoSocial", "id"], skip, take)
    return with_buyer_coverage(rows, t, version, quarter)


def filter_suppliers(t: Tables, q: str | None = None, cnae: str | None = None) -> DataFrame:
    rows = visible_suppliers(t)
    if q:
        rows = rows.where(_contains("razaoSocial", q) | _contains("cnpj", q))
    if cnae:
        rows = rows.where(F.col("cnae") == cnae)
    return rows


def list_suppliers(
    t: Tables, version: str, q: str | None = None, cnae: str | None = None, uf: str | None = None,
    quarter: str | None = None, skip: int | None = None, take: int | None = None,
) -> DataFrame:
    """State and quarter change the denominator only, never the rows."""
    rows = page(filter_suppliers(t, q, cnae), ["razaoSocial", "id"], skip, take)
    return with_supplier_coverage(rows, t, version, uf, quarter)


def filter_contracts(
    t: Tables, q: str | None = None, buyer: str | None = None, supplier: str | None = None, ano: int | None = None,
    modalidade: str | None = None, uf: str | None = None, version: str | None = None,
) -> DataFrame:
    rows = visible_contracts(t)
    if q:
        rows = rows.where(_contains("objeto", q) | _contains("pncpId", q))
    if buyer:
        rows = rows.where(F.col("orgaoId") == buyer)
    if supplier:
        sold = _supplier_ok(t.items.where(F.col("fornecedorId") == supplier), t)
        rows = rows.join(sold.select(F.col("contratacaoId").alias("id")), "id", "left_semi")
    if ano is not None:
        rows = rows.where(F.col("ano") == ano)
    if modalidade:
        rows = rows.where(F.col("modalidade") == modalidade)
    if uf:
        rows = rows.join(t.buyers.where(F.col("uf") == uf).select(F.col("id").alias("orgaoId")), "orgaoId", "left_semi")
    if version:
        rows = rows.where(F.col("methodologyVersion") == version)
    return rows


def list_contracts(t: Tables, skip: int | None = None, take: int | None = None, **filters) -> DataFrame:
    """Newest first, undated ones before them."""
    rows = page(filter_contracts(t, **filters), [F.col("publicadoEm").desc_nulls_first(), F.col("id")], skip, take)
    return with_contract_coverage(rows, t)


def filter_items(
    t: Tables, q: str | None = None, contract: str | None = None, supplier: str | None = None,
    buyer: str | None = None, catmat: str | None = None, uf: str | None = None, quarter: str | None = None,
    version: str | None = None,
) -> DataFrame:
    rows = visible_items(t)
    if q:
        rows = rows.where(_contains("descricao", q) | F.coalesce(_contains("catmat", q), F.lit(False)))
    pairs = (("contratacaoId", contract), ("fornecedorId", supplier), ("catmat", catmat), ("uf", uf),
             ("quarter", quarter), ("methodologyVersion", version))
    for name, value in pairs:
        if value:
            rows = rows.where(F.col(name) == value)
    if buyer:
        own = t.contracts.where(F.col("orgaoId") == buyer).select(F.col("id").alias("contratacaoId"))
        rows = rows.join(own, "contratacaoId", "left_semi")
    return rows


def list_items(t: Tables, skip: int | None = None, take: int | None = None, **filters) -> DataFrame:
    """One page of items; the filtered list itself is the peer universe."""
    universe = filter_items(t, **filters)
    return with_item_coverage(page(universe, ["descricao", "id"], skip, take), universe)


def parse_state(raw: str | None, states: tuple[str, ...]) -> str | None:
    """Closed-set state from its snake-case text or its enum name."""
    if not raw:
        return None
    for state in states:
        if raw == state or raw.lower() == state.replace("_", ""):
            return state
    raise ValueError("unknown flag state")


def filter_flags(flags: DataFrame, kind: str | None = None, state: str | None = None, item: str | None = None) -> DataFrame:
    for name, value in (("kind", kind), ("state", state), ("itemId", item)):
        if value:
            flags = flags.where(F.col(name) == value)
    return flags


def list_flags(
    flags: DataFrame, kind: str | None = None, state: str | None = None, item: str | None = None,
    skip: int | None = None, take: int | None = None,
) -> DataFrame:
    return page(filter_flags(flags, kind, state, item), ["kind", "itemId", "id"], skip, take)


# ---- details, for all keys at once ----------------------------------------------


def item_details(t: Tables) -> DataFrame:
    """Visible items with buyer, supplier and contract names and peer coverage."""
    shown = visible_items(t)
    contracts = t.contracts.select(
        F.col("id").alias("contratacaoId"), "orgaoId", F.col("pncpId").alias("contratacaoPncpId"))
    buyers = t.buyers.select(F.col("id").alias("orgaoId"), F.col("razaoSocial").alias("orgaoRazaoSocial"))
    suppliers = t.suppliers.select(
        F.col("id").alias("fornecedorId"), F.col("razaoSocial").alias("fornecedorRazaoSocial"))
    return (
        with_item_coverage(shown, shown)
        .join(contracts, "contratacaoId").join(buyers, "orgaoId").join(suppliers, "fornecedorId", "left")
    )


def contract_item_rows(t: Tables) -> DataFrame:
    """Visible contracts with their visible items, one row per item, in list order.

    The item list is kept as rows: a contract may have any number of items, so
    it is not folded into one value.
    """
    shown = visible_items(t)
    heads = with_contract_coverage(visible_contracts(t), t).select(
        F.col("id").alias("contratacaoId"), "pncpId", "orgaoRazaoSocial",
        F.col("coverage").alias("contractCoverage"))
    return with_item_coverage(shown, shown).join(heads, "contratacaoId", "right")


def age_text(opened: Column, as_of: Column) -> Column:
    """Company age in whole years and months, in words."""
    months = F.floor(F.months_between(as_of, opened)).cast("int")
    years, rest = F.floor(months / 12).cast("int"), (months % 12).cast("int")

    def counted(n: Column, one: str, many: str) -> Column:
        return F.when(n == 1, F.lit("1 " + one)).otherwise(F.concat(n.cast("string"), F.lit(" " + many)))

    y, m = counted(years, "ano", "anos"), counted(rest, "mês", "meses")
    return (
        F.when(opened.isNull() | (opened > as_of), "n/d")
        .when(months == 0, "menos de 1 mês")
        .when(years == 0, m)
        .when(rest == 0, y)
        .otherwise(F.concat(y, F.lit(" e "), m))
    )


def activity_text(suppliers: DataFrame, activities: DataFrame) -> DataFrame:
    """Add the description of the supplier's activity code (digits only)."""
    lookup = activities.select(F.col("codigo").alias("_code"), F.col("descricao").alias("cnaeDescricao"))
    return suppliers.withColumn("_code", F.nullif(X.digits("cnae"), F.lit(""))).join(lookup, "_code", "left").drop("_code")


def supplier_details(t: Tables, activities: DataFrame, version: str, as_of: Column) -> DataFrame:
    """Visible suppliers with activity text, age in words and coverage."""
    rows = activity_text(with_supplier_coverage(visible_suppliers(t), t, version), activities)
    return rows.withColumn("idadeCadastral", age_text(F.col("openedOn"), as_of)).withColumn("idadeAsOf", as_of)


def supplier_partner_rows(t: Tables, partners: DataFrame) -> DataFrame:
    """Partners of visible suppliers, one row each, to be listed by name."""
    shown = visible_suppliers(t).select(F.col("id").alias("fornecedorId"), "cnpj", "razaoSocial")
    return shown.join(partners.select("fornecedorId", "nome", "cpfMasked", "qualificacao"), "fornecedorId")
