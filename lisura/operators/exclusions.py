"""Data-error tags: rows to leave out of price comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lisura.functions import text as X
from lisura.operators.stats import median_of_counts, value_counts

COLUMNS = ["record_id", "pncp_id", "reason", "detail", "snapshot_id", "methodology_version"]
SHIFT_BANDS = ((1.8, 2.2), (2.8, 3.2))
MIN_PEERS = 3
HIGH_RATIO, LOW_RATIO = 100, 0.01


def money(name: str) -> Column:
    return F.col(name).cast(X.MONEY)


def _tag(reason: str, detail: Column) -> list[Column]:
    return [
        X.text_or_empty("record_id").alias("record_id"),
        X.text_or_empty("pncp_id").alias("pncp_id"),
        F.lit(reason).alias("reason"),
        detail.alias("detail"),
        X.text_or_empty("snapshot_id").alias("snapshot_id"),
        X.text_or_empty("methodology_version").alias("methodology_version"),
    ]


def _labelled(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def mismatch_test(qty: Column, unit: Column, total: Column) -> Column:
    """True when quantity x unit price misses the total, absolutely and relatively."""
    product = qty * unit
    gap = F.abs(product - total)
    scale = F.greatest(F.abs(total).cast(X.WIDE), F.abs(product).cast(X.WIDE), F.lit(1).cast(X.WIDE))
    return (gap > F.lit(0.02).cast("decimal(4,2)")) & (gap.cast(X.WIDE) > scale * F.lit("0.002").cast("decimal(4,3)"))


def qty_price_mismatch(items: DataFrame) -> DataFrame:
    q, u, t = money("quantidade"), money("valor_unitario"), money("valor_total")
    detail = _labelled(
        "qty * unit_price != total_value. qty=", q, " unit_price=", u, " product=", q * u, " total=", t
    )
    return items.where(mismatch_test(q, u, t)).select(*_tag("qty_unit_price_neq_total", detail))


def quantity_one_collapse(items: DataFrame) -> DataFrame:
    q, u, t = money("quantidade"), money("valor_unitario"), money("valor_total")
    detail = _labelled("quantidade==1 and unit_price==total_value. qty=", q, " unit_price=", u, " total=", t)
    return items.where((q == 1) & (u == t)).select(*_tag("qty_eq_1_collapse", detail))


def zero_or_negative(items: DataFrame) -> DataFrame:
    q, u, t = money("quantidade"), money("valor_unitario"), money("valor_total")
    hits = F.concat_ws(
        " ",
        F.when(q <= 0, _labelled("quantidade=", q)),
        F.when(u <= 0, _labelled("valor_unitario=", u)),
        F.when(t < 0, _labelled("valor_total=", t)),
    )
    return items.where((q <= 0) | (u <= 0) | (t < 0)).select(
        *_tag("zero_or_negative", F.concat(F.lit("non-positive money or qty. "), hits))
    )


def peer_key(items: DataFrame) -> Column:
    """``catmat:x``, else ``catser:x``, else ``desc:folded text``; null when none."""
    desc = F.nullif(X.fold(X.column(items, "descricao")), F.lit(""))
    return F.coalesce(
        F.concat(F.lit("catmat:"), X.blank_to_null(X.column(items, "catmat"))),
        F.concat(F.lit("catser:"), X.blank_to_null(X.column(items, "catser"))),
        F.concat(F.lit("desc:"), desc),
    )


def decimal_shift(items: DataFrame, min_peers: int = MIN_PEERS) -> DataFrame:
    """Price about 100 or 1000 times away from the median of its peers."""
    priced = items.select(
        "record_id", "pncp_id", "snapshot_id", "methodology_version",
        peer_key(items).alias("peer"), money("valor_unitario").alias("price"),
    ).where(F.col("peer").isNotNull() & (F.col("price") > 0))
    # Tested on the distinct prices of a peer group; only what is found meets the rows.
    prices = value_counts(priced, ["peer"], "price")
    medians = median_of_counts(prices, ["peer"]).where((F.col("n") >= min_peers) & (F.col("median") > 0))
    mag = F.abs(F.log10(F.col("price").cast("double") / F.col("median").cast("double")))
    in_band = F.lit(False)
    for low, high in SHIFT_BANDS:
        in_band = in_band | mag.between(low, high)
    detail = _labelled(
        "unit_price is a 100x or 1000x shift from peer median. peer=", F.col("peer"),
        " price=", F.col("price"), " median=", F.col("median").cast(X.MONEY),
        " abs_log10=", F.format_string("%.4f", mag),
    )
    shifted = prices.withColumnRenamed("_v", "price").join(medians, "peer").where(in_band).select("peer", "price", "median")
    return priced.join(shifted, ["peer", "price"]).select(*_tag("decimal_shift", detail))


def duplicate_rows(items: DataFrame) -> DataFrame:
    """All but the first record of rows equal on contract, item and money.

    Identical copies are counted before anything is shuffled by key, and the
    first record is a ``min`` aggregate, so a huge group of copies costs one
    row per map task.
    """
    number = X.blank_to_null(X.column(items, "id_compra_item"))
    key = ["pncp", "item", "q", "u", "t"]
    who = ["rid", "snap", "meth"]
    copies = (
        items.select(
            X.blank_to_null("pncp_id").alias("pncp"),
            F.coalesce(number, F.nullif(X.fold("descricao"), F.lit(""))).alias("item"),
            # Absent money compares equal to absent money, so it needs a key value.
            *[X.text_or_empty(money(c)).alias(a) for c, a in
              (("quantidade", "q"), ("valor_unitario", "u"), ("valor_total", "t"))],
            X.text_or_empty("record_id").alias("rid"),
            X.text_or_empty("snapshot_id").alias("snap"),
            X.text_or_empty("methodology_version").alias("meth"),
        )
        .where(F.col("pncp").isNotNull() & F.col("item").isNotNull())
        .groupBy(*key, *who)
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    first = (
        copies.groupBy(*key)
        .agg(F.min(F.struct(*who)).alias("first"), F.sum("copies").alias("n"))
        .where(F.col("n") > 1)
    )
    extra = F.col("copies") - F.when(F.struct(*who) == F.col("first"), 1).otherwise(0)
    step = 100_000
    return (
        copies.join(first, key)
        .withColumn("extra", extra)
        .where(F.col("extra") > 0)
        # Two short sequences instead of one long one, whatever the number of copies.
        .withColumn("_k", F.explode(F.sequence(F.lit(0), F.expr(f"cast((extra - 1) div {step} as int)"))))
        .withColumn("_i", F.explode(F.sequence(
            F.lit(1), F.least(F.lit(step), F.col("extra") - F.col("_k") * step).cast("int"))))
        .select(
            F.col("rid").alias("record_id"),
            F.col("pncp").alias("pncp_id"),
            F.lit("duplicate_row").alias("reason"),
            _labelled("duplicate pncp+item+money. canonical_record_id=", F.col("first.rid"),
                      " pncp_id=", F.col("pncp"), " item=", F.col("item")).alias("detail"),
            F.col("snap").alias("snapshot_id"),
            F.col("meth").alias("methodology_version"),
        )
    )


def reference_prices(catalog: DataFrame, seq: str | None = None) -> DataFrame:
    """Reference price per catalog code: the last positive one by ``seq``.

    Columns are found by folded name.  Without ``seq`` the largest is taken.
    """
    have = {X.fold_name(c): c for c in catalog.columns}
    code = next((have[a] for a in ("codigo", "codigoitem", "codigoservico", "coditemcatalogo") if a in have), None)
    ref = next(
        (have[a] for a in ("valorreferencia", "precoreferencia", "valorreferenciacatalogo") if a in have), None
    )
    if code is None or ref is None:
        return catalog.sparkSession.createDataFrame([], "codigo string, preco decimal(18,6)")
    price = X.parse_decimal(F.col(f"`{ref}`").cast("string"))
    rows = catalog.select(
        F.trim(F.col(f"`{code}`").cast("string")).alias("codigo"),
        price.alias("preco"),
        (F.col(seq) if seq else price).alias("_seq"),
    ).where((F.col("codigo") != "") & (F.col("preco") > 0))
    return rows.groupBy("codigo").agg(F.max_by("preco", "_seq").alias("preco"))


REFERENCE_COLUMNS = ("valor_referencia", "preco_referencia", "valor_referencia_catalogo")


def catalog_magnitude(items: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Unit price more than 100 times above or below its reference price."""
    own = [F.when(money(c) > 0, money(c)) for c in REFERENCE_COLUMNS if c in items.columns]
    base = items.select(
        "record_id", "pncp_id", "snapshot_id", "methodology_version",
        money("valor_unitario").alias("price"),
        F.coalesce(*own, F.lit(None).cast(X.MONEY)).alias("own_ref"),
        X.blank_to_null(X.column(items, "catmat")).alias("catmat"),
        X.blank_to_null(X.column(items, "catser")).alias("catser"),
    ).where(F.col("price") > 0)
    if prices is None:
        found = base.withColumn("ref", F.col("own_ref"))
    else:
        by_material = prices.select(F.col("codigo").alias("catmat"), F.col("preco").alias("m_ref"))
        by_service = prices.select(F.col("codigo").alias("catser"), F.col("preco").alias("s_ref"))
        found = (
            base.join(by_material, "catmat", "left")
            .join(by_service, "catser", "left")
            .withColumn("ref", F.coalesce("own_ref", "m_ref", "s_ref"))
        )
    # price / ref outside [0.01, 100], written without a division.
    outside = (F.col("price") > F.col("ref") * HIGH_RATIO) | (F.col("price") * HIGH_RATIO < F.col("ref"))
    ratio = F.col("price").cast("double") / F.col("ref").cast("double")
    detail = _labelled(
        "unit_price vs catalog reference is >100x or <0.01x. price=", F.col("price"),
        " ref=", F.col("ref"), " ratio=", F.format_string("%.6f", ratio),
    )
    return found.where(F.col("ref").isNotNull() & outside).select(*_tag("catalog_magnitude", detail))


def detect_data_errors(items: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Every reason found, one row per (record, reason)."""
    parts = [
        qty_price_mismatch(items),
        decimal_shift(items),
        quantity_one_collapse(items),
        zero_or_negative(items),
        duplicate_rows(items),
        catalog_magnitude(items, prices),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(*COLUMNS)


def comparable_items(items: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Items without any exclusion."""
    banned = exclusions.where(F.coalesce(F.col("record_id"), F.lit("")) != "").select("record_id").distinct()
    return items.join(banned, "record_id", "left_anti")
