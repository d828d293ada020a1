"""Deterministic ids and content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the id namespace, so ids equal those already published.
NAMESPACE = "6b1c0a7e-4d2f-4c91-9b3a-0f8e2d17a5c4"


def name_uuid(name: Column) -> Column:
    """Version-5 uuid text of ``name`` in the fixed namespace."""
    space = F.unhex(F.lit(NAMESPACE.replace("-", "")))

    def dashed(h: Column) -> Column:
        variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
        return F.concat(
            F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"),
            variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))

    # The one-element transform binds the digest, which is then computed once.
    return F.transform(F.array(F.sha1(F.concat(space, F.encode(name, "UTF-8")))), dashed)[0]


def entity_id(kind: str, *parts: Column) -> Column:
    """Id of ``kind:part:part...``; a null part counts as empty text."""
    safe = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return name_uuid(F.concat_ws(":", F.lit(kind), *safe))


def buyer_id(cnpj: Column) -> Column:
    return entity_id("orgao", cnpj)


def supplier_id(cnpj: Column) -> Column:
    return entity_id("fornecedor", cnpj)


def contract_id(pncp: Column) -> Column:
    return entity_id("contratacao", pncp)


def item_id(pncp: Column, record: Column) -> Column:
    return entity_id("item", pncp, record)


def flag_id(item: Column, kind: Column, snapshot: Column) -> Column:
    return entity_id("flag", item, kind, snapshot)


def partner_id(cnpj: Column, name: Column, masked: Column, role: Column) -> Column:
    return entity_id("socio", cnpj, name, masked, role)


def participant_id(tender: Column, lot: Column, token: Column, source: Column) -> Column:
    return entity_id("participante", source, tender, lot, token)


def screen_id(kind: Column, subject: Column, snapshot: Column) -> Column:
    return entity_id("cobid_screen", kind, subject, snapshot)


def content_hash(df: DataFrame, skip: tuple[str, ...] = ("record_hash", "record_id", "source")) -> Column:
    """sha256 of the row as JSON with keys in alphabetical order."""
    names = sorted(c for c in df.columns if c not in skip)
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false"}), 256)


def with_record_identity(df: DataFrame) -> DataFrame:
    """Add ``record_id`` (line id, else ``purchase:line no``) and ``record_hash``."""
    have = set(df.columns)
    line = F.col("idcompraitem") if "idcompraitem" in have else F.lit(None).cast("string")
    number = F.col("numeroitemcompra") if "numeroitemcompra" in have else F.lit(None).cast("string")
    header = F.col("idcompra") if "idcompra" in have else F.lit(None).cast("string")
    fallback = F.concat_ws(":", F.coalesce(header, F.lit("")), F.coalesce(number, F.lit("")))
    record = F.coalesce(F.nullif(F.trim(line), F.lit("")), fallback)
    return df.withColumn("record_hash", content_hash(df)).withColumn("record_id", record)


def fingerprint(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (n, h1, h2), or one per group: an order-free fingerprint of a whole table.

    Two independent 64-bit row hashes are summed as decimals, so the result is
    an ordinary partial aggregate and equal rows are counted, not cancelled.
    Columns of ``by`` are not part of the content.
    """
    cols = [F.col(f"`{c}`") for c in sorted(df.columns) if c not in by]
    wide = "decimal(38,0)"
    first = F.xxhash64(*cols)
    second = F.xxhash64(F.lit("salt"), *reversed(cols))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(first.cast(wide)), F.lit(0).cast(wide)).alias("h1"),
        F.coalesce(F.sum(second.cast(wide)), F.lit(0).cast(wide)).alias("h2"),
    )


def snapshot_id_of(n: Column, h1: Column, h2: Column) -> Column:
    return F.sha2(F.concat_ws("|", n.cast("string"), h1.cast("string"), h2.cast("string")), 256)
