"""Purchase header and line files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lisura.functions import fixed
from lisura.functions import text as X
from lisura.functions.identity import with_record_identity
from lisura.operators.privacy import mask_frame

IBGE_NAMES = ("unidadeorgaocodigoibge", "codibgeunidadecompradora", "municipioibge", "ibge")
SPHERE_NAMES = ("orgaoentidadeesferaid", "esferacompradora", "esfera")
POWER_NAMES = ("orgaoentidadepoderid", "podercomprador", "poder")
YEAR_NAMES = ("anocomprapncp", "anocompra", "ano")


def fold_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[X.fold_name(c) for c in df.columns])


def join_lines(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines LEFT headers on the purchase id; clashing header columns get a prefix."""
    heads, rows = fold_headers(headers), fold_headers(lines)
    if "idcompra" not in heads.columns or "idcompra" not in rows.columns:
        raise ValueError("both files need idCompra")
    clash = set(heads.columns) & set(rows.columns) - {"idcompra"}
    heads = heads.withColumnsRenamed({c: f"compra_{c}" for c in clash})
    return rows.join(heads, "idcompra", "left").withColumn("source", F.lit("federal_purchases"))


def ibge_token(c: Column) -> Column:
    """Municipality code as digits; float-like text ("3306305.0") is accepted."""
    raw = F.trim(X.text_or_empty(c))
    d = X.digits(raw)
    whole = F.floor(raw.try_cast("double")).cast("long")
    return (
        F.when(F.lower(raw).isin(X.NO_NUMBER) | (d == ""), F.lit(None).cast("string"))
        .when(F.contains(raw, F.lit(".")) & whole.isNotNull(), F.when(whole > 0, whole.cast("string")))
        .otherwise(d)
    )


def is_municipal(sphere: Column, power: Column) -> Column:
    plain = F.replace(X.fold(sphere), F.lit(" "), F.lit(""))
    branch = F.replace(X.fold(power), F.lit(" "), F.lit(""))
    return plain.isin(*fixed.MUNICIPAL) & ~branch.isin(*fixed.LEGISLATIVE)


def slice_rows(df: DataFrame, cities: DataFrame | None = None) -> DataFrame:
    """Rows of covered municipalities, municipal sphere, not legislative.

    Without a municipality column nothing is filtered.  The city list is a
    fixed table unless another is given; Spark sends it around if it is small.
    """
    have = {X.fold_name(c): c for c in df.columns}

    def first(names: tuple[str, ...]) -> Column | None:
        return next((F.col(f"`{have[n]}`") for n in names if n in have), None)

    code = first(IBGE_NAMES)
    if code is None:
        return df
    sphere, power = first(SPHERE_NAMES), first(POWER_NAMES)
    kept = df.where(is_municipal(F.lit("M") if sphere is None else sphere, F.lit("") if power is None else power))
    cities = cities if cities is not None else fixed.municipalities(df.sparkSession)
    listed = cities.select(F.col("municipio_ibge").alias("_ibge"))
    return kept.withColumn("_ibge", ibge_token(code)).join(listed, "_ibge", "left_semi").drop("_ibge")


def lines_of(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines whose purchase survived the header filter."""
    ids = fold_headers(headers).select("idcompra").where(X.text_or_empty("idcompra") != "").distinct()
    return fold_headers(lines).join(ids, "idcompra", "left_semi")


def year_of(df: DataFrame) -> Column:
    """First four characters of the year column; null if there is none."""
    name = next((n for n in YEAR_NAMES if n in df.columns), None)
    return F.substring(F.col(name), 1, 4) if name else F.lit(None).cast("string")


def by_year(df: DataFrame, years: tuple[int, ...] = fixed.PURCHASE_YEARS) -> DataFrame:
    """Rows of the configured years with a ``year`` column to partition by."""
    return df.withColumn("year", year_of(df).try_cast("int")).where(F.col("year").isin(*years))


def purchase_rows(headers: DataFrame, lines: DataFrame, years: tuple[int, ...] = fixed.PURCHASE_YEARS) -> DataFrame:
    """Masked, sliced, joined and identified rows, ready to land by year.

    The slice is taken on headers first, so the big line file is reduced by a
    semi join before anything wide is built.
    """
    heads = slice_rows(fold_headers(mask_frame(headers)))
    rows = join_lines(heads, mask_frame(lines_of(heads, lines)))
    return by_year(with_record_identity(rows), years)


def trailing_window(df: DataFrame, day: str, as_of: Column, days: int = 90) -> DataFrame:
    """Rows whose ``day`` is in ``[as_of - days, as_of]``."""
    return df.where(F.col(day).between(F.date_sub(as_of, days), as_of))


def trailing_months(spark, as_of: str, days: int = 90) -> DataFrame:
    """(first, last) day of each month window in the trailing range."""
    one = spark.range(1).select(F.to_date(F.lit(as_of)).alias("end"))
    windows = X.month_windows(F.date_sub("end", days), F.col("end"))
    return one.select(F.explode(windows).alias("w")).select("w.*")
