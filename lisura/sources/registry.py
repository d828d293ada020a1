"""National company registry: positional files and the reduction to known companies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lisura.functions import text as X
from lisura.operators.privacy import mask_frame
from lisura.sources.delimited import read_positional

# Column order of the headerless files.
LAYOUTS = {
    "empresas": (
        "cnpj_basico razao_social natureza_juridica qualificacao_responsavel capital_social porte ente_federativo"
    ).split(),
    "estabelecimentos": (
        "cnpj_basico cnpj_ordem cnpj_dv identificador_matriz_filial nome_fantasia situacao_cadastral "
        "data_situacao_cadastral motivo_situacao_cadastral nome_cidade_exterior pais data_inicio_atividade "
        "cnae_fiscal_principal cnae_fiscal_secundaria tipo_logradouro logradouro numero complemento bairro cep uf "
        "municipio ddd1 telefone1 ddd2 telefone2 ddd_fax fax correio_eletronico situacao_especial "
        "data_situacao_especial"
    ).split(),
    "socios": (
        "cnpj_basico identificador_de_socio nome_socio cnpj_cpf_do_socio qualificacao_do_socio "
        "data_entrada_sociedade pais representante_legal nome_representante qualificacao_representante faixa_etaria"
    ).split(),
    "cnaes": ["codigo", "descricao"],
    "qualificacoes": ["codigo", "descricao"],
}


def read_registry(spark: SparkSession, kind: str, path: str | list[str], encoding: str = "ISO-8859-1") -> DataFrame:
    return read_positional(spark, path, LAYOUTS[kind], encoding=encoding)


def company_roots(df: DataFrame) -> DataFrame:
    """Distinct 8-character roots in every company-id column of a frame.

    Columns are those with ``cnpj`` in the name plus two supplier columns;
    11-digit values are person ids and are left out.
    """
    names = [c for c in df.columns if "cnpj" in c.lower() or c.lower() in ("codfornecedor", "nifornecedor")]
    if not names:
        return df.sparkSession.createDataFrame([], "root string")
    tokens = F.explode(F.array(*[X.alnum(F.col(f"`{c}`").cast("string")) for c in names]))
    rows = df.select(tokens.alias("t")).where((F.length("t") >= 8) & ~F.col("t").rlike("^[0-9]{11}$"))
    return rows.select(F.substring("t", 1, 8).alias("root")).distinct()


def only_known(df: DataFrame, roots: DataFrame) -> DataFrame:
    """Registry rows of the given company roots."""
    keyed = df.withColumn("root", F.substring(X.alnum("cnpj_basico"), 1, 8))
    return keyed.join(roots.select("root"), "root", "left_semi").drop("root")


def establishments_with_company(establishments: DataFrame, companies: DataFrame) -> DataFrame:
    """Establishments LEFT companies on the root, with the full 14-character id."""
    full = F.concat("cnpj_basico", F.lpad("cnpj_ordem", 4, "0"), F.lpad("cnpj_dv", 2, "0"))
    return establishments.withColumn("cnpj", full).join(companies, "cnpj_basico", "left")


def registry_tables(
    companies: DataFrame, establishments: DataFrame, partners: DataFrame, roots: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(establishments with company data, partners), reduced to ``roots`` and masked."""
    if roots is not None:
        companies, establishments, partners = (only_known(df, roots) for df in (companies, establishments, partners))
    return mask_frame(establishments_with_company(establishments, companies)), mask_frame(partners)
