"""Landed API pages (contracts), item files and result files to flat item rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lisura.functions import text as X
from lisura.functions.identity import content_hash

_S = T.StringType()


def _struct(names: str) -> T.StructType:
    return T.StructType([T.StructField(n, _S) for n in names.split()])


CONTRACT = T.StructType([
    *_struct(
        "numeroControlePNCP modalidadeId modalidadeNome objetoCompra valorTotalHomologado dataPublicacaoPncp anoCompra "
        "sequencialCompra").fields,
    T.StructField("orgaoEntidade", _struct("cnpj razaoSocial esferaId poderId")),
    T.StructField("unidadeOrgao", _struct("ufSigla municipioNome codigoIbge")),
])
PAGE = T.StructType([T.StructField("data", T.ArrayType(CONTRACT))])
ITEM = _struct(
    "numeroItem descricao materialOuServico quantidade unidadeMedida valorUnitarioEstimado valorTotal "
    "catalogoCodigoItem temResultado")
RESULT = _struct(
    "sequencialResultado niFornecedor nomeRazaoSocialFornecedor tipoPessoa valorUnitarioHomologado quantidadeHomologada")


def read_pages(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Contracts of all pages, one row each."""
    pages = spark.read.schema(PAGE).json(path, multiLine=True)
    return pages.select(F.explode("data").alias("c")).select("c.*")


def _with_key(df: DataFrame, pattern: str, names: tuple[str, ...]) -> DataFrame:
    file = F.element_at(F.split("_file", "/"), -1)
    return df.withColumns({n: F.regexp_extract(file, pattern, i + 1) for i, n in enumerate(names)}).drop("_file")


def read_items(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Items of ``<cnpj>_<year>_<seq>.json`` files, keyed by contract."""
    raw = spark.read.schema(ITEM).json(path, multiLine=True).withColumn("_file", F.col("_metadata.file_path"))
    return _with_key(raw, "^(\\d+)_(\\d+)_(\\d+)\\.json$", ("k_cnpj", "k_ano", "k_seq"))


def read_results(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Results of ``<cnpj>_<year>_<seq>_<item>.json`` files, keyed by item."""
    raw = spark.read.schema(RESULT).json(path, multiLine=True).withColumn("_file", F.col("_metadata.file_path"))
    return _with_key(raw, "^(\\d+)_(\\d+)_(\\d+)_(\\d+)\\.json$", ("k_cnpj", "k_ano", "k_seq", "k_item"))


def contract_rows(contracts: DataFrame, items: DataFrame, results: DataFrame) -> DataFrame:
    """One row per contract x item x result; missing levels still give a row."""
    keyed = contracts.withColumns({
        "k_cnpj": X.digits("orgaoEntidade.cnpj"), "k_ano": F.col("anoCompra"), "k_seq": F.col("sequencialCompra")})
    key = ["k_cnpj", "k_ano", "k_seq"]
    with_items = keyed.join(items.withColumnRenamed("valorTotal", "_vt"), key, "left")
    # Results count only for items that say they have one.
    with_items = with_items.withColumn("k_item", F.when(F.lower("temResultado") == "true", F.col("numeroItem")))
    joined = with_items.join(results, [*key, "k_item"], "left")
    text = X.text_or_empty
    pncp = text("numeroControlePNCP")
    rows = joined.select(
        pncp.alias("numero_controle_pncp"), text("orgaoEntidade.cnpj").alias("orgao_cnpj"),
        text("orgaoEntidade.razaoSocial").alias("orgao_razao"), text("orgaoEntidade.esferaId").alias("esfera"),
        text("orgaoEntidade.poderId").alias("poder"), text("unidadeOrgao.ufSigla").alias("uf"),
        text("unidadeOrgao.municipioNome").alias("municipio_nome"), text("unidadeOrgao.codigoIbge").alias("municipio_ibge"),
        F.col("modalidadeId").alias("modalidade_id"), text("modalidadeNome").alias("modalidade_nome"),
        text("objetoCompra").alias("objeto"), F.col("valorTotalHomologado").alias("valor_total_homologado"),
        text("dataPublicacaoPncp").alias("data_publicacao_pncp"), F.col("anoCompra").alias("ano"),
        F.col("sequencialCompra").alias("sequencial"), F.col("numeroItem").alias("numero_item"),
        text("descricao").alias("descricao"), text("materialOuServico").alias("material_ou_servico"), "quantidade",
        text("unidadeMedida").alias("unidade_medida"), F.col("valorUnitarioEstimado").alias("valor_unitario_estimado"),
        F.col("_vt").alias("valor_total"), text("catalogoCodigoItem").alias("catalogo_codigo_item"),
        text("niFornecedor").alias("ni_fornecedor"), text("nomeRazaoSocialFornecedor").alias("nome_fornecedor"),
        text("tipoPessoa").alias("tipo_pessoa"), F.col("valorUnitarioHomologado").alias("valor_unitario_homologado"),
        F.col("quantidadeHomologada").alias("quantidade_homologada"), F.lit("pncp_consulta").alias("source"),
        F.concat_ws(":", pncp, F.coalesce("numeroItem", F.lit("0")), F.coalesce("sequencialResultado", F.lit("0"))).alias(
            "record_id"),
    )
    return rows.withColumn("record_hash", content_hash(rows, skip=("record_hash",)))
