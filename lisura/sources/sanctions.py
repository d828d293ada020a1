"""Two sanction registers in one frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lisura.functions import text as X
from lisura.operators.privacy import mask_frame
from lisura.sources.delimited import blank_rows_removed, require_columns

# Accepted spellings of the required columns.
NEEDED = {
    "cadastro": {"cadastro", "fonte"},
    "cpfoucnpjdosancionado": {"cpfoucnpjdosancionado", "cpfcnpj", "cnpj", "cpfoucnpj"},
    "codigodasancao": {"codigodasancao", "id"},
    "datainiciosancao": {"datainiciosancao", "datainicio"},
    "datafinalsancao": {"datafinalsancao", "datafimsancao", "datafim", "datafimdoefeito", "fimvigencia"},
}
REGISTERS = ("CEIS", "CNEP")


def tag_register(df: DataFrame, register: str) -> DataFrame:
    """Fill the register column where it is blank; add it where it is missing."""
    require_columns(df, NEEDED, X.fold_name)
    name = next((c for c in df.columns if X.fold_name(c) == "cadastro"), None)
    if name is None:
        return df.withColumn("CADASTRO", F.lit(register))
    blank = F.trim(X.text_or_empty(F.col(f"`{name}`"))) == ""
    return df.withColumn(name, F.when(blank, F.lit(register)).otherwise(F.col(f"`{name}`")))


def sanction_rows(ceis: DataFrame, cnep: DataFrame) -> DataFrame:
    parts = [tag_register(blank_rows_removed(df), r) for df, r in zip((ceis, cnep), REGISTERS, strict=True)]
    return mask_frame(parts[0].unionByName(parts[1], allowMissingColumns=True))


def missing_registers(rows: DataFrame) -> DataFrame:
    """Registers without any row; a landing must have none."""
    name = next(c for c in rows.columns if X.fold_name(c) == "cadastro")
    have = rows.select(F.upper(X.fold(F.col(f"`{name}`"))).alias("register")).distinct()
    want = rows.sparkSession.createDataFrame([(r,) for r in REGISTERS], "register string")
    return want.join(have, "register", "left_anti")
