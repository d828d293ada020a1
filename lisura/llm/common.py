"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Space and the control characters 9 to 13: everything else is part of a word.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the session names.

    Without ``spark.checkpoint.dir`` a local session takes a scratch folder;
    a cluster gets an error, since its machines share no such folder.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="run-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def fold(key: Column, parts: int) -> Column:
    """crc32 of the key written as text, modulo ``parts``; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Lower-cased (A-Z only) runs of non-blank characters; null and blank text have none."""
    clean = F.btrim(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(BLANKS))
    none = F.array().cast("array<string>")
    return F.when(clean == "", none).otherwise(F.split(clean, "[\\x20\\x09-\\x0D]+"))


def word_list(text: bytes | None) -> list[bytes]:
    """The same words in Python: ``bytes`` methods fold and split ASCII only."""
    return text.lower().split() if text else []


def share(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A broadcast hint for a checkpointed frame of at most ``rows`` narrow rows; else the frame, to be shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def add_from_text(df: DataFrame, keep: list[str], make: Callable[[], Callable], name: str, kind: T.DataType) -> DataFrame:
    """``keep`` of every row and a column made from ``text`` by a function that each task makes for itself.

    Other columns pass through as Arrow data, unread: any type and any name.
    """
    rows = df.select(*keep, F.col("text").cast("string").cast("binary"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(name, kind)])
    wanted = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_text = make()
        for b in batches:
            made = pa.array([of_text(t) for t in b.column(b.num_columns - 1).to_pylist()], wanted)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], made], names=schema.names)

    bound_batches(df)
    return rows.mapInArrow(run, schema)


#: Texts that a Python worker gets at once: long ones fit into its memory too.
BATCH_ROWS = "1000"


def bound_batches(df: DataFrame) -> None:
    """Python workers of this session get ``BATCH_ROWS`` rows at a time, or fewer where that is set."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= int(BATCH_ROWS):
        conf.set(name, BATCH_ROWS)


def text_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """Pandas frames through ``run``, a thousand rows at a time (a setting of the session, left lower if it is).

    Whole numbers keep all their digits, absent ones among them or not: the
    frames have nullable types, where plain pandas would turn to floats.
    """
    bound_batches(df)
    wanted = to_arrow_schema(T.StructType.fromDDL(schema))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}
        for out in run(b.to_pandas(types_mapper=exact.get) for b in batches):
            yield pa.RecordBatch.from_pandas(out, schema=wanted, preserve_index=False)

    return df.mapInArrow(whole, schema)
