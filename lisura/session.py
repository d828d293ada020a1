"""Session settings the jobs rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    # The JVM does not compile methods above 8,000 bytes; beyond that, smaller
    # per-operator methods are much faster than one interpreted big one.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # State on the executors' disks, not in their heaps; list state and timers need it.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int = 8, shuffle_partitions: int | None = None, name: str = "lisura") -> SparkSession:
    """Single-JVM session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all machines see.

    A local session without one takes a scratch folder; a cluster without one
    gets an error, as its machines share no other folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="run-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def new_folder(spark: SparkSession) -> str:
    """A name for a new folder below the shared one."""
    return f"{shared_folder(spark)}/{uuid.uuid4()}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: later steps read the result instead of recomputing it.  Runs a job."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """The rows as written to a folder, a new one below the shared one if none is given, in compressed columns.  Runs a job.

    Like ``cut_lineage`` for many or wide rows: a checkpoint takes several times
    the disk, and later steps read all of its columns.
    """
    folder = folder or new_folder(df.sparkSession)
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A broadcast hint for a checkpointed frame of at most ``rows`` narrow rows; else the frame, to be shuffled.

    Reads at most ``rows`` + 1 rows to find out.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
