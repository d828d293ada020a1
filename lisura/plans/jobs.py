"""Registry of checkable jobs: a Spark callable and, where SQL can say it, a DuckDB query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lisura import session
from lisura.plans.views import Views, for_duckdb

Job = Callable[[Views], DataFrame]
JOBS: dict[str, Job] = {}
ORACLES: dict[str, str] = {}


def job(name: str, sql: str | None = None) -> Callable[[Job], Job]:
    """Register a job; ``sql`` uses the shared view names in braces."""

    def register(fn: Job) -> Job:
        JOBS[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def plain(df: DataFrame) -> DataFrame:
    """Portable column types: doubles, bigints, text for dates and times."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(f.name))
    return df.select(*out)


def _runner(fn: Job) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        session.configure(spark)
        return plain(fn(Views(spark, folder)))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from lisura.plans import catalog  # noqa: F401  (fills the registry)

    return {name: _runner(fn) for name, fn in JOBS.items()}


def oracle_sql() -> dict[str, str]:
    from lisura.plans import catalog  # noqa: F401

    return {name: for_duckdb(sql) for name, sql in ORACLES.items()}
