"""All queries of the engine by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..session import settled

#: The folder whose tables' footers the SQL of metadata queries reads; ``oracles`` gives the same for another one.
FOLDER = "/root/testdata/sf0.01"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    """Registers a function of (spark, sf_dir) under its name, to run under the engine's settings."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            with settled(spark):
                df = f(spark, sf_dir)
                _ = df.schema  # resolved under these settings
                return df

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return run

    return add


def oracles(sf_dir: str) -> dict[str, str]:
    """The SQL of every query, for the tables in ``sf_dir``."""
    return {name: sql.replace(FOLDER, sf_dir) for name, sql in ORACLE_SQL.items()}


from . import queries as _queries  # noqa: E402, F401  (fills the registries)
