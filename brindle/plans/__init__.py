"""Registered queries: each a function of (spark, sf_dir), most with SQL that gives the same rows in DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.sources import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a function; oracle is the SQL for DuckDB, if SQL can say it."""

    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return register


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """Registers SQL in which {name} stands for a table; the oracle is the same text unless it must differ."""
    names = sorted(set(re.findall(r"\{(\w+)\}", text)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})

    run.__name__, run.__doc__ = name, text
    QUERIES[name] = run
    ORACLE_SQL[name] = re.sub(r"\{(\w+)\}", r"\1", oracle or text)
