"""Rows of a query and of its SQL in DuckDB, in a form that can be compared."""

import math
import os
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return c


def plain(x):
    if isinstance(x, Decimal):
        return float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, datetime):
        return x.replace(tzinfo=None).isoformat()
    return x.isoformat() if isinstance(x, date) else x


def of_spark(df):
    names = sorted(df.columns)
    return names, sorted(([plain(r[n]) for n in names] for r in df.collect()), key=repr)


def of_duckdb(connection, sql: str):
    found = connection.execute(sql)
    names = [x[0] for x in found.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(([plain(r[i]) for i in order] for r in found.fetchall()), key=repr)


#: Types that are the same to a reader of both engines.
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def types_that_differ(df, connection, sql: str) -> list[tuple]:
    theirs = {n: str(t) for n, t, *_ in connection.execute(f"DESCRIBE {sql}").fetchall()}
    return [(n, t, theirs.get(n)) for n, t in df.dtypes if theirs.get(n) != KINDS.get(t, t.upper())]
