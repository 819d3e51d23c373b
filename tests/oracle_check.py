"""Compare a query's rows with its SQL twin's, as sorted, normalised tuples."""

from __future__ import annotations

import datetime
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, datetime.datetime):
        return value.date()
    if isinstance(value, Decimal):
        return float(value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_plain(row[i]) for i in order) for row in rows), key=lambda t: tuple(map(repr, t))
    )


def differences(spark_df, con, sql: str) -> list[str]:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} vs {sorted(names)}"]
    ours = _rows(spark_df.columns, [tuple(x) for x in spark_df.collect()])
    theirs = _rows(names, result.fetchall())
    if len(ours) != len(theirs):
        return [f"{len(ours)} rows vs {len(theirs)}"]
    return [f"{a} vs {b}" for a, b in zip(ours, theirs) if a != b or repr(a) != repr(b)]
