"""Compares a query's rows with those of its SQL: columns by name, rows as a multiset, types by family."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return db


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.10g}")
    if isinstance(x, decimal.Decimal):
        return float(f"{float(x):.10g}")
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(df, sql: str, db) -> str:
    """Empty where both agree."""
    got, cursor = df.collect(), db.execute(sql)
    columns, types = [d[0] for d in cursor.description], [str(d[1]) for d in cursor.description]
    want = cursor.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    family = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    for name, kind in df.dtypes:
        other = types[columns.index(name)]
        if {family.get(kind, kind), other} & {"DOUBLE", "BOOLEAN", "VARCHAR"} and family.get(kind, kind) != other:
            return f"column {name}: {kind} and {other}"
        if "HUGEINT" in other or "DECIMAL" in other:
            return f"column {name}: {kind} and {other}"
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if a != b:
        only = lambda x, y: [r for r in x if r not in set(y)][:3]
        return f"{len(a)} and {len(b)} rows; only Spark: {only(a, b)}; only SQL: {only(b, a)}"
    return ""
