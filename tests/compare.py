"""Run a query and its SQL side by side."""

from __future__ import annotations

import hashlib
import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    """One spelling for what two engines return."""
    if value is None:
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if isinstance(value, (bytes, bytearray)):
        return hashlib.sha1(bytes(value)).hexdigest()
    return value if isinstance(value, (bool, int, str)) else float(value) if "Decimal" in type(value).__name__ else str(value)


def spark_rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(plain(x) for x in r) for r in frame.select(*(f"`{c}`" for c in columns)).collect()), key=repr)


def duck_rows(sql: str, sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    rel = con.sql(sql)
    names = list(rel.columns)
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=repr)
