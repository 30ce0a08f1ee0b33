"""Runs registered queries next to their SQL and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def _canonical(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((v is None, str(type(v).__name__), v if v is not None else 0) for v in t))


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE",
                 "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def compare(spark, con, name, fn, sql, sf_dir) -> str | None:
    """None if both sides agree, otherwise what differs."""
    df = fn(spark, sf_dir)
    rows = df.collect()
    if sql is None:
        return None if rows else "no rows"
    rel = con.sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    kinds = {c: SPARK_TO_DUCK.get(t, t) for c, t in df.dtypes}
    other = dict(zip(rel.columns, [str(t) for t in rel.types]))
    if kinds != other:
        return f"types {[(c, kinds[c], other[c]) for c in kinds if kinds[c] != other[c]]}"
    left, right = _canonical(df.columns, rows), _canonical(rel.columns, rel.fetchall())
    if left != right:
        only_left = [r for r in left if r not in set(right)][:3] if len(left) < 200000 else "?"
        only_right = [r for r in right if r not in set(left)][:3] if len(left) < 200000 else "?"
        return f"{len(left)} vs {len(right)} rows; only Spark {only_left}; only SQL {only_right}"
    return None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from schedlake.session import local_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(sf_dir), oracle_sql(), 0
    for name, fn in queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        begin = time.time()
        try:
            problem = compare(spark, con, name, fn, sql.get(name), sf_dir)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        print(f"{name:36s} {time.time() - begin:6.2f}s {'ok' if problem is None else 'FAIL ' + problem}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
