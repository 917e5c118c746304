"""Run a registered query on Spark and its SQL on DuckDB and compare whole results."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    return str(v)


def _rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in data), [names[i] for i in order]


def compare(df, con, sql):
    """Return (ok, message)."""
    spark_rows, spark_cols = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    sql_rows, sql_cols = _rows([d[0] for d in cur.description], cur.fetchall())
    if spark_cols != sql_cols:
        return False, f"columns {spark_cols} != {sql_cols}"
    if len(spark_rows) != len(sql_rows):
        return False, f"rows {len(spark_rows)} != {len(sql_rows)}"
    if not spark_rows:
        return False, "empty result proves nothing"
    bad = [(a, b) for a, b in zip(spark_rows, sql_rows) if a != b]
    if bad:
        return False, f"{len(bad)} differing rows of {len(spark_rows)}, first {bad[:3]} cols {spark_cols}"
    return True, f"{len(spark_rows)} rows"
