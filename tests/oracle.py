"""Compare registered queries with their SQL twins in DuckDB.

As a script: python -m tests.oracle [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

import duckdb

import __spark_entry__ as contract

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(sf_dir, name)}.parquet'")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _rows(names, rows):
    by_name = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(row[i]) for i in by_name) for row in rows]
    return sorted(names), sorted(plain, key=repr)


def compare(spark, con, name: str, sf_dir: str) -> tuple[str, int]:
    """("ok" or what differs, number of rows)."""
    df = contract.queries()[name](spark, sf_dir)
    names, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return "no sql", len(got)
    result = con.execute(sql)
    sql_names, expected = _rows([d[0] for d in result.description], result.fetchall())
    if names != sql_names:
        return f"columns {names} != {sql_names}", len(got)
    if got != expected:
        extra = [r for r in got if r not in set(expected)][:3]
        lacking = [r for r in expected if r not in set(got)][:3]
        return f"{len(got)} rows != {len(expected)}; extra {extra}; lacking {lacking}", len(got)
    return "ok", len(got)


def main() -> None:
    from readloom.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(contract.queries())
    spark = build_session(master="local[8]", shuffle_partitions=8, **{"spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            verdict, n = compare(spark, con, name, sf_dir)
        except Exception as error:  # keep going, report at the end
            verdict, n = f"FAILED {type(error).__name__}: {str(error)[:600]}", -1
        bad += verdict not in ("ok", "no sql")
        print(f"{name:34} {n:8} rows {time.time() - start:6.1f}s  {verdict}", flush=True)
    print(f"{len(wanted)} queries, {bad} bad")


if __name__ == "__main__":
    main()
