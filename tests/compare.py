"""Run registered queries beside their SQL in DuckDB.

    python tests/compare.py [sf_dir] [name-pattern ...]
"""

from __future__ import annotations

import datetime
import decimal
import os
import re
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

EXACT = bool(os.environ.get("COMPARE_EXACT"))  # compare doubles to the last bit
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
KINDS = {"tinyint": "int", "smallint": "int", "integer": "int", "int": "int", "bigint": "bigint", "long": "bigint",
         "varchar": "string", "string": "string", "double": "double", "boolean": "boolean",
         "timestamp": "timestamp", "timestamp_ntz": "timestamp", "date": "date"}


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return value if EXACT else round(value, 6) + 0.0
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, con, sf_dir, name, query, sql):
    """(problem or None, rows, seconds)"""
    start = time.time()
    frame = query(spark, sf_dir)
    rows = [tuple(r) for r in frame.collect()]
    seconds = time.time() - start
    if sql is None:
        return None, len(rows), seconds
    relation = con.sql(sql)
    wanted_rows = relation.fetchall()
    got_types = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in frame.schema}
    want_types = {n: KINDS.get(str(t).lower(), str(t).lower()) for n, t in zip(relation.columns, relation.types)}
    if got_types != want_types:
        return f"schema {got_types} <> {want_types}", len(rows), seconds
    got, want = table(frame.columns, rows), table(relation.columns, wanted_rows)
    if got != want:
        odd = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
        return f"{len(got)} rows <> {len(want)}; only in Spark {odd[0]}; only in SQL {odd[1]}", len(rows), seconds
    return None, len(rows), seconds


def main() -> int:
    import __spark_entry__ as entry
    from catalogspark.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    patterns = sys.argv[2:] or [""]
    spark = build_session("compare", "local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8",
                                                    "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = oracle(sf_dir), 0
    queries, sqls = entry.queries(), entry.oracle_sql()
    for name in queries:
        if not any(re.search(p, name) for p in patterns):
            continue
        try:
            problem, rows, seconds = compare(spark, con, sf_dir, name, queries[name], sqls.get(name))
        except Exception as error:  # report and go on with the next query
            problem, rows, seconds = f"{type(error).__name__}: {str(error)[:1500]}", -1, 0.0
        bad += problem is not None
        note = "" if name in sqls else " (no SQL)"
        print(f"{'FAIL' if problem else 'ok  '} {name:34s} {rows:7d} rows {seconds:6.2f}s{note} {problem or ''}", flush=True)
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    sys.exit(main())
