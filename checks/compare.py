"""Run registered queries and their SQL side by side: ``python -m checks.compare [names...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if value is None or isinstance(value, (bool, str)):
        return repr(value)
    if isinstance(value, int):
        return repr(value)
    if hasattr(value, "as_tuple"):
        return repr(round(float(value), 9))
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, fn, sql):
    started = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    seconds = time.time() - started
    if sql is None:
        return None, f"rows only: {len(got)}", seconds
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    want = rows_of(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}", seconds
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        lacking = [r for r in want if r not in set(got)][:2]
        return False, f"{len(got)} rows != {len(want)} rows\n   spark: {extra}\n   sql:   {lacking}", seconds
    return True, f"{len(got)} rows", seconds


def main() -> int:
    from checks import oracle, queries
    from pyspark.sql import SparkSession

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = connect(sf_dir), oracle.oracle_sql(), 0
    wanted = sys.argv[1:]
    for name, fn in queries.queries().items():
        if wanted and name not in wanted:
            continue
        try:
            ok, note, seconds = compare(spark, con, sf_dir, fn, sqls.get(name))
        except Exception as error:  # one broken query must not hide the others
            ok, note, seconds = False, f"{type(error).__name__}: {str(error)[:900]}", 0.0
        failed += ok is False
        print(f"{'FAIL' if ok is False else 'ok':5}{name:36}{seconds:6.1f}s  {note}", flush=True)
    unknown = set(sqls) - set(queries.queries())
    if unknown:
        print("SQL without a query:", sorted(unknown))
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
