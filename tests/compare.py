"""Runs named queries beside their SQL and compares the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

NAMES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
         "conversations").split()


def cell(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return f"b:{value}"
    if isinstance(value, (int,)):
        return f"i:{value}"
    if isinstance(value, decimal.Decimal):
        return f"d:{value}"
    if isinstance(value, float):
        return "f:nan" if math.isnan(value) else f"f:{value + 0.0:.9g}"
    if isinstance(value, dt.datetime):
        return f"t:{value.replace(tzinfo=None).isoformat()}"
    if isinstance(value, (bytes, bytearray)):
        return f"x:{bytes(value).hex()}"
    return f"{type(value).__name__}:{value}"


def spark_rows(df):
    order = sorted(df.columns)
    return order, sorted(tuple(cell(v) for v in row) for row in df.select(*[f"`{c}`" for c in order]).collect())


def duck_rows(folder, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    got = con.execute(sql)
    columns = [d[0] for d in got.description]
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    return order, sorted(tuple(cell(row[i]) for i in at) for row in got.fetchall())


def difference(query, sql, spark, folder):
    """None when the rows agree, else a short account of how they do not."""
    left_names, left = spark_rows(query(spark, folder))
    if sql is None:
        return None if left else "no rows"
    right_names, right = duck_rows(folder, sql)
    if left_names != right_names:
        return f"columns {left_names} against {right_names}"
    if left == right:
        return None
    extra = [r for r in left if r not in set(right)][:3]
    missing = [r for r in right if r not in set(left)][:3]
    return f"{len(left)} rows against {len(right)}; only Spark: {str(extra)[:600]}; only SQL: {str(missing)[:600]}"


def main(wanted, folder):
    import __spark_entry__ as entry
    from tallyloom.session import get_session

    if os.environ.get("PLAIN_SESSION"):
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[8]").getOrCreate()
    else:
        spark = get_session("compare", "local[8]", 8, **{"spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    sqls = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            problem = difference(query, sqls.get(name), spark, folder)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        mark = "ok " if problem is None else "BAD"
        print(f"{mark} {name} {time.time() - start:.1f}s{'' if name in sqls else ' (rows only)'} {problem or ''}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main(sys.argv[2:], sys.argv[1])
