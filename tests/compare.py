"""Compares queries with their SQL in DuckDB, as sorted rows."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys

import duckdb


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, decimal.Decimal):
        return float(f"{float(x):.9g}")
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(map(_value, x))
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def duck(folder: str):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(folder):
        p = os.path.join(folder, f)
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def differs(spark, folder: str, query, sql: str) -> str:
    """What differs, or an empty string."""
    df = query(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck(folder).execute(sql)
    columns = [x[0] for x in cur.description]
    want = rows_of(columns, cur.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    if list(map(repr, got)) != list(map(repr, want)):
        a, b = [r for r in got if r not in want][:2], [r for r in want if r not in got][:2]
        return f"{len(got)} rows against {len(want)}; only here {a}; only there {b}"
    return ""


if __name__ == "__main__":
    import time

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    folder = sys.argv[1]
    queries, sqls = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or list(queries):
        t = time.time()
        try:
            said = differs(spark, folder, queries[name], sqls[name]) if name in sqls else f"no SQL; {queries[name](spark, folder).count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{name:36} {time.time() - t:6.1f} s  {said or 'same'}", flush=True)
        spark.catalog.clearCache()
