"""Compares a query with its SQL on DuckDB: python tests/compare.py [sf_dir] [name...]."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        if glob.glob(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is None, str(type(v)), v if v is not None and v == v else 0) if not isinstance(v, list) else (False, "list", str(v)) for v in row)


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


def differences(frame, con, sql: str) -> list[str]:
    names = sorted(frame.columns)
    left = sorted(([tuple(plain(r[n]) for n in names) for r in frame.select(*[f"`{n}`" for n in names]).collect()]), key=_key)
    result = con.sql(sql)
    if sorted(result.columns) != names:
        return [f"columns {names} and {sorted(result.columns)}"]
    at = [result.columns.index(n) for n in names]
    right = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=_key)
    if len(left) != len(right):
        return [f"rows {len(left)} and {len(right)}"]
    return [f"{a} and {b}" for a, b in zip(left, right) if a != b][:3]


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master(f"local[{os.environ.get('COMPARE_CPUS', '8')}]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, sql = connection(folder), entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:] or not sys.argv[2:] and name not in sql:
            continue
        began = time.time()
        try:
            found = differences(query(spark, folder), con, sql[name]) if name in sql else [f"no SQL; {query(spark, folder).count()} rows"]
        except Exception as e:
            found = [f"{type(e).__name__}: {str(e)[:400]}"]
        bad += bool(found)
        print(f"{'BAD' if found else 'ok '} {name} {time.time() - began:.1f}s", *found, flush=True)
    print(f"{bad} differ")


if __name__ == "__main__":
    main()
