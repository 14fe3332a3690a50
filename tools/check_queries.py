"""Run registered queries and compare them with their SQL in DuckDB.

    python tools/check_queries.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rowmend import catalog  # noqa: E402
from rowmend.session import get_spark  # noqa: E402


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return value


def sorted_rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is not None, str(type(x)) if x is None else "", x if x is not None else 0) for x in r))


def compare(spark_names, spark_rows, sql_names, sql_rows) -> str:
    if sorted(spark_names) != sorted(sql_names):
        return f"COLUMNS {sorted(spark_names)} vs {sorted(sql_names)}"
    a, b = sorted_rows(spark_names, spark_rows), sorted_rows(sql_names, sql_rows)
    if len(a) != len(b):
        return f"ROWS {len(a)} vs {len(b)}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        return f"VALUES differ in {len(wrong)} of {len(a)} rows, e.g. {wrong[0]}"
    return "ok"


# Spark and DuckDB names of the same type.
SAME_TYPE = {"boolean": "BOOLEAN", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}


def type_differences(dtypes, description) -> list[str]:
    sql = {d[0]: str(d[1]) for d in description}
    return [f"{n}: {t} vs {sql[n]}" for n, t in dtypes if SAME_TYPE.get(t) != sql.get(n)]


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark, con = get_spark("8"), connect(args.sf)
    queries, oracles = catalog.queries(), catalog.oracle_sql()
    assert set(oracles) <= set(queries), set(oracles) - set(queries)
    bad = 0
    for name in args.names or queries:
        try:
            start = time.time()
            df = queries[name](spark, args.sf)
            rows = [tuple(r) for r in df.collect()]
            spent = time.time() - start
            verdict, sql_time = f"rows only: {len(rows)}", 0.0
            if name in oracles:
                start = time.time()
                cursor = con.execute(oracles[name])
                expected = cursor.fetchall()
                sql_time = time.time() - start
                verdict = f"{len(rows)} rows: " + compare(df.columns, rows, [d[0] for d in cursor.description], expected)
                other = type_differences(df.dtypes, cursor.description)
                verdict += f"  TYPES {other}" if other else ""
        except Exception as error:  # noqa: BLE001 - keep checking the others
            verdict, spent, sql_time = f"ERROR {type(error).__name__}: {str(error)[:700]}", time.time() - start, 0.0
        good = verdict.startswith("rows only") or verdict.endswith(": ok")
        bad += not good
        print(f"{'    ' if good else 'BAD '}{name:28s} spark {spent:6.2f}s sql {sql_time:5.2f}s  {verdict}", flush=True)
        spark.catalog.clearCache()
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
