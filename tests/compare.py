"""Run registered queries beside their SQL, as the driver does.

python tests/compare.py [--sf DIR] [NAME ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if hasattr(v, "asDict"):
        return tuple(sorted((k, normal(x)) for k, x in v.asDict().items()))
    if isinstance(v, dict):
        return tuple(sorted((str(k), normal(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    return v


def same(spark, sf_dir: str, query, sql: str | None) -> tuple[bool, str]:
    """Whether query and SQL agree on rows, columns and values."""
    began = time.time()
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    rows = [tuple(normal(r[c]) for c in cols) for r in df.collect()]
    took = time.time() - began
    if sql is None:
        return True, f"{len(rows)} rows, no SQL, {took:.1f} s"
    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{sf_dir}/{t}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = cur.fetchall()
    if sorted(names) != cols:
        return False, f"columns {cols} and {sorted(names)}"
    at = [names.index(c) for c in cols]
    theirs = [tuple(normal(r[i]) for i in at) for r in theirs]
    a, b = sorted(map(repr, rows)), sorted(map(repr, theirs))
    if a != b:
        odd = [(x, y) for x, y in zip(a, b) if x != y][:2]
        return False, f"{len(a)} and {len(b)} rows; {odd}"
    return True, f"{len(a)} rows, {took:.1f} s"


def main(args: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf_dir = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf_dir, args = args[1], args[2:]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    sqls = e.oracle_sql()
    for name, query in e.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        try:
            ok, said = same(spark, sf_dir, query, sqls.get(name))
        except Exception as x:  # noqa: BLE001
            ok, said = False, f"{type(x).__name__}: {str(x)[:1500]}"
        bad += not ok
        print("ok  " if ok else "BAD ", name, said, flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
