"""Run registered queries next to their SQL on the same parquet tables and report differences.

    python tests/compare.py [--sf 0.01] [name prefix ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def canon(value):
    if value is None or value is pd.NaT:
        return "NULL"
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    if isinstance(value, (int, np.integer)):
        return str(int(value))
    if isinstance(value, (float, np.floating)):
        if np.isnan(value):
            return "NULL"
        return repr(float(value) + 0.0)
    if isinstance(value, (list, tuple, np.ndarray)):
        return "[" + ",".join(canon(v) for v in value) + "]"
    if isinstance(value, pd.Timestamp) or hasattr(value, "isoformat"):
        return pd.Timestamp(value).isoformat()
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    """Return (rows, seconds, problem or None)."""
    start = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return len(got), took, None
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    types = {d[0]: str(d[1]) for d in cursor.description}
    if sorted(df.columns) != sorted(columns):
        return len(got), took, f"columns {sorted(df.columns)} != {sorted(columns)}"
    odd = [c for c, t in types.items() if "HUGEINT" in t or "DECIMAL" in t]
    left, right = rows_of(df.columns, got), rows_of(columns, want)
    if left != right:
        a, b = sorted(set(left) - set(right)), sorted(set(right) - set(left))
        return len(got), took, f"{len(left)} vs {len(right)} rows; spark-only {len(a)} {a[:2]}; sql-only {len(b)} {b[:2]}"
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    mixed = [f"{c}:{kinds[c]}/{types[c]}" for c in columns if kinds[c] in pairs and pairs[kinds[c]] != types[c]]
    if odd or mixed:
        return len(got), took, f"types {odd} {mixed}"
    return len(got), took, None


def session(threads=8):
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{threads}]").appName("check")
             .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(args):
    import __spark_entry__ as entry
    sf = "0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = session(), connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if args and not any(name.startswith(a) for a in args):
            continue
        try:
            n, took, problem = compare(spark, con, name, fn, oracles.get(name), sf_dir)
        except Exception as error:  # report and go on with the next query
            n, took, problem = 0, 0.0, f"{type(error).__name__}: {str(error)[:600]}"
        kind = "sql" if name in oracles else "rows"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:40s} {kind:4s} rows={n:<7d} {took:6.2f}s {problem or ''}", flush=True)
    print("failures", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
