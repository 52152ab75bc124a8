"""Run registered queries on Spark and their SQL twins on DuckDB and compare.

``python tests/compare.py [--sf DIR] [name ...]``
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


SPARK_SECONDS: dict[str, float] = {}


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .appName("compare")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0 if v != 0 else 0.0
    if isinstance(v, dict):
        return tuple(sorted((k, normal(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        if hasattr(v, "asDict"):
            return normal(v.asDict())
        return tuple(normal(x) for x in v)
    if hasattr(v, "date") and hasattr(v, "hour"):
        return v.isoformat()
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    key = lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
    return [names[i] for i in order], sorted((tuple(normal(r[i]) for i in order) for r in records), key=key)


def compare(name, spark, con, sf_dir, query, sql):
    """None when equal, else a description of the first difference."""
    t = time.time()
    df = query(spark, sf_dir)
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    SPARK_SECONDS[name] = time.time() - t
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    want_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ ({got_names}): {bad[:2]}"
    return None


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as entry

    queries, sqls = entry.queries(), entry.oracle_sql()
    names = args.names or list(queries)
    spark, con = session(), duck(args.sf)
    failed = 0
    for name in names:
        t = time.time()
        try:
            problem = compare(name, spark, con, args.sf, queries[name], sqls.get(name))
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += problem is not None
        kind = "sql" if name in sqls else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} [{kind}] {SPARK_SECONDS.get(name, 0):.1f}s of {time.time() - t:.1f}s {(problem or '')[:1800]}", flush=True)
    print(f"{len(names) - failed}/{len(names)} ok")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
