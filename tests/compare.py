"""Compare every registered query with its SQL twin: python tests/compare.py [sf] [names]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(value):
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float)):
        value = float(value)
        return None if math.isnan(value) else value
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, fn, sql):
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    problems = []
    if sorted(df.columns) != sorted(names):
        problems.append(f"columns {sorted(df.columns)} != {sorted(names)}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        missing = [r for r in want if r not in set(got)][:2]
        problems.append(f"values: only spark {extra}; only duckdb {missing}")
    return len(got), problems


if __name__ == "__main__":
    import __spark_entry__ as entry
    from billwright.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    only = sys.argv[2:]
    spark = build_session(
        "local[8]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con, sqls = connect(sf_dir), entry.oracle_sql()
    for name, fn in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            n, problems = compare(spark, con, sf_dir, fn, sqls[name])
        except Exception as e:  # report and go on with the next query
            n, problems = -1, [f"{type(e).__name__}: {str(e)[:600]}"]
        print("ok " if not problems else "BAD", name, n, f"{time.time() - start:.1f}s", *problems)
