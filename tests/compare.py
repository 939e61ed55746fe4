"""Run registered queries and their DuckDB restatement side by side.

    python tests/compare.py [query ...]   (DATA=/path/to/sf selects the tables)
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return f"{type(v).__name__}:{v}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql) -> list[str]:
    """What differs, as text; empty when everything agrees."""
    got = df.collect()
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(columns):
        return [f"columns {sorted(df.columns)} != {sorted(columns)}"]
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if a == b:
        return []
    only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
    return [f"{len(a)} rows against {len(b)}", f"spark only {only_a}", f"duckdb only {only_b}"]


def main():
    import __spark_entry__ as entry
    from docketlake.session import build_session

    folder = os.environ.get("DATA", "/root/testdata/sf0.01")
    spark = build_session(
        "compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
                                  "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(folder), entry.oracle_sql(), 0
    for name, make in entry.queries().items():
        if sys.argv[1:] and name not in sys.argv[1:]:
            continue
        start = time.time()
        try:
            problems = compare(make(spark, folder), con, sql[name])
        except Exception as e:  # report and go on with the next query
            problems = [str(e)[:1500]]
        bad += bool(problems)
        print("FAIL" if problems else "ok  ", name, round(time.time() - start, 1), *problems, sep="\n   "
              if problems else " ", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
