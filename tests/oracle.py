"""Run catalogue queries on Spark and on DuckDB and compare the results."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, __file__.rsplit("/", 2)[0])

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, int):
        return float(v) if abs(v) < 2**53 else v
    if type(v).__name__ == "Decimal":
        return float(v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, sf_dir):
    """(problem or None, rows, Spark seconds, DuckDB seconds)"""
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    plan = df._jdf.queryExecution().executedPlan().toString()
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        if banned in plan:
            return f"plan has a {banned}", len(got), t1 - t0, 0.0
    if sql is None:
        return (None if got else "no rows"), len(got), t1 - t0, 0.0
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    problem = None
    if sorted(cols) != sorted(df.columns):
        problem = f"columns {sorted(df.columns)} != {sorted(cols)}"
    elif len(got) != len(want):
        problem = f"rows {len(got)} != {len(want)}"
    if problem is None or problem.startswith("rows"):
        a, b = rows_of(df.columns, got), rows_of(cols, want)
        if a != b:
            problem = f"{problem or 'values'}; {sum((a - b).values())} only in Spark {list((a - b))[:2]}; " \
                      f"{sum((b - a).values())} only in SQL {list((b - a))[:2]}"
    if problem is None and not got:
        problem = "no rows"
    return problem, len(got), t1 - t0, t2 - t1


def main() -> None:
    import __spark_entry__ as entry
    from conftest import session
    sf_dir = f"/root/testdata/{sys.argv[1]}"
    names = sys.argv[2:]
    spark, con = session(), connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        try:
            problem, n, s, d = compare(spark, con, fn, sqls.get(name), sf_dir)
        except Exception as exc:  # report and go on
            problem, n, s, d = f"{type(exc).__name__}: {str(exc)[:700]}", 0, 0, 0
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:28} rows={n:<8} spark={s:6.2f}s duckdb={d:6.2f}s "
              f"{'' if name in sqls else '(rows only)'} {problem or ''}"[:1500], flush=True)
    print(f"{bad} failed")


if __name__ == "__main__":
    main()
