"""Run registered queries beside their SQL and compare the rows."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from silverloop.plans.fixtures import TABLES  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def canonical(columns, rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([row[i] for i in order]) for row in rows)


def check(spark, con, name, query, sql, sf_dir) -> str | None:
    """None when rows, column names and values agree, else what differs."""
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    a, b = canonical(df.columns, got), canonical(columns, want)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    differing = [(x, y) for x, y in zip(a, b) if x != y]
    if differing:
        x, y = differing[0]
        at = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), 0)
        return f"{len(differing)} of {len(a)} rows differ, first at ...{x[max(0, at - 60):at + 120]}  AGAINST  ...{y[max(0, at - 60):at + 120]}"
    return None


if __name__ == "__main__":
    from silverloop import session
    from silverloop.plans.oracles import ORACLES
    from silverloop.plans.queries import QUERIES

    sf_dir = sys.argv[1]
    chosen = sys.argv[2:] or list(QUERIES)
    spark = session.build(**{"spark.ui.showConsoleProgress": "false"})
    con = connect(sf_dir)
    bad = 0
    for name in chosen:
        begin = time.time()
        try:
            if name in ORACLES:
                verdict = check(spark, con, name, QUERIES[name], ORACLES[name], sf_dir)
            else:
                verdict = None
                print(f"     {name}: {QUERIES[name](spark, sf_dir).count()} rows, no SQL")
        except Exception as failure:  # report and go on with the next query
            verdict = f"{type(failure).__name__}: {str(failure)[:600]}"
        bad += verdict is not None
        print(f"{'ok  ' if verdict is None else 'BAD '} {name} {time.time() - begin:.1f}s {verdict or ''}", flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} agree")
