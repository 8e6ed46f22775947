"""Runs queries at a small scale and compares them with their SQL in DuckDB: python tests/oracle.py [name ...]."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


def tables(sf_dir: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def normal(rows: list[tuple]) -> list[str]:
    def cell(v):
        if isinstance(v, float):
            return f"{v:.6f}".rstrip("0").rstrip(".")
        return str(v).lower() if isinstance(v, bool) else str(v)

    return sorted("\x1f".join(cell(v) for v in r) for r in rows)


def compare(spark, name: str, query, sql: str, sf_dir: str = SF) -> str | None:
    """None if equal, else what differs."""
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = normal([tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()])
    rel = tables(sf_dir).execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = normal([tuple(r[i] for i in order) for r in rel.fetchall()])
    if got == want:
        return None
    only = sorted(set(got) - set(want))[:2], sorted(set(want) - set(got))[:2]
    return f"{len(got)} rows and {len(want)}; only in the query {only[0]}; only in the SQL {only[1]}"


if __name__ == "__main__":
    from conftest import session

    import __spark_entry__ as entry

    spark, queries, sql = session(), entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not sys.argv[1:] or any(n.startswith(a) for a in sys.argv[1:])]
    for n in names:
        began = time.time()
        try:
            said = compare(spark, n, queries[n], sql[n]) if n in sql else f"rows only: {queries[n](spark, SF).count()}"
        except Exception as e:
            said = f"ERROR {str(e)[:600]}"
        print(f"{n}: {said or 'equal'} ({time.time() - began:.1f} s)", flush=True)
