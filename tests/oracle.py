"""Compare registered queries with their DuckDB statements on the same files.

Run as ``python tests/oracle.py sf0.01 [query ...]``.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, float):
        return repr(round(value, 9))
    return "\0" if value is None else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, sf_dir):
    """None when equal, else a short description of the first difference."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    want = rows_of(columns, rel.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}"
    if got != want:
        only_got = [r for r in got if r not in set(want)]
        only_want = [r for r in want if r not in set(got)]
        return f"rows {len(got)} / {len(want)}; differ {len(only_got)} / {len(only_want)}\n  spark {[str(r)[:700] for r in only_got[:1]]}\n  duck  {[str(r)[:700] for r in only_want[:1]]}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry
    from pagequarry.session import local_session

    folder = f"/root/testdata/{sys.argv[1]}"
    session = local_session("oracle")
    session.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles = entry.oracle_sql()
    for key, fn in entry.queries().items():
        if sys.argv[2:] and key not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            found = compare(session, con, key, fn, oracles[key], folder) if key in oracles else "no oracle"
        except Exception as exc:  # report and go on with the next query
            found = f"failed: {str(exc)[:500]}"
        print(f"{'ok  ' if found is None else 'DIFF'} {key} {time.time() - start:.1f}s {found or ''}", flush=True)
