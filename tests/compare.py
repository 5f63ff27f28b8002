"""Run registered queries and their check SQL side by side and compare whole results.

    python tests/compare.py SF_DIR [query ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(r[i] for i in order) for r in rows), key=repr)


_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def difference(df, con, sql: str) -> str | None:
    """None when names, types and all rows agree, else what differs first."""
    rel = con.sql(sql)
    got_c, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    exp_c, exp = rows_of(rel.columns, rel.fetchall())
    if got_c != exp_c:
        return f"columns {got_c} != {exp_c}"
    types = dict(zip(rel.columns, map(str, rel.types)))
    odd = [(n, t, types[n]) for n, t in df.dtypes if _TYPES.get(t, types[n]) != types[n]]
    if len(got) != len(exp):
        return f"{len(got)} rows, expected {len(exp)}; types {odd}"
    bad = [(g, e) for g, e in zip(got, exp) if g != e]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first {got_c}:\n   got {bad[0][0]}\n   exp {bad[0][1]}; types {odd}"
    return f"types {odd}" if odd else None


def main(sf: str, names: list[str]) -> int:
    from tests.conftest import build_session
    import __spark_entry__ as entry
    spark, con = build_session(), connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf)
            if name in oracles:
                problem = difference(df, con, oracles[name])
                state = "ok" if problem is None else f"DIFF {problem}"
            else:
                state = f"rows {len(df.collect())}"
                problem = None
        except Exception as exc:  # report and go on with the next query
            problem = state = f"ERROR {type(exc).__name__}: {str(exc)[:700]}"
        failed += problem is not None
        print(f"{name:26s} {time.time() - start:6.1f}s {state}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
