"""Runs registered queries beside their SQL and compares names, types, values."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
_KIND = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def rows_of(columns, types, rows):
    at = [columns.index(c) for c in sorted(columns)]
    plain = lambda v: tuple(v) if isinstance(v, list) else v
    return sorted(columns), [types[i] for i in at], sorted(
        (tuple(plain(r[i]) for i in at) for r in rows), key=repr
    )


def differs(df, con, sql: str) -> str | None:
    """None when both sides agree, else the first difference."""
    ours = rows_of(df.columns, [_KIND.get(t, t) for _, t in df.dtypes], [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    theirs = rows_of(rel.columns, [str(t) for t in rel.types], rel.fetchall())
    for what, a, b in zip(("columns", "types"), ours, theirs):
        if a != b:
            return f"{what}: {a} / {b}"
    if len(ours[2]) != len(theirs[2]):
        return f"rows: {len(ours[2])} / {len(theirs[2])}"
    for a, b in zip(ours[2], theirs[2]):
        if a != b:
            bad = [(c, str(x)[:300], str(y)[:300]) for c, x, y in zip(ours[0], a, b) if x != y]
            return f"values: {bad}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from conftest import local_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), connect(folder)
    sql = entry.oracle_sql()
    failed = []
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            wrong = differs(run(spark, folder), con, sql[name]) if name in sql else f"no sql, {run(spark, folder).count()} rows"
        except Exception as e:  # noqa: BLE001
            wrong = f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{name:28s} {time.time() - start:6.2f}s {wrong or 'ok'}", flush=True)
        if wrong:
            failed.append(name)
    print(f"{len(failed)} differ: {failed}")
