"""Runs registered queries beside their SQL and compares the rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if hasattr(value, "isoformat"):
        return value.isoformat(" ")
    if isinstance(value, float) and math.isfinite(value):
        return f"{value:.9g}"
    return "" if value is None else f"{type(value).__name__}:{value}"


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return normal(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cursor = con.execute(sql)
    return normal([d[0] for d in cursor.description], cursor.fetchall())


def main(sf_dir: str, names: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry

    from gleaner.session import local_session

    spark, con, bad = local_session("8"), connect(sf_dir), 0
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        start = time.time()
        try:
            got = spark_rows(queries[name](spark, sf_dir))
        except Exception as error:
            bad += 1
            print(f"{name:32} ERROR {str(error)[:600]}", flush=True)
            continue
        seconds = time.time() - start
        if name not in oracles:
            print(f"{name:32} rows {len(got[1])} (no SQL) {seconds:.1f}s", flush=True)
            continue
        try:
            want = duck_rows(con, oracles[name])
        except Exception as error:
            bad += 1
            print(f"{name:32} SQL ERROR {str(error)[:600]}", flush=True)
            continue
        same = got == want
        bad += not same
        print(f"{name:32} {'ok' if same else 'DIFFERS'} {len(got[1])}/{len(want[1])} {seconds:.1f}s", flush=True)
        if not same:
            print("   columns", got[0], want[0])
            only = [r for r in got[1] if r not in set(want[1])][:2]
            missing = [r for r in want[1] if r not in set(got[1])][:2]
            print("   only spark", str(only)[:400], "\n   only sql", str(missing)[:400])
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
