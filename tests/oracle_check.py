"""Run registered queries next to their SQL: ``python -m tests.oracle_check [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in value) + "]"
    if value is None:
        return "~"
    if hasattr(value, "as_tuple"):
        return repr(float(value))
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([columns[i] for i in order]), sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    """``None`` when equal, else a description."""
    df = fn(spark, sf_dir)
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    right = rows_of([d[0] for d in cur.description], cur.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} vs {right[0]}"
    if len(left[1]) != len(right[1]):
        only_l = list(set(left[1]) - set(right[1]))[:2]
        only_r = list(set(right[1]) - set(left[1]))[:2]
        return f"rows {len(left[1])} vs {len(right[1])}: {left[0]} spark-only {only_l} sql-only {only_r}"
    bad = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
    if bad:
        only_l = sorted(set(left[1]) - set(right[1]))
        only_r = sorted(set(right[1]) - set(left[1]))
        return f"{len(only_l)} of {len(left[1])} rows differ: {left[0]}\n    spark {only_l[:3]}\n    sql   {only_r[:3]}"
    return None


def main() -> None:
    from tests.conftest import make_session
    from fleetscope.catalog.all_queries import ORACLES, QUERIES

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(QUERIES)
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = make_session(), duck(sf_dir)
    failed = []
    for name in names:
        start = time.time()
        try:
            if name in ORACLES:
                problem = compare(spark, con, name, QUERIES[name], ORACLES[name], sf_dir)
            else:
                problem = None
                print(f"     {name}: rows {QUERIES[name](spark, sf_dir).count()}")
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:900]}"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s{'' if problem is None else ' ' + problem}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(names) - len(failed)} of {len(names)} equal; failed: {failed}")


if __name__ == "__main__":
    main()
