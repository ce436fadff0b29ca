"""Runs registered queries in Spark and their SQL in DuckDB and compares whole results."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    """One comparable form for a value from either engine."""
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return 0.0 if v == 0 else v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def kinds(rows):
    out = []
    for col in zip(*rows):
        out.append(sorted({type(v).__name__ for v in col if v is not None and v != "NaN"}))
    return out


def compare(spark_df, con, sql) -> str | None:
    """None if both agree, else what differs."""
    names, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    onames, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if names != onames:
        return f"columns {names} vs {onames}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    if kinds(got) != kinds(want):
        return f"types {list(zip(names, kinds(got), kinds(want)))}"
    if got == want:
        return None
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} of {len(got)} rows differ ({names}), first {bad[0]}"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from plumbline.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = oracle_sql()
    failed = 0
    for name, fn in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                problem = compare(df, con, oracles[name])
            else:
                n = len(df.collect())
                problem = None if n else "no rows"
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        kind = "oracle" if name in oracles else "rows"
        if problem:
            failed += 1
            print(f"FAIL {name} [{kind}] {time.time() - start:.1f}s {problem}", flush=True)
        else:
            print(f"ok   {name} [{kind}] {time.time() - start:.1f}s", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(min(1, main()))
