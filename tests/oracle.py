"""Spark's rows beside DuckDB's for the same query, as the contract asks: equal names, counts and values."""

import datetime
import decimal
import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = int(v) if v == int(v) else float(v)
    if isinstance(v, float):
        return 0.0 if v == 0 else "nan" if math.isnan(v) else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def compare(spark, name: str, run, sql: str, sf_dir: str, con) -> list[str]:
    df = run(spark, sf_dir)
    rel = con.sql(sql)
    a, b = sorted(df.columns), sorted(rel.columns)
    if a != b:
        return [f"columns {a} and {b}"]
    order = [df.columns.index(c) for c in a], [rel.columns.index(c) for c in a]
    mine = Counter(tuple(plain(r[k]) for k in order[0]) for r in df.collect())
    theirs = Counter(tuple(plain(r[k]) for k in order[1]) for r in rel.fetchall())
    kinds = {c: (t, str(rel.types[rel.columns.index(c)])) for c, t in df.dtypes}
    good = {("bigint", "BIGINT"), ("int", "INTEGER"), ("double", "DOUBLE"), ("string", "VARCHAR"), ("boolean", "BOOLEAN"), ("timestamp_ntz", "TIMESTAMP"), ("date", "DATE"), ("timestamp_ntz", "TIMESTAMP_NS")}
    wrong = [f"type of {c}: {t}" for c, t in kinds.items() if t not in good]
    if mine != theirs:
        wrong.append(f"{sum(mine.values())} and {sum(theirs.values())} rows; only Spark {list((mine - theirs).items())[:3]}; only SQL {list((theirs - mine).items())[:3]}")
    return wrong


if __name__ == "__main__":
    import sys
    import time

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from palimpsest.runtime import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = local_session(cores=os.environ.get("CORES", "2")), duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    for n in sys.argv[1:] or oracles:
        t = time.time()
        try:
            if n in oracles:
                wrong = compare(spark, n, queries[n], oracles[n], sf_dir, con)
                rows = ""
            else:
                wrong, rows = [], queries[n](spark, sf_dir).count()
        except Exception as e:  # noqa: BLE001
            wrong = [f"{type(e).__name__}: {str(e)[:300]}"]
        print("ok " if not wrong else "BAD", n, f"{time.time() - t:.1f}s", rows, *wrong, flush=True)
