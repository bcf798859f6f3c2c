"""Compare every registered query with its SQL: ``python -m tests.oracle SF_DIR [name-prefix ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x)) for k, x in v.items()))
    return v if isinstance(v, (int, str)) else str(v)


def compare(spark_df, con, sql: str) -> str | None:
    """None when rows are equal, else what differs."""
    rows = spark_df.collect()
    cols = sorted(spark_df.columns)
    got = Counter(tuple(_plain(r[c]) for c in cols) for r in rows)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} against {sorted(names)}"
    place = [names.index(c) for c in cols]
    want = Counter(tuple(_plain(r[i]) for i in place) for r in cur.fetchall())
    types = dict(zip(names, (str(d[1]) for d in cur.description)))
    for c, t in spark_df.dtypes:
        kind = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}.get(t)
        if kind and types[c] != kind:
            return f"type of {c}: {t} against {types[c]}"
    if got != want:
        missing, extra = want - got, got - want
        return (
            f"{len(rows)} rows against {sum(want.values())}; {cols}: "
            f"only SQL {list(missing)[:3]}; only Spark {list(extra)[:3]} ({sum(extra.values())})"
        )
    return None


def main() -> int:
    import __spark_entry__ as entry
    from riskloom.runtime import local_session

    sf_dir, prefixes = sys.argv[1], sys.argv[2:]
    spark = local_session(partitions=int(os.environ.get("CHECK_PARTITIONS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf_dir), 0
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name, run in queries.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        began = time.monotonic()
        try:
            df = run(spark, sf_dir)
            if name in oracles:
                problem = compare(df, con, oracles[name])
                state = "ok" if problem is None else "DIFF " + problem
            else:
                state = f"rows {len(df.collect())}"
        except Exception as e:  # shown, then on to the next query
            state = "FAIL " + str(e)[:600]
        bad += state.startswith(("DIFF", "FAIL"))
        print(f"{name:34s} {time.monotonic() - began:6.2f}s {state}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
