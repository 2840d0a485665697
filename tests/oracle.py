"""Runs registered queries against their SQL twins on the driver tables.

python -m tests.oracle [--sf 0.01] [name part ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
ROOT = os.environ.get("TESTDATA", "/root/testdata")


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9) + 0.0
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat() if hasattr(v, "tzinfo") else v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    return v


def key(row):
    return tuple((v is not None, str(type(v).__name__ not in ("int", "float")), str(v)) for v in row)


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    cols = sorted(spark_df.columns)
    rel = con.execute(sql)
    dcols = [c[0] for c in rel.description]
    if sorted(dcols) != cols:
        return f"columns {cols} vs {sorted(dcols)}"
    drows = [tuple(normal(r[dcols.index(c)]) for c in cols) for r in rel.fetchall()]
    srows = [tuple(normal(r[c]) for c in cols) for r in spark_df.collect()]
    if len(drows) != len(srows):
        return f"rows {len(srows)} vs {len(drows)}"
    for s, t in zip(sorted(srows, key=key), sorted(drows, key=key)):
        for a, b in zip(s, t):
            if type(a) is not type(b) or a != b:
                return f"{dict(zip(cols, s))} vs {dict(zip(cols, t))}"
    return None


def main(argv):
    sf = "0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    import __spark_entry__ as e
    from tests.conftest import make_session

    spark = make_session()
    sf_dir = f"{ROOT}/sf{sf}"
    con = connect(sf_dir)
    oracle = e.oracle_sql()
    bad = 0
    for name, fn in e.queries().items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracle:
                diff = compare(df, con, oracle[name])
                note = "ok" if diff is None else f"DIFF {diff}"
            else:
                note = f"rows {len(df.collect())}"
                diff = None
        except Exception as ex:  # noqa: BLE001
            diff = note = f"ERROR {type(ex).__name__}: {str(ex)[:1500]}"
        bad += diff is not None
        print(f"{time.time() - t:6.1f}s {name}: {note[:1600]}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
