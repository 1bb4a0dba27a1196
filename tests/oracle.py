"""Runs queries beside their SQL, as the driver does; python tests/oracle.py [sf_dir] [names]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def compare(spark, db, f, sql: str, sf_dir: str) -> str:
    """Empty if both give the same rows."""
    df = f(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    found = db.execute(sql)
    names = [c[0] for c in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {df.columns} and {names}"
    at = [names.index(c) for c in df.columns]
    want = [tuple(r[i] for i in at) for r in found.fetchall()]
    if len(got) != len(want):
        return f"{len(got)} rows, SQL has {len(want)}"
    a, b = (sorted((tuple(map(plain, r)) for r in rows), key=repr) for rows in (got, want))
    return next((f"{x} is {y} by SQL" for x, y in zip(a, b, strict=True) if x != y), "")


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from termloom.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, db, sqls = local_session(8), connect(sf_dir), oracle_sql()
    for name, f in queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        if len(sys.argv) <= 2 and (name.startswith("op") or name == "pipeline"):
            continue
        began = time.time()
        try:
            said = compare(spark, db, f, sqls[name], sf_dir) if name in sqls else f"no SQL, {f(spark, sf_dir).count()} rows"
        except Exception as e:  # noqa: BLE001
            said = "\n".join(str(e).splitlines()[:4])[:700]
        print(f"{name}: {said or 'same'} ({time.time() - began:.1f} s)", flush=True)
