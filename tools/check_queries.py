"""Run catalogue queries beside their SQL and compare: columns, row count, sorted values.

Usage: python tools/check_queries.py [folder] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

from voxtable.plans.catalogue import QUERIES, SQL  # noqa: E402
from voxtable.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, dict):
        return str(sorted((k, plain(x)) for k, x in v.items()))
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda t: tuple(str(x) for x in t))


def kind(name: str) -> str:
    name = name.lower()
    for group, words in (("int", ("int", "long")), ("float", ("double", "float", "decimal")), ("text", ("string", "varchar"))):
        if any(w in name for w in words):
            return f"{group}:{name}"
    return name


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = 0
    for name, fn in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t0 = time.time()
        try:
            df = fn(spark, folder)
            got = df.collect()
            took = time.time() - t0
            if name not in SQL:
                print(f"ROWS  {name} {len(got)} rows {took:.2f}s", flush=True)
                continue
            t1 = time.time()
            cur = con.execute(SQL[name])
            names, types = [c[0] for c in cur.description], {c[0]: str(c[1]) for c in cur.description}
            want = cur.fetchall()
            sql_took = time.time() - t1
            if sorted(df.columns) != sorted(names):
                print(f"FAIL  {name}: columns {sorted(df.columns)} / {sorted(names)}", flush=True)
                bad += 1
                continue
            a, b = rows_of(df.columns, got), rows_of(names, want)
            odd = [f"{c}:{t}/{types[c]}" for c, t in df.dtypes
                   if {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}.get(t, t) != types[c]]
            if a == b and got:
                print(f"ok    {name} {len(got)} rows {took:.2f}s (sql {sql_took:.2f}s){' TYPES ' + ' '.join(odd) if odd else ''}", flush=True)
            else:
                bad += 1
                print(f"FAIL  {name}: {len(a)} / {len(b)} rows, {took:.2f}s", flush=True)
                for x, y in [(x, y) for x, y in zip(a, b) if x != y][:3]:
                    print(f"   spark {str(x)[:300]}\n   sql   {str(y)[:300]}")
        except Exception as e:  # report and go on with the next query
            bad += 1
            print(f"ERROR {name}: {type(e).__name__} {str(e)[:600]}", flush=True)
    print(f"{bad} problem(s)")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
