"""Registered queries beside their SQL on the smallest tables."""

import duckdb
import pytest

from voxtable.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def sql_rows(name, folder=FOLDER):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = con.execute(SQL[name])
    names = [c[0] for c in found.description]
    return names, found.fetchall()


def plain(row, order):
    return tuple(round(v, 6) if isinstance(v, float) else v for v in (row[i] for i in order))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    frame = QUERIES[name](spark, FOLDER)
    names, expected = sql_rows(name)
    assert sorted(frame.columns) == sorted(names)
    mine, theirs = ([c.index(n) for n in sorted(names)] for c in (frame.columns, names))
    assert sorted((plain(r, mine) for r in frame.collect()), key=str) == sorted((plain(r, theirs) for r in expected), key=str)


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
