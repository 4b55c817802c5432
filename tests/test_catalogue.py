"""Catalogue queries against their SQL on the smallest tables.

A cross-section by default; CATALOGUE=all runs every query.
"""

import os
import sys
from pathlib import Path

import duckdb
import pytest

from voxtable.plans.catalogue import QUERIES, SQL

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))
from check_queries import TABLES, rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"
QUICK = ["s02_surrogate_id", "s03_csv_scan", "p06_clean", "p06_clean_report", "p11_fallback", "p19_question_detector", "w01_rating_sample",
         "w09_examples", "a05_length_stats", "a07_phrases", "a11_cooccurrence", "a14_probability_tables", "a15_hmm_fit", "a22_class_report",
         "m02_retrieve", "m03_classify", "m09_viterbi", "w03_beam_paths", "j04_verdict_upsert", "j07_term_filter", "h04_sentences",
         "h22_path_text", "x01_arriving_reviews", "m13_analyze_summary"]
NAMES = sorted(SQL) if os.environ.get("CATALOGUE") == "all" else QUICK


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, sql, name):
    df = QUERIES[name](spark, SF)
    cur = sql.execute(SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cur.fetchall())


@pytest.mark.parametrize("partitions", [1, 64])
def test_same_rows_for_any_number_of_partitions(spark, sql, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = QUERIES["m02_retrieve"](spark, SF)
        cur = sql.execute(SQL["m02_retrieve"])
        assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in cur.description], cur.fetchall())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
