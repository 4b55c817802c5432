"""Rows by position: key histograms beside a sorted list."""

import random

import pytest

from voxtable.operators import positions
from voxtable.operators.positions import Place


def ordered(keys):
    return sorted(keys, key=lambda k: (k is not None, len(k or ""), k or ""))


@pytest.fixture(scope="module")
def keys():
    rng = random.Random(3)
    out = [f"R{rng.randrange(10 ** rng.choice([4, 6, 8])):06d}" for _ in range(300)]
    return out + [None] * 3 + [out[0]] * 40 + ["é", "ée", "日本語x", ""]


@pytest.fixture(scope="module")
def table(spark, keys):
    rows = [(k, i) for i, k in enumerate(keys)]
    return spark.createDataFrame(random.Random(5).sample(rows, len(rows)), "review_id string, other int").repartition(4).cache()


@pytest.mark.parametrize("few", [0, 20, 100_000])
def test_keys_at_positions(table, keys, few, monkeypatch):
    monkeypatch.setattr(positions, "FEW", few)
    expected, asked = ordered(keys), [0, 2, 3, 4, 7, 100, 211, len(keys) - 1, len(keys)]
    got = positions.places(table, asked)
    assert sorted(got) == asked[:-1]
    for p in got:
        k = expected[p]
        assert got[p] == Place(k, expected.index(k), keys.count(k))


@pytest.mark.parametrize("start, stop", [(0, 1), (0, 5), (2, 4), (10, 30), (0, 1000), (50, 50), (340, 360), (900, 950), (-5, 3)])
def test_rows_between_positions(table, keys, start, stop):
    got = ordered(r[0] for r in positions.between(table, start, stop).select("review_id").collect())
    assert got == ordered(keys)[max(start, 0):max(stop, 0)]


def test_edges_inside_copies(table, keys):
    expected = ordered(keys)
    at = expected.index(keys[0])
    for start, stop in ((at + 3, at + 9), (at - 2, at + 5), (at + 5, at + 60), (at, at + 41)):
        got = ordered(r[0] for r in positions.between(table, start, stop).select("review_id").collect())
        assert got == expected[start:stop]


def test_page_has_positions_and_whole_rows(table, keys):
    rows = positions.page(table, 20, 10).orderBy("row_index").collect()
    assert [r["row_index"] for r in rows] == list(range(20, 30))
    assert [r["review_id"] for r in rows] == ordered(keys)[20:30] and set(table.columns) <= set(rows[0].asDict())


def test_empty_table(spark):
    empty = spark.createDataFrame([], "review_id string, other int")
    assert positions.places(empty, [0, 5]) == {} and positions.first(empty, 3).count() == 0 and positions.page(empty, 0, 5).count() == 0


def test_edges_read_the_key_column_alone(spark, table, tmp_path):
    path = str(tmp_path / "t.parquet")
    table.write.parquet(path)
    plan = positions.first(spark.read.parquet(path), 25)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
