"""Order of ids beyond six digits, decimal ratings, the scratch folder."""

import pytest
from pyspark.sql import functions as F

from voxtable.functions import text as tx
from voxtable.operators import cleaning, profiling, sampling
from voxtable.sources import corpus, scratch


@pytest.fixture()
def border(spark):
    n = F.col("id") + 999_995
    return spark.range(12).select(tx.formatted_id(n).alias("review_id"), F.concat(F.lit("text "), F.col("id") % 3).alias("text"), F.lit(3).alias("rating"))


def test_first_copy_and_prefix_cross_the_border(border):
    assert [r["review_id"] for r in cleaning.keep_first_copy(border).orderBy("review_id").collect()] == ["R999995", "R999996", "R999997"]
    assert {r["review_id"] for r in sampling.prefix(border, 7).collect()} == {*(f"R99999{k}" for k in range(5, 10)), "R1000000", "R1000001"}


def test_first_matches_cross_the_border(border):
    assert [r["text"] for r in profiling.reviews_with_term(border, "text", 2).collect()] == ["text 0", "text 1"]
    found = profiling.examples_per_term(border, ["text"], 1).collect()
    assert [r["review_id"] for r in found] == ["R999995"]


def test_decimal_ratings_arrive(spark, tmp_path):
    (tmp_path / "raw.json").write_text('{"text": "a", "rating": 5.0}\n{"text": "b", "rating": 4}\n{"text": "c"}\n')
    assert [r["rating"] for r in corpus.ingest_json_lines(spark, str(tmp_path / "raw.json")).orderBy("text").collect()] == [5, 4, None]
    (tmp_path / "t.csv").write_text('review_id,text,rating,title,product_id\nR1,x,4.0,t,p\nR2,y,3,t,p\n')
    assert [r["rating"] for r in corpus.read_csv(spark, str(tmp_path / "t.csv")).orderBy("review_id").collect()] == [4, 3]


class Conf(dict):
    def set(self, key, value):
        self[key] = value


class Session:
    def __init__(self, **conf):
        self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})


def test_scratch_folder_must_be_named_on_a_cluster():
    with pytest.raises(ValueError):
        scratch.scratch_root(Session(spark_master="spark://host:7077"))
    assert scratch.scratch_root(Session(spark_master="local[4]"))
    named = Session(spark_master="yarn")
    named.conf["spark.checkpoint.dir"] = "hdfs:///shared/"
    assert scratch.scratch_root(named) == "hdfs:///shared"
