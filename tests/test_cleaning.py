"""Cleaning, numbering, sampling, curation."""

from pyspark.sql import functions as F

from voxtable.operators import cleaning, labeling, sampling

REVIEW = "review_id string, text string, rating int"


def test_clean_keeps_first_copy_and_drops_odd_rows(spark):
    rows = [("R3", "same words here", 5), ("R1", "same words here", 4), ("R2", "  same words  here", 3), ("R4", None, 3),
            ("R5", "short", 3), ("R6", "a fine long text", 9), ("R7", "   ", 2), ("R8", "x" * 5001, 2)]
    out = cleaning.clean(spark.createDataFrame(rows, REVIEW)).orderBy("review_id").collect()
    assert [(r["review_id"], r["text"], r["rating"]) for r in out] == [("R1", "same words here", 4), ("R2", "same words here", 3)]


def test_first_copy_decides_even_when_its_rating_is_dropped(spark):
    rows = [("R1", "copied text here", 0), ("R2", "copied text here", 4)]
    df = spark.createDataFrame(rows, REVIEW)
    assert cleaning.clean(df).count() == 0
    report = cleaning.clean_report(df).first()
    assert (report["original_count"], report["duplicates_removed"], report["cleaned_count"]) == (2, 1, 0)


def test_hot_copies_shuffle_once_per_task(spark):
    df = spark.range(0, 3000, 1, 4).select(F.format_string("R%06d", "id").alias("review_id"),
                                           F.when(F.col("id") % 3 > 0, "the same hot text").otherwise(F.concat(F.lit("text number "), "id")).alias("text"))
    out = cleaning.keep_first_copy(df)
    assert out.count() == 1001
    assert out.where(F.col("text") == "the same hot text").first()["review_id"] == "R000001"


def test_dense_index_is_gapless_for_any_partitioning(spark):
    for parts in (1, 7):
        df = spark.range(0, 500, 1, parts).select((F.col("id") * 37 % 500).alias("k"))
        rows = cleaning.dense_index(df, "k").orderBy("row_index").collect()
        assert [(r["k"], r["row_index"]) for r in rows] == [(i, i) for i in range(500)]


def test_rating_sample_sizes_and_repeatability(spark):
    df = spark.range(200).select(F.format_string("R%06d", "id").alias("review_id"), F.when(F.col("id") < 5, 1).otherwise(2).alias("rating"))
    a = {r["review_id"] for r in sampling.rating_sample(df).collect()}
    b = {r["review_id"] for r in sampling.rating_sample(df.repartition(9)).collect()}
    assert a == b and len(a) == 25


def test_limit_zero_means_all(spark):
    df = spark.range(10)
    assert sampling.first_rows(df, 0, "id").count() == 10
    assert sampling.first_rows(df, 3, "id").count() == 3


def test_auto_label_hand_values(spark):
    rows = [(1, "slow and crashes with an error"), (2, "nothing to see"), (3, "free update"), (4, "the cost")]
    out = {r["k"]: r for r in labeling.auto_label(spark.createDataFrame(rows, "k int, text string")).collect()}
    assert (out[1]["topic_label"], out[1]["confidence_score"], out[1]["matched_keywords"]) == ("performance", 3, ["slow", "crash", "error"])
    assert (out[2]["topic_label"], out[2]["confidence_score"], out[2]["matched_keywords"]) == ("other", 0, [])
    assert out[3]["topic_label"] == "pricing" and out[4]["topic_label"] == "pricing"


def test_query_topics(spark):
    rows = [("too expensive subscription cost",), ("quantum entanglement in photons",), ("",)]
    got = [r["t"] for r in spark.createDataFrame(rows, "q string").select(labeling.detect_topic("q").alias("t")).collect()]
    assert got == ["pricing", "other", "other"]


def test_verdicts_last_file_wins(spark):
    curated = spark.createDataFrame([(0, "a", None), (1, "b", "usability")], "row_index bigint, review_id string, verified_topic string")
    verdicts = spark.createDataFrame(
        [(0, "performance", "batch_0_29.csv", 0), (0, "pricing", "batch_120_149.csv", 0), (0, "support", "batch_30_59.csv", 0),
         (9, "other", "batch_30_59.csv", 1)], "row_index bigint, verified_topic string, file string, position int")
    strict = {r["row_index"]: r["verified_topic"] for r in labeling.apply_verdicts(curated, verdicts).collect()}
    assert strict == {0: "support", 1: "usability"}
    loose = {r["row_index"]: r["verified_topic"] for r in labeling.apply_verdicts(curated, verdicts, strict=False).collect()}
    assert loose == {0: "support", 1: "usability", 9: "other"}
    assert [r["row_index"] for r in labeling.unknown_verdicts(curated, verdicts).collect()] == [9]


def test_prefix_by_key(spark):
    df = spark.range(0, 300, 1, 6).select(F.format_string("R%06d", F.lit(299) - F.col("id")).alias("review_id"))
    assert sorted(r[0] for r in sampling.prefix(df, 40).collect()) == [f"R{i:06d}" for i in range(40)]
    assert sampling.prefix(df, 1000).count() == 300


def test_ids_follow_the_files(spark, folder):
    from voxtable.sources import corpus

    rows = [(f"text {i}", 3, "t", "p", i) for i in range(100)]
    df = spark.createDataFrame(rows, "text string, rating int, title string, parent_asin string, n int")
    df.repartitionByRange(7, "n").sortWithinPartitions("n").drop("n").write.json(f"{folder}/raw")
    out = corpus.ingest_with_ids(spark, f"{folder}/raw").collect()
    assert {r["review_id"]: r["text"] for r in out} == {f"R{i:06d}": f"text {i}" for i in range(100)}
