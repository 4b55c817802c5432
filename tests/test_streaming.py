"""Arriving reviews: files as a stream, copies dropped inside the lateness, batches stored."""

from datetime import datetime

from pyspark.sql import functions as F

from voxtable.operators import classifier, hmm
from voxtable.streaming import scoring

SCHEMA = "review_id string, text string, rating int, ts timestamp"
ROWS = [("1", "The app crashes and is slow", 1, datetime(2024, 1, 1, 10, 0)), ("2", "The app crashes and is slow", 2, datetime(2024, 1, 1, 10, 5)),
        ("3", "Very easy to learn interface", 5, datetime(2024, 1, 1, 10, 6)), ("4", "short", 5, datetime(2024, 1, 1, 10, 7)),
        ("5", None, 5, datetime(2024, 1, 1, 10, 8)), ("6", "A rating that is odd", 9, datetime(2024, 1, 1, 10, 9))]


def test_copies_are_dropped_and_rows_labelled(spark, folder):
    spark.createDataFrame(ROWS, SCHEMA).coalesce(1).write.parquet(f"{folder}/in")
    stream = scoring.labeled_stream(scoring.arriving_reviews(spark, f"{folder}/in", SCHEMA), event_time="ts")
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ck") \
        .trigger(availableNow=True).start()
    query.awaitTermination()
    out = {r["text"]: r for r in spark.read.parquet(f"{folder}/out").collect()}
    assert sorted(out) == ["The app crashes and is slow", "Very easy to learn interface"]
    assert out["The app crashes and is slow"]["topic_label"] == "performance"
    assert out["Very easy to learn interface"]["sentences"] == ["Very easy to learn interface"]


def test_later_files_are_scored_once(spark, folder):
    train = spark.createDataFrame([("a", "app crashes slow", "performance"), ("b", "easy interface simple", "usability")],
                                  "review_id string, text string, label string")
    nb = classifier.fit(train)
    frame = spark.createDataFrame(ROWS, SCHEMA)

    def run():
        stream = scoring.labeled_stream(scoring.arriving_reviews(spark, f"{folder}/in", SCHEMA))
        scoring.write_scored(stream, nb, f"{folder}/out", f"{folder}/ck").awaitTermination()
        return {r["review_id"]: r["predicted_topic"] for r in spark.read.parquet(f"{folder}/out").collect()}

    frame.where(F.col("review_id") < "3").coalesce(1).write.parquet(f"{folder}/in")
    assert run() == {"1": "performance", "2": "performance"}
    frame.where(F.col("review_id") >= "3").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    assert run() == {"1": "performance", "2": "performance", "3": "usability"}
    assert spark.read.parquet(f"{folder}/out").count() == 3


def test_copies_states_and_runs(spark, folder):
    """A copy inside the lateness is dropped, one after it is kept; rows of one id stay apart; a new checkpoint keeps older results."""
    nb = classifier.fit(spark.createDataFrame([("a", "app crashes slow", "performance"), ("b", "easy interface simple", "usability")],
                                              "review_id string, text string, label string"))
    polarity = spark.createDataFrame([("good", 3.5), ("bad", -3.5)], "word string, valence double")

    def deliver(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")

    def run(checkpoint):
        stream = scoring.labeled_stream(scoring.arriving_reviews(spark, f"{folder}/in", SCHEMA), event_time="ts")
        scoring.write_scored(stream, nb, f"{folder}/out", f"{folder}/{checkpoint}", hmm.START, polarity).awaitTermination()
        out = spark.read.parquet(f"{folder}/out")
        return sorted((r["review_id"], r["text"], r["sentiment_states"]) for r in out.select("review_id", "text", "sentiment_states").collect())

    def at(hour, minute=0):
        return datetime(2024, 1, 1, hour, minute)

    good, bad = "A good app. It is good.", "A bad app. It is bad."
    first = [("1", good, ["positive"] * 2), ("1", bad, ["negative"] * 2)]
    deliver([("1", good, 5, at(10)), ("1", bad, 1, at(10))])
    assert run("ck") == sorted(first)
    deliver([("2", good, 5, at(10, 30))])
    assert run("ck") == sorted(first)
    later = "Something else came."
    deliver([("3", later, 3, at(13)), ("4", good, 5, at(8))])  # the second row is older than the watermark
    assert run("ck") == sorted(first + [("3", later, ["neutral"])])
    deliver([("5", good, 5, at(13, 30)), ("6", later, 3, at(13, 30))])
    kept = first + [("3", later, ["neutral"]), ("5", good, ["positive"] * 2)]
    assert run("ck") == sorted(kept)
    assert len(run("other")) > len(kept)
