"""Cleaning, labelling and scoring of reviews as they arrive."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxtable.functions import text as tx
from voxtable.operators import classifier, cleaning, hmm, labeling, sentiment


def arriving_reviews(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    """New parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def labeled_stream(stream: DataFrame, lexicon: dict | None = None, event_time: str | None = None,
                   lateness: str = "1 hour") -> DataFrame:
    """The row-local part of the cleaning, keyword labels and sentences.

    With an event-time column exact copies inside the lateness are dropped; their digests are
    forgotten once the watermark has passed, so the state stays bounded and a copy that comes
    later is a new review. Rows older than the watermark are dropped.
    """
    rows = cleaning.has_text(stream)
    if event_time:
        rows = rows.withColumn("_digest", F.sha2("text", 256)).withWatermark(event_time, lateness) \
            .dropDuplicatesWithinWatermark(["_digest"]).drop("_digest")
    rows = cleaning.with_normal_space(rows)
    rows = rows.where(cleaning.length_between() & cleaning.rating_between())
    return labeling.auto_label(rows, lexicon).withColumn("sentences", tx.sentences("text"))


def write_scored(stream: DataFrame, nb: classifier.NaiveBayesModel, output: str, checkpoint: str,
                 sequences: hmm.HmmModel | None = None, polarity: DataFrame | None = None):
    """Classify the reviews of each micro-batch, decode the states of their sentences, store both.

    The rows of a batch are written first and read from there by classifier and decoder, so the
    stream (its reading, digests and labels) is computed once; each row gets a number of its own, so two
    rows of one id stay two. Without a ``sequences`` model the states come from the polarity; a
    review without sentences has none. A batch that is replayed after a failure overwrites its own folder, and
    a new checkpoint writes beside the results of an older one: ``run=<stream>/batch=<number>``.
    """
    output, checkpoint = output.rstrip("/"), checkpoint.rstrip("/")

    def score(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        run = json.loads(session.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        rows = batch.withColumn("_row", F.monotonically_increasing_id())
        rows.write.mode("overwrite").parquet(f"{output}/_arrived/{run}")
        rows = session.read.schema(rows.schema).parquet(f"{output}/_arrived/{run}")
        topics = classifier.predict(rows.select("_row", "text"), nb, "_row")
        states = hmm.analyze(sentiment.observations(rows, polarity, "_row"), sequences).select("_row", "sentiment_states", "transitions")
        scored = rows.join(topics, "_row").join(states, "_row", "left").drop("_row")
        scored.write.mode("overwrite").parquet(f"{output}/run={run}/batch={batch_id}")

    return (stream.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
