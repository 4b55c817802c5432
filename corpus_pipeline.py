"""A corpus through all stages: toxicity, quality rules, near and substring duplicates, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from voxtable.llm import minhash, packing, quality_rules, suffix_dedup, toxicity
from voxtable.llm.queries import training_labels
from voxtable.sources.scratch import materialize

#: A repeat to be cut is a passage of 50 words: of four letters and a space on average, as common words are.
PASSAGE_BYTES = 250


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine does not score as toxic."""
    return toxicity.clean(docs, toxicity.fit(docs, training_labels(spark, sf_dir)))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the document rules and whose host passes."""
    return quality_rules.clean(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.8."""
    return minhash.clean(docs, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that occur more than once; n_chars follows."""
    return suffix_dedup.clean(docs, length=PASSAGE_BYTES).withColumn("n_chars", F.char_length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("quality_rules", drop_low_quality), ("minhash", drop_near_copies),
          ("suffix_dedup", cut_repeats), ("packing", pack)]

#: The trained scorer has no SQL form; the stages are tested one by one against plain counterparts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
