"""The registered queries: each applies one operator with its production parameters to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from voxtable.llm import (
    bpe, chat_format, embedding_dedup, hard_negatives, minhash, packing, quality_rules, secrets, substring_dedup, suffix_dedup, toxicity, warc,
    whitening)
from voxtable.llm.sql import SQL  # noqa: F401

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Document measures, document verdict and the verdict of its host."""
    return quality_rules.assess(table(spark, folder, "documents")).withColumn("host_rate", F.round("host_rate", 9))


@query
def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    packed = packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def held_out(id_col):
    """The fold that is never trained on."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def training_labels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").where(~held_out(F.col("doc_id")))


@query
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Score and verdict of every document; labels of the held-out fold are not learnt."""
    docs = table(spark, folder, "documents")
    machine = toxicity.fit(docs, training_labels(spark, folder))
    return toxicity.score(docs, machine).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), F.col("toxic").alias("predicted"))


@query
def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without the 50-word windows that start in an earlier document."""
    found = substring_dedup.dedup(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), F.size("removed").cast("long").alias("n_intervals"))


@query
def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of all documents' ids and of the text decoded from them."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    decoded = bpe.decode(bpe.encode(table(spark, folder, "documents"), path), path)
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without the 400-byte strings that occur more than once."""
    found = suffix_dedup.dedup(table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


@query
def op5_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Component of near copies of every document."""
    return minhash.dedup(table(spark, folder, "documents"))


@query
def op1_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of turns and loss text, read back from the rendered conversations."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    odd = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    formatted = chat_format.format_conversations(turns.unionByName(odd), public_tokenizers.path("byte_bpe_50k.json"))
    back = chat_format.read_back(formatted)
    lines = F.transform(F.arrays_zip("roles", "texts"), lambda t: F.concat(t["roles"], F.lit("\n"), t["texts"], F.lit("\n")))
    loss = F.array_join("loss_texts", "")
    return back.select("conv_id", F.size("roles").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
                       F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                       F.char_length("formatted").cast("long").alias("formatted_chars"))


@query
def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's record, found by its key in the capture index and read back from the archives."""
    pages = table(spark, folder, "pages")
    found = warc.lookup(warc.write(pages), warc.keys_of(pages))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op2_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and component of every vector."""
    return embedding_dedup.dedup(table(spark, folder, "embeddings")).drop("recall")


@query
def op11_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of secrets in every document: pattern matches and what the network adds."""
    found = secrets.find(table(spark, folder, "documents"))
    counts = [secrets.count_of("base", name).alias(f"n_{name}") for name in secrets.KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(secrets.spans_text(F.col("base")), 256).alias("base_sha256"),
                        secrets.spans_text(F.concat("base", "found")).alias("spans"))


@query
def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """The first 32 whitened components of every vector."""
    return whitening.whiten(table(spark, folder, "embeddings")).drop("deviation_text")


@query
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of the anchors, after every seventh label has been made wrong."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, folder, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)
