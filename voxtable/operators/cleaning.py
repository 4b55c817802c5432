"""Corpus cleaning, surrogate keys and text enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from voxtable.functions import lexicons as lex, text as tx
from voxtable.sources.scratch import materialize, small


def keep_first_copy(df: DataFrame, key: str = "text", order: str = "review_id") -> DataFrame:
    """One row per distinct ``key``: the one with the smallest ``order``.

    Only digests and ids are aggregated, and combined before the shuffle, so a text that fills a
    third of the corpus reaches its reducer as one row per map task. Texts are never sorted; they
    meet the digests that have copies, a stored and counted table. ``order`` is unique.
    """
    copied = materialize(copied_texts(df, key, order), "copied")
    marked = df.withColumn("_digest", _digest(key)).join(small(copied, copied.count()), "_digest", "left")
    return marked.where(F.col("_first").isNull() | (F.col("_first") == _place(order))).select(*df.columns)


def _digest(key: str) -> Column:
    return F.coalesce(F.sha2(F.col(key), 256), F.lit(""))


def _place(order: str) -> Column:
    return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(tx.id_order(order))])


def copied_texts(df: DataFrame, key: str = "text", order: str = "review_id") -> DataFrame:
    """Digest and first place of every text that occurs more than once."""
    per_text = df.select(_digest(key).alias("_digest"), _place(order).alias("_place")).groupBy("_digest").agg(
        F.min("_place").alias("_first"), F.count("*").alias("_n"))
    return per_text.where("_n > 1").select("_digest", "_first")


def has_text(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(F.col(text).isNotNull() & ~tx.is_blank(text))


def with_normal_space(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, tx.normalize_space(text))


def length_between(text: str | Column = "text", low: int = lex.MIN_TEXT_LENGTH,
                   high: int = lex.MAX_TEXT_LENGTH) -> Column:
    return F.length(text).between(low, high)


def rating_between(low: int = lex.MIN_RATING, high: int = lex.MAX_RATING) -> Column:
    return F.coalesce(F.col("rating").between(low, high), F.lit(False))


def clean(reviews: DataFrame) -> DataFrame:
    """Drop exact copies (raw text, first id stays), blank texts, odd lengths and odd ratings.

    The text conditions give the same verdict for every copy of a text, so they run before
    the copies are removed and shrink that shuffle; the rating condition differs between
    copies and must run after it.
    """
    normal = tx.normalize_space("text")
    usable = has_text(reviews).where(length_between(normal))
    return with_normal_space(keep_first_copy(usable)).where(rating_between())


def clean_report(reviews: DataFrame) -> DataFrame:
    """Rows before, copies removed, rows kept and the removed share, in one narrow pass."""
    normal = tx.normalize_space("text")
    flagged = reviews.select(
        "review_id", F.sha2("text", 256).alias("digest"),
        (F.col("text").isNotNull() & ~tx.is_blank("text") & length_between(normal)).alias("text_ok"),
        rating_between().alias("rating_ok"))
    per_text = flagged.groupBy("digest").agg(
        F.count("*").alias("n"), F.min_by(F.coalesce("text_ok", F.lit(False)) & F.col("rating_ok"), F.struct(F.length("review_id"), "review_id")).alias("ok"))
    total = per_text.agg(
        F.sum("n").alias("original_count"),
        F.count("*").alias("distinct_count"),
        F.count_if("ok").alias("cleaned_count"))
    return total.select(
        "original_count",
        (F.col("original_count") - F.col("distinct_count")).alias("duplicates_removed"),
        "cleaned_count",
        (F.col("original_count") - F.col("cleaned_count")).alias("removed_count"),
        ((F.col("original_count") - F.col("cleaned_count")) / F.col("original_count") * 100).alias("removed_pct"))


def dense_index(df: DataFrame, *order, name: str = "row_index") -> DataFrame:
    """Number the rows 0, 1, 2, ... in the given order without a single-task window.

    The rows are range-sorted, numbered inside their partition, and shifted by the sizes of
    the partitions before it. Only one row per partition is ever gathered.
    """
    local = df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id())
    stored = materialize(local, "dense-index")
    part = F.shiftright("_mid", 33)
    sizes = stored.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    numbered = stored.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    local_no = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.withColumn(name, F.col("_offset") + local_no).drop("_part", "_offset", "_mid")


def assign_ids(df: DataFrame, *order) -> DataFrame:
    """Surrogate ``review_id`` from the 0-based position."""
    indexed = dense_index(df, *order)
    return indexed.withColumn("review_id", tx.formatted_id("row_index")).drop("row_index")


def with_sentences(df: DataFrame) -> DataFrame:
    return (df.withColumn("sentences", tx.sentences("text"))
              .withColumn("sentence_count", F.size("sentences")))


def prefilter(reviews: DataFrame, topic: str | None = None, rating_band: str | None = None,
              sentiment: str | None = None, lang: str | None = None) -> DataFrame:
    """Optional corpus filters before retrieval; plain predicates, so they reach the scan."""
    out = reviews
    if topic:
        out = out.where(F.col("topic") == topic)
    if rating_band:
        out = out.where({"low": F.col("rating") <= 2, "medium": F.col("rating") == 3,
                         "high": F.col("rating") >= 4}[rating_band])
    if sentiment:
        out = out.where(F.col("sentiment") == sentiment)
    if lang:
        out = out.where(F.col("lang") == lang)
    return out
