"""Repeatable samples and pages.

A sample is the first n rows of each stratum in a shuffled order given by an order key. The
window keeps n rows per stratum in every partition before the shuffle, so a stratum with most
of the corpus costs no more than a small one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from voxtable.functions import lexicons as lex
from voxtable.operators import positions


def seeded_order(seed: int = 42, key: str = "review_id") -> list[Column]:
    return [F.xxhash64(F.col(key), F.lit(seed)), F.col(key)]


def per_group(df: DataFrame, group, n: int, order) -> DataFrame:
    w = W.partitionBy(group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def rating_sample(reviews: DataFrame, n: int = lex.REVIEWS_PER_RATING, order=None) -> DataFrame:
    rated = reviews.where(F.col("rating").between(lex.MIN_RATING, lex.MAX_RATING))
    return per_group(rated, "rating", n, order or seeded_order())


def curation_sample(labeled: DataFrame, total: int = lex.CURATED_SAMPLE_SIZE, order=None) -> DataFrame:
    """High-confidence rows, an equal share per topic."""
    share = total // (len(lex.TOPICS) - 1)
    return per_group(high_confidence(labeled), "topic_label", share, order or seeded_order())


def high_confidence(labeled: DataFrame, minimum: int = lex.MIN_LABEL_CONFIDENCE) -> DataFrame:
    return labeled.where((F.col("confidence_score") >= minimum) & (F.col("topic_label") != "other"))


def shuffled(df: DataFrame, order=None) -> DataFrame:
    return df.orderBy(*(order or seeded_order()))


def first_rows(df: DataFrame, n: int, *order) -> DataFrame:
    """First n rows; 0 means all of them."""
    return df.orderBy(*order).limit(n) if n else df


def prefix(df: DataFrame, n: int, key: str = "review_id") -> DataFrame:
    """First n rows by a unique key, for an n too large to gather.

    The key at place n, found by counting keys, filters the table where it lies.
    """
    return positions.first(df, n, key)


def verification_sample(df: DataFrame, n: int = 100, order=None) -> DataFrame:
    return df.orderBy(*(order or seeded_order())).limit(n)
