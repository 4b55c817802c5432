"""Classification metrics and checks on search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from voxtable.operators.rows import exploded
from voxtable.sources.scratch import literal_table


def split_mask(key: str, percent: int = 80, seed: int = 42) -> Column:
    """Repeatable train mask from a hash of the key."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(100)) < percent


def confusion(pairs: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    return pairs.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def accuracy(pairs: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    return pairs.agg(F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("accuracy"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def class_report(pairs: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and support per class, plus accuracy, macro and weighted rows.

    Everything after the confusion counts works on classes-squared rows.
    """
    cells = confusion(pairs, label, predicted)
    sides = cells.select(F.inline(F.array(
        F.struct(F.col("label").alias("name"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("claimed"),
                 F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0).alias("right")),
        F.struct(F.col("predicted").alias("name"), F.lit(0).cast("bigint").alias("support"),
                 F.col("n").alias("claimed"), F.lit(0).cast("bigint").alias("right")))))
    per = sides.groupBy("name").agg(*[F.sum(c).alias(c) for c in ("support", "claimed", "right")])
    p, r = _ratio(F.col("right"), F.col("claimed")), _ratio(F.col("right"), F.col("support"))
    per = per.select("name", p.alias("precision"), r.alias("recall"), "support", "right")
    f1 = F.coalesce(2 * F.col("precision") * F.col("recall")
                    / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0))
    per = per.withColumn("f1", f1)
    names = ["precision", "recall", "f1"]
    summary = per.agg(
        *[F.avg(c).alias(f"macro_{c}") for c in names],
        *[_ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"weighted_{c}") for c in names],
        _ratio(F.sum("right"), F.sum("support")).alias("acc"), F.sum("support").alias("support"))
    rows = [F.struct(F.lit(f"{k} avg").alias("name"), *[F.col(f"{k}_{c}").alias(c) for c in names], F.col("support"))
            for k in ("macro", "weighted")]
    rows.append(F.struct(F.lit("accuracy").alias("name"), *[F.col("acc").alias(c) for c in names], F.col("support")))
    columns = ["name", "precision", "recall", "f1", "support"]
    return per.select(*columns).unionByName(summary.select(F.inline(F.array(*rows))).select(*columns))


# ---- checks on search results --------------------------------------------------------------

def recall_improvement(counts: DataFrame) -> DataFrame:
    """(query_id, base_count, expanded_count) -> check rows."""
    delta = F.col("expanded_count") - F.col("base_count")
    return counts.select(F.lit("recall_improvement").alias("name"), "query_id",
                         (delta >= 0).alias("passed"), "base_count", "expanded_count", delta.alias("delta"))


def recall_ratio(counts: DataFrame) -> DataFrame:
    return counts.select("query_id", (F.col("expanded_count") / F.nullif("base_count", F.lit(0))).alias("ratio"))


def score_ordering(ranked: DataFrame) -> DataFrame:
    """Passes when no score rises along the rank."""
    w = W.partitionBy("query_id").orderBy("rank")
    step = ranked.withColumn("rises", F.coalesce(F.col("score") > F.lag("score").over(w), F.lit(False)))
    return step.groupBy("query_id").agg((~F.bool_or("rises")).alias("passed"), F.count("*").alias("n_scores")).select(
        F.lit("score_ordering").alias("name"), "query_id", "passed", "n_scores")


def expansion_not_empty(expanded: DataFrame, terms: str = "expanded_terms") -> DataFrame:
    n = F.size(F.col(terms))
    return expanded.select(F.lit("expansion_not_empty").alias("name"), "query_id", (n > 0).alias("passed"),
                           n.alias("term_count"))


def judged_results(ranked: DataFrame, judgments: DataFrame) -> DataFrame:
    return ranked.join(judgments, ["query_id", "review_id"])


def precision_at_k(ranked: DataFrame, judgments: DataFrame, k: int) -> DataFrame:
    judged = judged_results(ranked.where(F.col("rank") <= k), judgments)
    return judged.groupBy("query_id").agg(F.count("*").alias("judged"),
                                          F.avg(F.col("is_relevant").cast("double")).alias("precision"))


def relevant_term_share(judgments: DataFrame) -> DataFrame:
    return judgments.groupBy("query_id").agg(F.avg(F.col("is_relevant").cast("double")).alias("relevant_share"))


def term_coverage(matched: DataFrame) -> DataFrame:
    """Share of the retrieved reviews that contain any expanded term."""
    return matched.groupBy("query_id").agg(F.avg((F.size("matching_terms") > 0).cast("double")).alias("coverage"))


def top_matching_terms(matched: DataFrame) -> DataFrame:
    """Distinct terms per review, then reviews per (query, term)."""
    return exploded(matched, ["query_id"], F.array_distinct("matching_terms"), "term") \
        .groupBy("query_id", "term").agg(F.count("*").alias("n_reviews"))
