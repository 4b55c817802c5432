"""Multinomial Naive Bayes over TF-IDF weights.

A document score is linear in its weights, so the norm and all class sums are plain sums over
the document's terms: one narrow aggregate per document, no class-by-term cross product.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from voxtable.functions import lexicons as lex
from voxtable.operators import counting, tfidf
from voxtable.operators.labeling import coerce_topic
from voxtable.sources.scratch import literal_table, materialize, small


class NaiveBayesModel(NamedTuple):
    terms: DataFrame        # term, idf, logp ARRAY<DOUBLE> in class order
    priors: DataFrame       # one row: priors ARRAY<DOUBLE> in class order, null for unseen classes
    tfidf: tfidf.TfidfModel
    classes: list
    alpha: float


def feature_sums(docs: DataFrame, model: tfidf.TfidfModel, classes: list, label: str) -> DataFrame:
    """(term, idf, f_0 .. f_n): summed unit weights of each class, one column per class."""
    weights = tfidf.transform(docs, model, "review_id", label, packed=True)
    per_class = [F.sum(F.when(F.col(label) == c, F.col("weight")).otherwise(0.0)).alias(f"f_{i}")
                 for i, c in enumerate(classes)]
    sums = weights.groupBy("term").agg(*per_class)
    joined = model.vocabulary.select("term", "idf").join(sums, "term", "left")
    return joined.select("term", "idf", *[F.coalesce(F.col(f"f_{i}"), F.lit(0.0)).alias(f"f_{i}")
                                          for i in range(len(classes))])


def fit(docs: DataFrame, label: str = "label", classes: list | None = None, max_features: int = 5000,
        alpha: float = 1.0, stop_words=None) -> NaiveBayesModel:
    """``docs`` needs review_id, text and the label; labels outside ``classes`` become 'other'."""
    classes = list(classes or lex.TOPICS)
    if "other" in classes:
        docs = docs.withColumn(label, F.when(F.col(label).isin(classes), F.col(label)).otherwise("other"))
    docs = materialize(docs.select("review_id", "text", label), "labeled-texts")  # labels are often worked out from the text, four passes read them
    ks = range(len(classes))
    sizes = docs.agg(F.count("*").alias("n"), *[F.count_if(F.col(label) == c).alias(f"n_{i}") for i, c in enumerate(classes)]).first()
    if sizes["n"] == 0:
        raise ValueError("cannot fit a classifier on an empty table")
    log_share = [math.log(sizes[f"n_{i}"] / sizes["n"]) if sizes[f"n_{i}"] else None for i in ks]
    priors = literal_table(docs.sparkSession, {"priors": [log_share]})
    model = tfidf.fit(docs, max_features, stop_words=stop_words, n_docs=sizes["n"])
    sums = materialize(feature_sums(docs, model, classes, label), "class-sums")
    totals = sums.agg(F.count("*").alias("v"), *[F.sum(f"f_{i}").alias(f"t_{i}") for i in ks]).first()
    logp = [F.log((F.col(f"f_{i}") + alpha) / (totals[f"t_{i}"] + alpha * totals["v"])) for i in ks]
    terms = sums.select("term", "idf", F.array(*logp).alias("logp"))
    return NaiveBayesModel(terms, priors, model, classes, alpha)


def fit_summary(model: NaiveBayesModel) -> DataFrame:
    seen = F.filter(F.transform("priors", lambda p, i: F.when(
        p.isNotNull(), F.get(F.array(*[F.lit(c) for c in model.classes]), i))), lambda c: c.isNotNull())
    n_features = model.terms.agg(F.count("*")).scalar()
    return model.priors.select(F.lit(model.tfidf.n_docs).cast("bigint").alias("n_samples"),
                               n_features.alias("n_features"), F.array_sort(seen).alias("classes"))


def class_scores(docs: DataFrame, model: NaiveBayesModel, key: str = "review_id") -> DataFrame:
    """(key, scores): joint log-probability per class; texts without a known term keep the prior."""
    known = tfidf.known_terms(model.terms, model.tfidf.max_features, "logp")
    if known is not None:
        names = [r["term"] for r in known]
        numbered = docs.sparkSession.createDataFrame([(i, r["idf"], r["logp"]) for i, r in enumerate(known)], "number int, idf double, logp array<double>")
        exploded = counting.counts(docs, names, key, stop_words=model.tfidf.stop_words).select(key, F.inline_outer("terms"))
        met = exploded.join(small(numbered, len(names)), "number", "left")
    else:
        exploded = tfidf.counted_terms(docs, key, stop_words=model.tfidf.stop_words).select(key, F.inline_outer("terms"))
        met = exploded.join(model.terms, "term", "left")
    w = F.col("tf") * F.col("idf")
    ks = range(len(model.classes))
    per_doc = met.groupBy(key).agg(
        F.sqrt(F.sum(w * w)).alias("norm"), *[F.sum(w * F.get("logp", F.lit(i))).alias(f"s_{i}") for i in ks])
    prior = model.priors.scalar()
    parts = [F.get("p", F.lit(i)) + F.coalesce(F.col(f"s_{i}") / F.col("norm"), F.lit(0.0)) for i in ks]
    return per_doc.withColumn("p", prior).select(key, F.array(*parts).alias("scores"))


def predict(docs: DataFrame, model: NaiveBayesModel, key: str = "review_id") -> DataFrame:
    """(key, predicted_topic, confidence, top_features).

    Scores equal to 9 decimals go to the first class in order. ``top_features`` is always
    empty, as weights are never negative and log-probabilities never positive.
    """
    scored = class_scores(docs, model, key).withColumn("best", F.array_max("scores"))
    exps = F.aggregate("scores", F.lit(0.0),
                       lambda acc, s: acc + F.coalesce(F.exp(s - F.col("best")), F.lit(0.0)))
    close = F.transform("scores", lambda s: F.round(s, 9) == F.round(F.col("best"), 9))
    winner = F.get(F.array(*[F.lit(c) for c in model.classes]), F.array_position(close, F.lit(True)).cast("int") - 1)
    empty = F.array().cast("array<string>")
    return scored.select(key, coerce_or_same(winner, model.classes).alias("predicted_topic"),
                         (1.0 / exps).alias("confidence"), empty.alias("top_features"))


def coerce_or_same(topic: Column, classes: list) -> Column:
    return coerce_topic(topic) if "other" in classes else topic


def explain_features(docs: DataFrame, model: NaiveBayesModel, n: int = 3) -> DataFrame:
    """Top n terms per review by weight times the lead of the predicted class over the mean."""
    predicted = predict(docs, model).select("review_id", "predicted_topic")
    order = F.array(*[F.lit(c) for c in model.classes])
    lookup = small(model.terms.select("term", "logp"), model.tfidf.max_features)
    mean = F.aggregate("logp", F.lit(0.0), lambda a, x: a + x) / F.size("logp")
    weighted = tfidf.transform(docs, model.tfidf, packed=True).join(lookup, "term").join(predicted, "review_id")
    own = F.get("logp", F.array_position(order, F.col("predicted_topic")).cast("int") - 1)
    lead = weighted.select("review_id", "term", (F.col("weight") * (own - mean)).alias("lead"))
    w = W.partitionBy("review_id").orderBy(F.desc(F.round("lead", 9)), "term")
    ranked = lead.where(F.col("lead") > 0).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= n)


def topic_filter(scored: DataFrame, target: str = "target_topic", min_confidence: float = 0.5) -> DataFrame:
    """Marks the rows of each query that carry its topic with enough confidence, and whether
    the query falls back to all its rows.

    The rows are read twice, for the verdict per query (an aggregate, so a query with most of
    the rows stays spread) and for the result: pass a stored table.
    """
    kept = (F.col("predicted_topic") == coerce_topic(target)) & (F.col("confidence") >= min_confidence)
    flagged = scored.withColumn("kept", kept)
    per_query = flagged.groupBy("query_id").agg((~F.bool_or("kept")).alias("fallback_used"))
    return flagged.join(per_query, "query_id")


def topic_distribution(scored: DataFrame) -> DataFrame:
    return scored.groupBy("query_id", "predicted_topic").agg(F.count("*").alias("n"))


def fallback_diagnosis(scored: DataFrame, target: str = "target_topic", min_confidence: float = 0.5) -> DataFrame:
    """Per query: rows that carry the topic, and how many of them lack the confidence."""
    on_topic = F.col("predicted_topic") == coerce_topic(target)
    return scored.groupBy("query_id").agg(
        F.count_if(on_topic).alias("on_topic"),
        F.count_if(on_topic & (F.col("confidence") < min_confidence)).alias("below_confidence"))
