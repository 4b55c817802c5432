"""Fit and store all four models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxtable.operators import classifier, hmm, probability, sentiment, tfidf
from voxtable.operators.labeling import coerce_topic
from voxtable.sources import models


def train_all(spark: SparkSession, corpus: DataFrame, labeled: DataFrame, root: str, hmm_iterations: int = 100,
              polarity: DataFrame | None = None, source: str = "corpus", with_index: bool = True) -> DataFrame:
    """``corpus`` has review_id, text, rating and sentences; ``labeled`` also topic_label.

    Returns the overview of the stored models.
    """
    root = root.rstrip("/")
    index = tfidf.fit(corpus)
    vocabulary_size = index.vocabulary.count()
    meta = models.metadata_row(spark, "TF-IDF", source, index.n_docs, {"max_features": index.max_features, "ngram_range": [1, 2]},
                               {"vocabulary_size": vocabulary_size})
    models.save_tfidf(index, f"{root}/tfidf", meta, tfidf.transform(corpus, index, packed=True) if with_index else None)

    nb = classifier.fit(labeled, label="topic_label")
    summary = classifier.fit_summary(nb).first()
    meta = models.metadata_row(spark, "Naive Bayes", source, nb.tfidf.n_docs,
                               {"alpha": nb.alpha, "max_features": nb.tfidf.max_features},
                               {"n_features": summary["n_features"], "classes": ",".join(summary["classes"])})
    models.save_classifier(nb, f"{root}/classifier", meta)

    with_topics = labeled.withColumn("topic", coerce_topic("topic_label"))
    tables = probability.fit(with_topics)
    meta = models.metadata_row(spark, "Bayesian Net", source, nb.tfidf.n_docs,
                               {"structure": "topic>sentiment>rating_category"}, {"n_cpds": 3})
    models.save_probabilities(tables, f"{root}/probabilities", meta)

    observed = sentiment.observations(corpus, polarity)
    sequence_model = hmm.fit(observed, max_iter=hmm_iterations)
    if sequence_model is not None:
        meta = models.metadata_row(spark, "HMM", source, index.n_docs,
                                   {"n_components": hmm.N_STATES, "n_iter": hmm_iterations},
                                   {"converged": sequence_model.converged, "iterations": sequence_model.iterations})
        models.save_hmm(spark, sequence_model, f"{root}/hmm", meta)
    names = ["tfidf", "classifier", "probabilities"] + (["hmm"] if sequence_model is not None else [])
    meta = models.load_metadata(spark, f"{root}/{names[0]}")
    for name in names[1:]:
        meta = meta.unionByName(models.load_metadata(spark, f"{root}/{name}"))
    return models.model_overview(meta)
