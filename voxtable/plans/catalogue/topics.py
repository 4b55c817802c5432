"""Keyword topics, Naive Bayes and what is built on its predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtable.functions import lexicons as lex, text as tx
from voxtable.operators import classifier, evaluation, labeling
from voxtable.plans.catalogue.base import *  # noqa: F403
from voxtable.plans.catalogue.base import query
from voxtable.plans.catalogue.sources import CURATED, curated_from
from voxtable.sources import corpus
from voxtable.sources.scratch import materialize


@query("m05_query_topic", f"""WITH {label_ctes(lex.QUERY_TOPIC_KEYWORDS, 'conversations')}
SELECT conv_id * 1000 + turn AS query_id, topic_label AS topic FROM labeled""")
def _(d):
    return d.turns.select("query_id", labeling.detect_topic("query").alias("topic"))


@query("m06_auto_label", f"""WITH {REVIEWS}, {label_ctes(lex.LABEL_TOPIC_KEYWORDS)}
SELECT review_id, topic_label, confidence_score, array_to_string(matched_keywords, '|') AS matched_keywords FROM labeled""")
def _(d):
    return labeling.auto_label(d.reviews).select("review_id", "topic_label", big("confidence_score").alias("confidence_score"),
                                                 joined("matched_keywords").alias("matched_keywords"))


@query("m06_auto_label_corpus_words", f"""WITH {REVIEWS}, {LABELED}
SELECT review_id, topic_label, confidence_score, array_to_string(matched_keywords, '|') AS matched_keywords FROM labeled""")
def _(d):
    return d.labeled.select("review_id", "topic_label", big("confidence_score").alias("confidence_score"),
                            joined("matched_keywords").alias("matched_keywords"))


@query("j10_keyword_containment", f"""WITH {REVIEWS}, {label_ctes(lex.QUERY_TOPIC_KEYWORDS)}
{' UNION ALL '.join(f"SELECT review_id, '{t}' AS topic, array_to_string(h_{t}, '|') AS keywords FROM labeled WHERE len(h_{t}) > 0" for t in lex.QUERY_TOPIC_KEYWORDS)}""")
def _(d):
    pairs = [F.struct(F.lit(t).alias("topic"), joined(tx.contained_keywords("text", ws)).alias("keywords"))
             for t, ws in lex.QUERY_TOPIC_KEYWORDS.items()]
    return d.reviews.select("review_id", F.inline(F.array(*pairs))).where(F.col("keywords") != "")


def fitted(d: Tables) -> classifier.NaiveBayesModel:
    return classifier.fit(d.labeled.select("review_id", "text", "topic_label"), label="topic_label")


@query("a13_classifier_fit", f"WITH {NB} SELECT class, term, round(logp, 6) AS logp FROM nb_logp")
def _(d):
    model = fitted(d)
    seen = model.priors.scalar()
    rows = F.array(*[F.struct(F.lit(c).alias("class"), F.get("logp", F.lit(i)).alias("logp"), F.get("p", F.lit(i)).alias("prior"))
                     for i, c in enumerate(model.classes)])
    flat = model.terms.withColumn("p", seen).select("term", F.inline(rows)).where(F.col("prior").isNotNull())
    return flat.select("class", "term", r6("logp").alias("logp"))


@query("a13_classifier_priors", f"""WITH {REVIEWS}, {LABELED} SELECT topic_label AS class,
  round(ln(count(*) / (SELECT count(*) FROM labeled)), 6) AS prior FROM labeled GROUP BY topic_label""")
def _(d):
    model = fitted(d)
    rows = F.array(*[F.struct(F.lit(c).alias("class"), F.get("priors", F.lit(i)).alias("prior")) for i, c in enumerate(model.classes)])
    return model.priors.select(F.inline(rows)).where(F.col("prior").isNotNull()).withColumn("prior", r6("prior"))


@query("a13_fit_summary", f"""WITH {NB} SELECT (SELECT count(*) FROM labeled) AS n_samples, (SELECT count(*) FROM nbt_vocab) AS n_features,
  (SELECT string_agg(class, '|' ORDER BY class) FROM nb_prior) AS classes""")
def _(d):
    return classifier.fit_summary(fitted(d)).withColumn("classes", joined("classes"))


@query("m03_classify", f"WITH {NB} SELECT review_id, predicted_topic, round(confidence, 6) AS confidence FROM nb_predicted")
def _(d):
    return classifier.predict(d.reviews, fitted(d)).select("review_id", "predicted_topic", r6("confidence").alias("confidence"))


@query("m04_top_features", f"WITH {REVIEWS} SELECT review_id, '' AS top_features FROM reviews")
def _(d):
    return classifier.predict(d.reviews, fitted(d)).select("review_id", joined("top_features").alias("top_features"))


LEAD = f"""{NB}, lead_of AS (
  SELECT w.review_id, w.term, w.weight * (l.logp - m.mean) AS lead FROM nba_w w JOIN nb_predicted p USING (review_id)
  JOIN nb_logp l ON l.term = w.term AND l.class = p.predicted_topic
  JOIN (SELECT term, avg(logp) AS mean FROM nb_logp GROUP BY term) m ON m.term = w.term),
lead_rank AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY round(lead, 9) DESC, term) AS rank FROM lead_of WHERE lead > 0)"""


@query("w04_explain_features", f"WITH {LEAD} SELECT review_id, term, rank, round(lead, 6) AS lead FROM lead_rank WHERE rank <= 3")
def _(d):
    return classifier.explain_features(d.reviews, fitted(d)).select("review_id", "term", big("rank").alias("rank"), r6("lead").alias("lead"))


@query("j01_reviews_with_topics", f"""WITH {NB} SELECT review_id, rating, predicted_topic, round(confidence, 6) AS confidence
FROM reviews JOIN nb_predicted USING (review_id)""")
def _(d):
    topics = classifier.predict(d.reviews, fitted(d))
    return d.reviews.join(topics, "review_id").select("review_id", "rating", "predicted_topic", r6("confidence").alias("confidence"))


def scored_of(d: Tables):
    """Predictions grouped by product; each product asks for a topic of its own."""
    number = F.substring("product_id", 4, 10).cast("int") % 7
    target = F.get(tx.string_array(lex.TOPICS), number)
    topics = classifier.predict(d.reviews, fitted(d))
    return d.reviews.join(topics, "review_id").select(F.col("product_id").alias("query_id"), "review_id", "predicted_topic", "confidence",
                                                     target.alias("target_topic"))


@query("p10_topic_filter", f"""WITH {SCORED} SELECT query_id, review_id, round(confidence, 6) AS confidence FROM scored
WHERE predicted_topic = target_topic AND confidence >= 0.5""")
def _(d):
    kept = classifier.topic_filter(materialize(scored_of(d), "scored")).where("kept")
    return kept.select("query_id", "review_id", r6("confidence").alias("confidence"))


@query("p11_fallback", f"""WITH {SCORED}, f AS (
  SELECT *, max(CASE WHEN predicted_topic = target_topic AND confidence >= 0.9 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS any_kept FROM scored)
SELECT query_id, review_id, any_kept = 0 AS fallback_used FROM f
WHERE any_kept = 0 OR (predicted_topic = target_topic AND confidence >= 0.9)""")
def _(d):
    flagged = classifier.topic_filter(materialize(scored_of(d), "scored"), min_confidence=0.9)
    return flagged.where(F.col("kept") | F.col("fallback_used")).select("query_id", "review_id", "fallback_used")


@query("a03_topic_distribution", f"WITH {SCORED} SELECT query_id, predicted_topic, count(*) AS n FROM scored GROUP BY query_id, predicted_topic")
def _(d):
    return classifier.topic_distribution(scored_of(d))


@query("a39_fallback_diagnosis", f"""WITH {SCORED} SELECT query_id, count(*) FILTER (WHERE predicted_topic = target_topic) AS on_topic,
  count(*) FILTER (WHERE predicted_topic = target_topic AND confidence < 0.9) AS below_confidence FROM scored GROUP BY query_id""")
def _(d):
    return classifier.fallback_diagnosis(scored_of(d), min_confidence=0.9)


def report_sql(pairs: str) -> str:
    return f"""classes AS (SELECT label AS name FROM {pairs} UNION SELECT predicted FROM {pairs}),
per AS (
  SELECT name, (SELECT count(*) FROM {pairs} p WHERE p.label = c.name) AS support,
    (SELECT count(*) FROM {pairs} p WHERE p.predicted = c.name) AS claimed,
    (SELECT count(*) FROM {pairs} p WHERE p.label = c.name AND p.predicted = c.name) AS hit FROM classes c),
pr AS (SELECT name, support, hit, coalesce(hit / nullif(claimed, 0), 0) AS p, coalesce(hit / nullif(support, 0), 0) AS r FROM per),
f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM pr)
SELECT name, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, support FROM f
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'accuracy', round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6),
  CAST(sum(support) AS BIGINT) FROM f"""


def rounded_report(pairs):
    return evaluation.class_report(pairs).withColumns({c: r6(c) for c in ("precision", "recall", "f1")})


@query("a22_class_report", f"""WITH pairs AS (SELECT CAST(quality AS VARCHAR) AS label,
  CASE WHEN n_chars > 500 THEN '1' WHEN n_chars > 100 THEN '0' ELSE 'unsure' END AS predicted FROM documents JOIN labels USING (doc_id)),
{report_sql('pairs')}""")
def _(d):
    guess = F.when(F.col("n_chars") > 500, "1").when(F.col("n_chars") > 100, "0").otherwise("unsure")
    pairs = d.table("documents").join(d.table("labels"), "doc_id").select(F.col("quality").cast("string").alias("label"), guess.alias("predicted"))
    return rounded_report(pairs)


@query("a22_accuracy", f"""SELECT round(avg(CASE WHEN (n_chars > 500) = (quality = 1) THEN 1 ELSE 0 END), 6) AS accuracy
FROM documents JOIN labels USING (doc_id)""")
def _(d):
    pairs = d.table("documents").join(d.table("labels"), "doc_id").select(
        F.col("quality").alias("label"), (F.col("n_chars") > 500).cast("int").alias("predicted"))
    return evaluation.accuracy(pairs).withColumn("accuracy", r6("accuracy"))


@query("m15_evaluation", f"""WITH {REVIEWS}, gold AS (
  SELECT r.*, CAST(quality AS VARCHAR) AS label, (doc_id * 7919 + 42) % 100003 % 100 < 80 AS train FROM reviews r JOIN labels USING (doc_id)),
trained AS (SELECT * FROM gold WHERE train), tested AS (SELECT * FROM gold WHERE NOT train),
{classifier_ctes('trained', 'tested', ['0', '1'], 'label')},
pairs AS (SELECT label, predicted_topic AS predicted FROM tested JOIN nb_predicted USING (review_id)),
{report_sql('pairs')}""")
def _(d):
    """Fit on 80 % of the labelled documents, report on the rest; the split is arithmetic so that SQL can repeat it."""
    gold = d.reviews.join(d.table("labels"), "doc_id").withColumn("label", F.col("quality").cast("string"))
    train = shuffle_key()[0] % 100 < 80
    model = classifier.fit(gold.where(train).select("review_id", "text", "label"), classes=["0", "1"])
    tested = gold.where(~train)
    pairs = classifier.predict(tested, model).join(tested.select("review_id", "label"), "review_id")
    return rounded_report(pairs.select("label", F.col("predicted_topic").alias("predicted")))


@query("m15_gold_set", f"""WITH {REVIEWS}, {LABELED}, {CURATED}, tested AS (SELECT review_id, text, verified_topic AS label FROM curated WHERE verified_topic IS NOT NULL),
trained AS (SELECT review_id, text, topic_label AS label FROM labeled WHERE review_id NOT IN (SELECT review_id FROM tested)),
{classifier_ctes('trained', 'tested', lex.TOPICS, 'label')},
pairs AS (SELECT label, predicted_topic AS predicted FROM tested JOIN nb_predicted USING (review_id)),
{report_sql('pairs')}""")
def _(d):
    """Fit on the whole training set without the verified reviews, report on these."""
    gold = materialize(corpus.gold_set(curated_from(d.labeled)).select("review_id", "text", "label"), "gold")
    training = corpus.training_set(d.labeled, "full").select("review_id", "text", "label").join(gold.select("review_id"), "review_id", "left_anti")
    pairs = classifier.predict(gold, classifier.fit(training)).join(gold.select("review_id", "label"), "review_id")
    return rounded_report(pairs.select("label", F.col("predicted_topic").alias("predicted")))
