"""Probability tables and model overviews."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from voxtable.functions import lexicons as lex
from voxtable.operators import probability
from voxtable.plans.catalogue.base import *  # noqa: F403
from voxtable.plans.catalogue.base import query
from voxtable.sources import models

EVIDENCE = f"""{REVIEWS}, {LABELED}, evidence AS (
  SELECT l.review_id, l.topic_label AS topic, CASE WHEN g.toxic = 1 THEN 'negative' WHEN rating >= 4 THEN 'positive'
    WHEN rating <= 2 THEN 'negative' ELSE 'neutral' END AS sentiment,
    CASE WHEN rating <= 2 THEN 'low' WHEN rating = 3 THEN 'medium' ELSE 'high' END AS rating_category, g.doc_id IS NOT NULL AS held
  FROM labeled l LEFT JOIN labels g USING (doc_id)),
n_t AS (SELECT topic, count(*) AS n FROM evidence GROUP BY topic),
n_s AS (SELECT sentiment, count(*) AS n FROM evidence GROUP BY sentiment),
p_t AS (SELECT topic, n / (SELECT count(*) FROM evidence) AS p FROM n_t),
p_s AS (SELECT e.topic, e.sentiment, count(*) / any_value(n_t.n) AS p FROM evidence e JOIN n_t USING (topic) GROUP BY e.topic, e.sentiment),
p_r AS (SELECT e.sentiment, e.rating_category, count(*) / any_value(n_s.n) AS p FROM evidence e JOIN n_s USING (sentiment)
  GROUP BY e.sentiment, e.rating_category)"""


def evidence(d: Tables):
    """Labelled reviews; a toxic label makes the sentiment negative whatever the rating."""
    marked = d.labeled.join(d.table("labels"), "doc_id", "left")
    return marked.select("review_id", "rating", F.col("topic_label").alias("topic"),
                         F.when(F.col("toxic") == 1, "negative").alias("sentiment"), F.col("toxic").isNotNull().alias("held"))


@query("a14_probability_tables", f"""WITH {EVIDENCE}
SELECT 'topic' AS table_name, '' AS parent, topic AS state, round(p, 6) AS p FROM p_t
UNION ALL SELECT 'sentiment', topic, sentiment, round(p, 6) FROM p_s
UNION ALL SELECT 'rating_category', sentiment, rating_category, round(p, 6) FROM p_r""")
def _(d):
    return probability.all_tables(probability.fit(evidence(d))).withColumn("p", r6("p"))


FOUR = ["p_positive_given_topic", "p_negative_given_topic", "p_high_rating_given_positive", "p_low_rating_given_negative"]
INSIGHTS = f"""topics(topic) AS (VALUES {', '.join(f"('{t}')" for t in lex.TOPICS)}),
insights AS (
  SELECT t.topic, CASE WHEN n_t.n IS NULL THEN 0.5 ELSE coalesce((SELECT p FROM p_s WHERE p_s.topic = t.topic AND sentiment = 'positive'), 0) END AS {FOUR[0]},
    CASE WHEN n_t.n IS NULL THEN 0.5 ELSE coalesce((SELECT p FROM p_s WHERE p_s.topic = t.topic AND sentiment = 'negative'), 0) END AS {FOUR[1]},
    coalesce((SELECT p FROM p_r WHERE sentiment = 'positive' AND rating_category = 'high'), 0.5) AS {FOUR[2]},
    coalesce((SELECT p FROM p_r WHERE sentiment = 'negative' AND rating_category = 'low'), 0.5) AS {FOUR[3]}
  FROM topics t LEFT JOIN n_t USING (topic))"""


@query("m07_insights", f"WITH {EVIDENCE}, {INSIGHTS} SELECT topic, {', '.join(f'round({c}, 6) AS {c}' for c in FOUR)} FROM insights")
def _(d):
    return probability.insights(probability.fit(evidence(d))).withColumns({c: r6(c) for c in FOUR})


@query("a38_neutral_share", f"""WITH {EVIDENCE}, {INSIGHTS}
SELECT topic, round(greatest(0, 1 - {FOUR[0]} - {FOUR[1]}), 6) AS p_neutral_given_topic FROM insights""")
def _(d):
    rows = probability.with_neutral(probability.insights(probability.fit(evidence(d))))
    return rows.select("topic", r6("p_neutral_given_topic").alias("p_neutral_given_topic"))


@query("a38_rating_given_sentiment", f"WITH {EVIDENCE} SELECT sentiment, rating_category, round(p, 6) AS p FROM p_r")
def _(d):
    return probability.rating_given_sentiment(probability.fit(evidence(d))).withColumn("p", r6("p"))


CHAIN = f"""{EVIDENCE}, chain AS (
  SELECT p_s.topic, p_r.rating_category, sum(p_s.p * p_r.p) AS p FROM p_s JOIN p_r USING (sentiment) GROUP BY p_s.topic, p_r.rating_category)"""


@query("m08_rating_given_topic", f"WITH {CHAIN} SELECT topic, rating_category, round(p, 6) AS p FROM chain")
def _(d):
    return probability.rating_given_topic(probability.fit(evidence(d))).withColumn("p", r6("p"))


@query("m08_topic_given_rating", f"""WITH {CHAIN} SELECT rating_category, topic,
  round(c.p * t.p / sum(c.p * t.p) OVER (PARTITION BY rating_category), 6) AS p FROM chain c JOIN p_t t USING (topic)""")
def _(d):
    return probability.topic_given_rating(probability.fit(evidence(d))).withColumn("p", r6("p"))


# Each row is scored by tables that were fitted anew without its rows.
HELD_SQL = """SELECT {group}round(sum(ln(t.p * s.p * r.p)), 4) AS log_likelihood, count(*) AS n_rows, count(*) FILTER (WHERE s.p IS NULL OR r.p IS NULL) AS n_impossible
FROM {rows} e LEFT JOIN f_t t ON t.fold = e.fold AND t.topic = e.topic LEFT JOIN f_s s ON s.fold = e.fold AND s.topic = e.topic AND s.sentiment = e.sentiment
LEFT JOIN f_r r ON r.fold = e.fold AND r.sentiment = e.sentiment AND r.rating_category = e.rating_category"""


def fold_ctes(fold: str) -> str:
    """Tables fitted for every fold on all rows outside it."""
    return f"""{EVIDENCE}, folded AS (SELECT *, {fold} AS fold FROM evidence),
other AS (SELECT f.fold, e.topic, e.sentiment, e.rating_category FROM (SELECT DISTINCT fold FROM folded) f JOIN folded e ON e.fold <> f.fold),
f_t AS (SELECT fold, topic, count(*) / sum(count(*)) OVER (PARTITION BY fold) AS p FROM other GROUP BY fold, topic),
f_s AS (SELECT fold, topic, sentiment, count(*) / sum(count(*)) OVER (PARTITION BY fold, topic) AS p FROM other GROUP BY fold, topic, sentiment),
f_r AS (SELECT fold, sentiment, rating_category, count(*) / sum(count(*)) OVER (PARTITION BY fold, sentiment) AS p FROM other GROUP BY fold, sentiment, rating_category)"""


@query("a32_log_likelihood", f"WITH {fold_ctes('held::INTEGER')} {HELD_SQL.format(group='', rows='(SELECT * FROM folded WHERE held)')}")
def _(d):
    """Reviews with a label of their own under the tables of all others."""
    rows = evidence(d)
    ll = probability.log_likelihood(probability.fit(rows.where(~F.col("held"))), rows.where("held"))
    return ll.withColumn("log_likelihood", F.round("log_likelihood", 4))


@query("a32_cross_validation", f"WITH {fold_ctes('substr(review_id, 2)::BIGINT % 5')} {HELD_SQL.format(group='e.fold, ', rows='folded')} GROUP BY e.fold")
def _(d):
    """Five folds from one pass over the reviews."""
    counts = probability.fold_counts(evidence(d), F.substring("review_id", 2, 20).cast("bigint") % 5)
    return probability.cross_validated(counts).withColumn("log_likelihood", F.round("log_likelihood", 4))


def metadata_of(d: Tables):
    """One training record per language and one earlier record each, with real sizes."""
    sizes = d.reviews.groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("product_id").alias("p"))
    def record(day, n):
        return sizes.select(
            F.col("lang").alias("model"), F.lit(datetime(2024, 5, day, 12, 0, 0)).alias("trained_at"), F.lit("documents").alias("data_source"),
            n.alias("corpus_size"), F.create_map(F.lit("max_features"), F.lit("10000"), F.lit("alpha"), F.lit("1.0")).alias("params"),
            F.create_map(F.lit("products"), F.col("p").cast("string")).alias("metrics"))
    return record(1, F.lit(1).cast("bigint")).unionByName(record(2, F.col("n")))


@query("a36_model_overview", """SELECT lang AS model, count(*) AS corpus_size, 'alpha=1.0, max_features=10000' AS parameters,
  'products=' || count(DISTINCT source) AS metrics, '2024-05-02 12:00' AS trained, '2024-05-02 12:00' AS latest FROM documents GROUP BY lang""")
def _(d):
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    return models.model_overview(metadata_of(d)).select("model", "corpus_size", "parameters", "metrics", shown("trained_at").alias("trained"),
                                                        shown("latest_trained_at").alias("latest"))


@query("a37_retrain_trigger", f"""WITH m AS (SELECT lang AS model, count(*) AS corpus_size FROM documents GROUP BY lang),
c AS (SELECT lang AS model, count(*) AS current_size, avg(quality) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY lang)
SELECT model, corpus_size, current_size, round(abs(current_size - corpus_size) / corpus_size, 6) AS change, round(accuracy, 6) AS accuracy,
  abs(current_size - corpus_size) / corpus_size > 0.1 OR accuracy < 0.7 AS retrain FROM m JOIN c USING (model)""")
def _(d):
    kept = d.reviews.join(d.table("labels"), "doc_id")
    current = kept.groupBy(F.col("lang").alias("model")).agg(F.count("*").alias("current_size"), F.avg("quality").alias("accuracy"))
    meta = d.reviews.groupBy(F.col("lang").alias("model")).agg(F.count("*").alias("corpus_size"))
    return models.retrain_needed(meta, current).withColumns({"change": r6("change"), "accuracy": r6("accuracy")})
