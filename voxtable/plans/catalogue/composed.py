"""Whole query jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtable.functions import lexicons as lex
from voxtable.operators import probability, tfidf
from voxtable.plans import analyze
from voxtable.plans.catalogue.base import *  # noqa: F403
from voxtable.plans.catalogue.base import query
from voxtable.plans.catalogue.probabilities import EVIDENCE, FOUR, INSIGHTS, evidence
from voxtable.plans.catalogue.sequences import TRAINED, VITERBI, sequences_of, trained_hmm
from voxtable.plans.catalogue.topics import fitted
from voxtable.sources import models
from voxtable.sources.scratch import materialize, scratch_path

TOP_K = 500
_stored: dict = {}


def stored_models(d: Tables) -> str:
    """Folder of all models but the HMM, fitted and stored once per application and folder."""
    key = (d.spark.sparkContext.applicationId, d.folder)
    if key not in _stored:
        root = scratch_path(d.spark, "models")
        index = tfidf.fit(d.reviews)
        models.save_tfidf(index, f"{root}/tfidf", None, tfidf.transform(d.reviews, index, packed=True))
        models.save_classifier(fitted(d), f"{root}/classifier")
        models.save_probabilities(probability.fit(evidence(d)), f"{root}/probabilities")
        _stored[key] = root
    return _stored[key]


def loaded_models(d: Tables) -> analyze.Models:
    root = stored_models(d)
    return analyze.Models(models.load_tfidf(d.spark, f"{root}/tfidf"), models.load_postings(d.spark, f"{root}/tfidf"),
                          models.load_classifier(d.spark, f"{root}/classifier"), models.load_probabilities(d.spark, f"{root}/probabilities"),
                          trained_hmm(d), synonyms=d.synonyms, term_cache=d.term_cache, polarity=d.polarity)


def analysis_of(d: Tables) -> analyze.Analysis:
    """The whole job on models that were stored and loaded."""
    return analyze.analyze(d.queries, d.with_sentences, loaded_models(d), top_k=TOP_K, min_confidence=0.5)


ANALYSIS = f"""{INDEX}, {EXPANSION}, {FILTERED}, {score_ctes('filtered')}, {top_ctes('q_score', TOP_K)},
query_texts AS (SELECT query_id, query AS text FROM asked),
{label_ctes(lex.QUERY_TOPIC_KEYWORDS, 'query_texts', 'targets')},
{EVIDENCE.removeprefix(REVIEWS + ', ')}, {INSIGHTS},
{classifier_ctes('labeled', 'reviews', lex.TOPICS)},
candidates AS MATERIALIZED (
  SELECT k.query_id, k.review_id, k.rank, n.predicted_topic, n.confidence, t.topic_label AS target_topic,
    n.predicted_topic = t.topic_label AND n.confidence >= 0.5 AS kept
  FROM ranked k JOIN nb_predicted n USING (review_id) JOIN targets t USING (query_id)),
flagged AS (SELECT *, NOT bool_or(kept) OVER (PARTITION BY query_id) AS fallback_used FROM candidates),
analysed AS (SELECT * FROM flagged WHERE kept OR fallback_used)"""

SEQUENCES = f"{TRAINED.removeprefix(REVIEWS + ', ')}, {VITERBI}"


@query("m13_analyze_candidates", f"""WITH {ANALYSIS} SELECT query_id, review_id, rank, predicted_topic, round(confidence, 6) AS confidence, kept, fallback_used FROM flagged""")
def _(d):
    return analysis_of(d).candidates.select("query_id", "review_id", big("rank").alias("rank"), "predicted_topic",
                                            r6("confidence").alias("confidence"), "kept", "fallback_used")


@query("m13_analyze_distribution", f"WITH {ANALYSIS} SELECT query_id, predicted_topic, count(*) AS n FROM flagged GROUP BY query_id, predicted_topic")
def _(d):
    return analysis_of(d).distribution


@query("m13_analyze_insights", f"""WITH {ANALYSIS} SELECT query_id, i.topic, {', '.join(f'round({c}, 6) AS {c}' for c in FOUR)}
FROM targets t JOIN insights i ON i.topic = t.topic_label""")
def _(d):
    return analysis_of(d).insights.withColumns({c: r6(c) for c in FOUR})


@query("m13_analyze_sequences", f"""WITH RECURSIVE {ANALYSIS}, {SEQUENCES}
SELECT query_id, review_id, array_to_string(states, '|') AS states FROM analysed JOIN decoded USING (review_id)""")
def _(d):
    return analysis_of(d).sequences.select("query_id", "review_id", joined("sentiment_states").alias("states"))


SUMMARY = """'Analyzed ' || n || ' reviews for topic ''' || topic || '''. P(positive|topic)=' || printf('%.2f', pp) || ', P(negative|topic)='
  || printf('%.2f', pn) || '. Average rating is ' || printf('%.2f', rating) || '/5. Average sentiment-sequence length is '
  || printf('%.1f', length) || ' sentences.'"""


@query("m13_analyze_summary", f"""WITH {ANALYSIS}, {SENTENCES}, s AS (
  SELECT a.query_id, count(*) AS n, avg(r.rating) AS rating, avg(len(s.sentences)) AS length
  FROM analysed a JOIN reviews r USING (review_id) JOIN sents s USING (review_id) GROUP BY a.query_id),
full_rows AS (SELECT q.query_id, s.n, s.rating, s.length, i.topic, i.{FOUR[0]} AS pp, i.{FOUR[1]} AS pn
  FROM targets q JOIN insights i ON i.topic = q.topic_label LEFT JOIN s ON s.query_id = q.query_id)
SELECT query_id, CASE WHEN n > 0 THEN {SUMMARY} ELSE 'No matching reviews found for the current filters and query.' END AS summary FROM full_rows""")
def _(d):
    return analysis_of(d).summary


@query("m14_prompt_table", f"""WITH RECURSIVE {ANALYSIS}, {SEQUENCES},
numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM analysed),
lines AS (
  SELECT n.query_id, string_agg('[' || repeat('*', r.rating) || '] ' || CASE WHEN length(r.text) > 300 THEN substr(r.text, 1, 300) || '...' ELSE r.text END,
    chr(10) || chr(10) ORDER BY i) AS reviews FROM numbered n JOIN reviews r USING (review_id) WHERE i <= 10 GROUP BY n.query_id),
seqs5 AS (
  SELECT query_id, string_agg(review_id || ': ' || array_to_string(states, ','), chr(10) ORDER BY i) AS sequences
  FROM numbered JOIN decoded USING (review_id) WHERE i <= 5 GROUP BY query_id),
sizes AS (SELECT query_id, count(*) AS n FROM analysed GROUP BY query_id)
SELECT z.query_id, 'Review count: ' || n || chr(10) || 'Topic: ' || i.topic || chr(10) || 'P(positive|topic): ' || printf('%.4f', i.{FOUR[0]}) || chr(10)
  || 'P(negative|topic): ' || printf('%.4f', i.{FOUR[1]}) || chr(10) || 'P(high_rating|positive): ' || printf('%.4f', i.{FOUR[2]}) || chr(10)
  || 'P(low_rating|negative): ' || printf('%.4f', i.{FOUR[3]}) AS statistics, coalesce(sequences, '') AS sequences, reviews
FROM sizes z JOIN targets t USING (query_id) JOIN insights i ON i.topic = t.topic_label JOIN lines USING (query_id) LEFT JOIN seqs5 USING (query_id)""")
def _(d):
    return analyze.prompt_table(analysis_of(d))


@query("a19_summary", f"""WITH {EVIDENCE}, {INSIGHTS}, {SENTENCES}, full_rows AS (
  SELECT l.product_id AS query_id, count(*) AS n, avg(l.rating) AS rating, avg(len(s.sentences)) AS length, any_value(i.topic) AS topic,
    any_value(i.{FOUR[0]}) AS pp, any_value(i.{FOUR[1]}) AS pn
  FROM reviews l JOIN sents s USING (review_id)
  JOIN insights i ON i.topic = {sql_list(lex.TOPICS)}[1 + CAST(substr(l.product_id, 4) AS INTEGER) % 7] GROUP BY l.product_id)
SELECT query_id, {SUMMARY} AS summary FROM full_rows""")
def _(d):
    number = F.substring("product_id", 4, 10).cast("int") % 7
    from voxtable.functions import text as tx

    rows = d.reviews.withColumn("query_id", F.col("product_id")).withColumn("target_topic", F.get(tx.string_array(lex.TOPICS), number))
    products = rows.select("query_id", "target_topic").distinct()
    insights = analyze.query_insights(products, probability.fit(evidence(d)))
    sequences = sequences_of(d).join(rows.select("review_id", "query_id"), "review_id")
    return analyze.summaries(products, rows, insights, sequences)
