"""Corpus profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtable.functions import lexicons as lex, text as tx
from voxtable.operators import labeling, profiling, quality, sampling
from voxtable.operators.rows import exploded
from voxtable.plans.catalogue.base import *  # noqa: F403
from voxtable.plans.catalogue.base import query
from voxtable.plans.catalogue.cleaning import HITS, W02


@query("a01_rating_distribution", f"WITH {REVIEWS} SELECT rating, count(*) AS n FROM reviews GROUP BY rating")
def _(d):
    return profiling.rating_distribution(d.reviews)


@query("a02_corpus_stats", f"""WITH {REVIEWS} SELECT count(*) AS total_reviews, round(avg(length(text)), 6) AS avg_text_length,
  true AS has_sentences FROM reviews""")
def _(d):
    return profiling.corpus_stats(d.with_sentences).withColumn("avg_text_length", r6("avg_text_length"))


@query("a04_label_distribution", f"""WITH {REVIEWS}, {LABELED}
SELECT topic_label, count(*) AS n, round(count(*) / (SELECT count(*) FROM reviews) * 100, 6) AS pct FROM labeled GROUP BY topic_label""")
def _(d):
    return labeling.label_distribution(d.labeled).withColumn("pct", r6("pct"))


def _stats(x: str, unit: str) -> str:
    return f"""SELECT '{unit}' AS unit, round(avg({x}), 6) AS mean, median({x})::DOUBLE AS median, min({x})::DOUBLE AS min,
  max({x})::DOUBLE AS max, round(stddev_samp({x}), 6) AS std FROM s"""


@query("a05_length_stats", f"""WITH {REVIEWS}, s AS (SELECT length(text) AS c, len({sql_words('text')}) AS w FROM reviews)
{_stats('c', 'characters')} UNION ALL {_stats('w', 'words')}""")
def _(d):
    return profiling.length_stats(d.reviews).withColumns({"mean": r6("mean"), "std": r6("std")})


@query("a06_vocabulary", f"""WITH {REVIEWS}, w AS (SELECT unnest({sql_latin('text', 3)}) AS word FROM reviews)
SELECT word, count(*) AS n FROM w WHERE word NOT IN ({quoted(lex.VOCABULARY_STOP_WORDS)}) GROUP BY word ORDER BY n DESC, word LIMIT 50""")
def _(d):
    return profiling.vocabulary(d.reviews)


@query("a07_phrases", f"""WITH {REVIEWS}, t AS (SELECT {sql_latin('text')} AS ws FROM reviews),
p AS (SELECT unnest({sql_ngrams('ws', 2)}) AS phrase FROM t), c AS (SELECT phrase, count(*) AS n FROM p GROUP BY phrase)
SELECT phrase, n FROM c WHERE len(list_filter(string_split(phrase, ' '), lambda w: w NOT IN ({quoted(lex.PHRASE_STOP_WORDS)}))) > 0
ORDER BY n DESC, phrase LIMIT 30""")
def _(d):
    return profiling.common_phrases(d.reviews)


@query("a07_phrases_of_three", f"""WITH {REVIEWS}, t AS (SELECT {sql_latin('text')} AS ws FROM reviews),
p AS (SELECT unnest({sql_ngrams('ws', 3)}) AS phrase FROM t), c AS (SELECT phrase, count(*) AS n FROM p GROUP BY phrase)
SELECT phrase, n FROM c WHERE len(list_filter(string_split(phrase, ' '), lambda w: w NOT IN ({quoted(lex.PHRASE_STOP_WORDS)}))) > 0
ORDER BY n DESC, phrase LIMIT 30""")
def _(d):
    return profiling.common_phrases(d.reviews, n=3)


CORPUS_GROUPS = {"thon": ["thing", "than-and", "thre"], "que": ["des", "les"], "nicht": ["und", "mit", "free"]}


def _group_sql() -> str:
    rows = []
    for g, ts in CORPUS_GROUPS.items():
        for t in [g, *ts]:
            rows.append(f"SELECT '{g}' AS primary_term, '{t}' AS term, count(*) AS n FROM reviews WHERE {sql_has_word('text', t)}")
    return " UNION ALL ".join(rows)


@query("a08_group_frequencies", f"""WITH {REVIEWS}, c AS ({_group_sql()})
SELECT *, CAST(sum(n) OVER (PARTITION BY primary_term) AS BIGINT) AS group_total FROM c""")
def _(d):
    return profiling.group_frequencies(d.reviews, CORPUS_GROUPS)


@query("a08_default_groups", "WITH " + REVIEWS + ", c AS (" + " UNION ALL ".join(
    f"SELECT '{g}' AS primary_term, '{t}' AS term, count(*) AS n FROM reviews WHERE {sql_has_word('text', t)}"
    for g, ts in lex.SYNONYM_GROUPS.items() for t in [g, *ts]) + """)
SELECT *, CAST(sum(n) OVER (PARTITION BY primary_term) AS BIGINT) AS group_total FROM c""")
def _(d):
    return profiling.group_frequencies(d.reviews)


@query("a09_term_frequencies", f"""WITH {REVIEWS}, {HITS}
SELECT term, count(*) AS n, round(count(*) / (SELECT count(*) FROM reviews) * 100, 6) AS pct FROM hits GROUP BY term""")
def _(d):
    return profiling.term_frequencies(d.reviews, CORPUS_TERMS).withColumn("pct", r6("pct")).orderBy(F.desc("n"), "term")


@query("a10_term_ratings", f"""WITH {REVIEWS}, {HITS}
SELECT term, rating, count(*) AS n, round((SELECT avg(h.rating) FROM hits h WHERE h.term = hits.term), 6) AS avg_rating
FROM hits GROUP BY term, rating""")
def _(d):
    return profiling.term_ratings(d.reviews, CORPUS_TERMS).withColumn("avg_rating", r6("avg_rating"))


@query("a11_cooccurrence", f"""WITH {REVIEWS}, hits AS (
  {' UNION ALL '.join(f"SELECT review_id, text, '{t}' AS term FROM reviews WHERE {sql_has_word('text', t)}" for t in ('thon', 'que', 'nicht'))}),
t AS (SELECT term, {sql_runs('text')} AS ws FROM hits),
e AS (SELECT term, ws, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t),
near AS (SELECT unnest(ws[greatest(i - 5, 1):least(i + 5, len(ws))]) AS word FROM e WHERE contains(w, term))
SELECT word, count(*) AS n FROM near WHERE regexp_full_match(word, '[a-z]{{3,}}')
  AND word NOT IN ({quoted(lex.CONTEXT_STOP_WORDS)}) AND word NOT IN ('thon', 'que', 'nicht')
GROUP BY word ORDER BY n DESC, word LIMIT 15""")
def _(d):
    return profiling.cooccurring_words(d.reviews, ["thon", "que", "nicht"])


@query("a18_mean_sentences", f"WITH {REVIEWS}, {SENTENCES} SELECT round(avg(len(sentences)), 6) AS mean_sentences FROM sents")
def _(d):
    return d.with_sentences.agg(r6(F.avg(F.size("sentences"))).alias("mean_sentences"))


@query("a20_validation", f"""WITH {REVIEWS}, {LABELED}, {W02}, s AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY rating ORDER BY {SHUFFLE}) AS rn FROM reviews) WHERE rn <= 20),
shares AS (SELECT count(*) / sum(count(*)) OVER () AS share FROM labeled GROUP BY topic_label)
SELECT unnest(['raw_exists', 'corpus_exists', 'sample_exists', 'labeled_exists', 'curated_exists', 'sentences_column', 'sentences_json']) AS name,
  true AS passed, false AS is_warning
UNION ALL SELECT 'corpus_size', count(*) >= 10000, false FROM reviews
UNION ALL SELECT 'sample_balance', true, NOT (count(*) = 100) FROM s
UNION ALL SELECT 'topic_distribution', true, max(share) > 0.5 FROM shares
UNION ALL SELECT 'curated_size', count(*) >= 100, false FROM w02""")
def _(d):
    stored = d.with_sentences.withColumn("sentences", F.to_json("sentences"))
    report = quality.validation_report(
        d.spark, d.reviews, stored, sampling.rating_sample(d.reviews, order=shuffle_key()), d.labeled,
        labeling.curation_table(sampling.curation_sample(d.labeled, order=shuffle_key())))
    return report.select("name", "passed", "is_warning")


@query("a21_dominant_label", f"""WITH {REVIEWS}, {LABELED}, c AS (SELECT topic_label, count(*) AS n FROM labeled GROUP BY topic_label)
SELECT topic_label AS dominant_label, n, round(n / (SELECT sum(n) FROM c), 6) AS share FROM c ORDER BY n DESC, topic_label LIMIT 1""")
def _(d):
    return labeling.dominant_label(d.labeled).withColumn("share", r6("share"))


@query("t03_most_common", f"""WITH {REVIEWS}, w AS (SELECT unnest({sql_runs('text', 2)}) AS word FROM reviews)
SELECT word, count(*) AS n FROM w GROUP BY word ORDER BY n DESC, word LIMIT 20""")
def _(d):
    return profiling.top_counts(exploded(d.reviews, [], tx.search_tokens("text"), "word"), "word", 20)


@query("t05_first_rows", f"""WITH {REVIEWS} SELECT product_id, review_id FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY review_id) AS rn FROM reviews) WHERE rn <= 5""")
def _(d):
    return sampling.per_group(d.reviews, "product_id", 5, ["review_id"]).select("product_id", "review_id")
