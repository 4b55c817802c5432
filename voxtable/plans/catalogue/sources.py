"""Readers, writers, stages and model tables."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, functions as F

from voxtable.functions import lexicons as lex, text as tx
from voxtable.operators import classifier, cleaning, expansion, labeling, sampling, tfidf
from voxtable.plans import prepare as preparing, train
from voxtable.plans.catalogue.base import *  # noqa: F403
from voxtable.plans.catalogue.base import query
from voxtable.plans.catalogue.sequences import VITERBI, trained_ctes, trained_hmm
from voxtable.sources import corpus, models, schemas, sinks
from voxtable.sources.scratch import materialize, scratch_path
from voxtable.sources.stage import run_stage
from voxtable.streaming import scoring


def landed_json(d: Tables, ordered: bool = False) -> str:
    """The documents as raw JSON lines, with a field the ingest does not want."""
    path = scratch_path(d.spark, "raw-json")
    rows = d.reviews.orderBy("doc_id") if ordered else d.reviews
    rows.select("text", "rating", "title", F.col("product_id").alias("parent_asin"), F.col("lang").alias("unused")) \
        .write.json(path)
    return path


@query("s01_ingest_json", f"WITH {REVIEWS} SELECT text, rating, title, product_id FROM reviews")
def _(d):
    return corpus.ingest_json_lines(d.spark, landed_json(d))


@query("s02_surrogate_id", f"""WITH {REVIEWS}
SELECT printf('R%06d', row_number() OVER (ORDER BY doc_id) - 1) AS review_id, text, rating FROM reviews""")
def _(d):
    return corpus.ingest_with_ids(d.spark, landed_json(d, ordered=True)).select("review_id", "text", "rating")


@query("s03_csv_scan", f"WITH {REVIEWS} SELECT review_id, text, rating, title, product_id FROM reviews")
def _(d):
    path = scratch_path(d.spark, "reviews-csv")
    sinks.write_csv(d.reviews.select("review_id", "text", "rating", "title", "product_id"), path)
    return corpus.read_csv(d.spark, path)


@query("s04_choose_corpus", f"""WITH {REVIEWS}
SELECT 'sample' AS chosen, review_id FROM (
  SELECT review_id, row_number() OVER (PARTITION BY rating ORDER BY {SHUFFLE}) AS rn FROM reviews) WHERE rn <= 20
UNION ALL SELECT 'main', review_id FROM reviews""")
def _(d):
    main, sample = scratch_path(d.spark, "main") + ".parquet", scratch_path(d.spark, "sample") + ".parquet"
    sinks.write_parquet(d.reviews, main)
    sinks.write_parquet(sampling.rating_sample(d.reviews, order=shuffle_key()), sample)
    pick = lambda flag: corpus.load_reviews(d.spark, main, sample, sample=flag)
    return pick(True).select(F.lit("sample").alias("chosen"), "review_id").unionByName(
        pick(False).select(F.lit("main").alias("chosen"), "review_id"))


@query("s05_limit_on_read", f"""WITH {REVIEWS}
SELECT 50 AS asked, review_id FROM (SELECT review_id FROM reviews ORDER BY review_id LIMIT 50)
UNION ALL SELECT 0, review_id FROM reviews""")
def _(d):
    main = scratch_path(d.spark, "main") + ".parquet"
    sinks.write_parquet(d.reviews, main)
    read = lambda n: corpus.load_reviews(d.spark, main, limit=n).select(F.lit(n).alias("asked"), "review_id")
    return read(50).unionByName(read(0))


@query("s06_typed_projection", f"""WITH {REVIEWS}
SELECT review_id, text, rating, '' AS title, product_id, NULL::VARCHAR AS topic FROM reviews""")
def _(d):
    loose = d.reviews.select("review_id", "text", (F.col("rating") + 0.7).alias("rating"), "product_id")
    return corpus.typed_reviews(loose).drop("sentences")


@query("s07_decode_sentences", f"""WITH {REVIEWS}, {SENTENCES}
SELECT review_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE len(sentences) END AS n_sentences,
  CASE WHEN doc_id % 7 = 0 THEN NULL ELSE array_to_string(sentences, '|') END AS sentences FROM sents""")
def _(d):
    stored = F.to_json(tx.sentences("text"))
    broken = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("not json "), stored)).otherwise(stored)
    decoded = d.reviews.select("review_id", broken.alias("stored")).withColumn("decoded", corpus.decoded_sentences("stored"))
    return decoded.select("review_id", big(F.when(F.col("decoded").isNotNull(), F.size("decoded"))).alias("n_sentences"),
                          F.when(F.col("decoded").isNotNull(), joined("decoded")).alias("sentences"))


@query("s08_decode_topic", f"""WITH {REVIEWS}
SELECT review_id, CASE WHEN CAST(substr(product_id, 4) AS INTEGER) < 7
  THEN {sql_list(lex.TOPICS)}[CAST(substr(product_id, 4) AS INTEGER) + 1] END AS topic FROM reviews""")
def _(d):
    number = F.substring("product_id", 4, 10).cast("int")
    stored = F.coalesce(F.get(tx.string_array(lex.TOPICS), number), F.col("product_id"))
    return d.reviews.select("review_id", labeling.known_topic(stored).alias("topic"))


def curated_from(labeled: DataFrame) -> DataFrame:
    """Curation rows of all high-confidence reviews; two thirds of them verified."""
    verdict = F.when(F.col("doc_id") % 3 == 0, F.col("topic_label")).when(F.col("doc_id") % 3 == 1, "other")
    rows = sampling.high_confidence(labeled).withColumn("verdict", verdict)
    return rows.select("review_id", "text", "rating", "title", "product_id", F.col("topic_label").alias("auto_topic"),
                       F.col("confidence_score"), F.to_json("matched_keywords").alias("matched_keywords"),
                       F.col("verdict").alias("verified_topic"), F.lit(None).cast("string").alias("notes"))


CURATED = """curated AS (
  SELECT doc_id, review_id, text, rating, topic_label AS auto_topic, confidence_score, matched_keywords,
    CASE doc_id % 3 WHEN 0 THEN topic_label WHEN 1 THEN 'other' END AS verified_topic
  FROM labeled WHERE confidence_score >= 2 AND topic_label <> 'other')"""


@query("s09_labeled_load", f"""WITH {REVIEWS}, {LABELED}, {CURATED}
SELECT 'curated' AS chosen, review_id, verified_topic AS label FROM curated WHERE verified_topic IS NOT NULL
UNION ALL SELECT 'labeled', review_id, topic_label FROM labeled""")
def _(d):
    labeled, curated = scratch_path(d.spark, "labeled") + ".parquet", scratch_path(d.spark, "curated") + ".parquet"
    sinks.write_parquet(d.labeled, labeled)
    sinks.write_parquet(curated_from(d.labeled), curated)
    load = lambda use: corpus.load_labeled_reviews(d.spark, labeled, curated, use).select(
        F.lit("curated" if use else "labeled").alias("chosen"), "review_id", "label")
    return load(True).unionByName(load(False))


@query("s10_training_set", f"""WITH {REVIEWS}, {LABELED}
SELECT review_id, topic_label AS label FROM labeled ORDER BY review_id LIMIT 5000""")
def _(d):
    return corpus.training_set(d.labeled).select("review_id", "label")


@query("s11_gold_set", f"""WITH {REVIEWS}, {LABELED}, {CURATED}
SELECT review_id, verified_topic AS label FROM curated WHERE verified_topic IS NOT NULL""")
def _(d):
    return corpus.gold_set(curated_from(d.labeled)).select("review_id", "label")


@query("s12_csv_sink", f"""WITH {REVIEWS}, {SENTENCES}
SELECT review_id, array_to_string(sentences, '|') AS sentences, len(sentences) AS sentence_count FROM sents""")
def _(d):
    path = scratch_path(d.spark, "tokenized-csv")
    rows = cleaning.with_sentences(d.reviews).select("review_id", "text", "rating", "title", "product_id", "sentences", "sentence_count")
    sinks.write_csv(rows, path)
    back = corpus.read_csv(d.spark, path, schemas.TOKENIZED)
    return back.select("review_id", joined(corpus.decoded_sentences("sentences")).alias("sentences"),
                       big("sentence_count").alias("sentence_count"))


@query("s13_idempotent_stage", """SELECT true AS first_run, false AS second_run, true AS forced_run, count(*) AS n FROM documents""")
def _(d):
    path = scratch_path(d.spark, "stage")
    fewer = lambda: d.reviews.where(F.col("rating") > 5)
    first = run_stage(d.spark, path, fewer, sinks.write_parquet)
    second = run_stage(d.spark, path, lambda: d.reviews, sinks.write_parquet)
    forced = run_stage(d.spark, path, lambda: d.reviews, sinks.write_parquet, force=True)
    return d.spark.read.parquet(path).agg(F.count("*").alias("n")).select(
        F.lit(first).alias("first_run"), F.lit(second).alias("second_run"), F.lit(forced).alias("forced_run"), "n")


@query("s14_prepare", f"""WITH {REVIEWS}, {CLEAN}, {label_ctes(CORPUS_LEXICON, 'cleaned')}
SELECT 'raw' AS stage, count(*) AS n FROM reviews
UNION ALL SELECT 'clean', count(*) FROM cleaned
UNION ALL SELECT 'main', count(*) FROM cleaned
UNION ALL SELECT 'sample', CAST(sum(least(n, 20)) AS BIGINT) FROM (SELECT count(*) AS n FROM cleaned GROUP BY rating)
UNION ALL SELECT 'labeled', count(*) FROM labeled
UNION ALL SELECT 'curated', CAST(sum(least(n, 50)) AS BIGINT) FROM (
  SELECT count(*) AS n FROM labeled WHERE confidence_score >= 2 AND topic_label <> 'other' GROUP BY topic_label)""")
def _(d):
    root = scratch_path(d.spark, "prepared")
    ran = preparing.prepare(d.spark, landed_json(d, ordered=True), root, lexicon=CORPUS_LEXICON)
    parts = [d.spark.read.parquet(f"{root}/{name}.parquet").agg(F.count("*").alias("n")).select(F.lit(name).alias("stage"), "n")
             for name in ran]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("s15_term_cache", f"""WITH {TERM_CACHE}
SELECT term, CASE WHEN term LIKE 'th%' THEN true ELSE is_relevant END AS is_relevant FROM cache""")
def _(d):
    path = scratch_path(d.spark, "term-cache")
    sinks.save_term_cache(d.term_cache, path)
    old = corpus.read_term_cache(d.spark, path)
    new = old.where(F.col("term").startswith("th")).select("term", F.lit(True).alias("is_relevant"))
    sinks.save_term_cache(expansion.extended_cache(old, new), path)
    return corpus.read_term_cache(d.spark, path)


def write_batches(d: Tables) -> str:
    """Three verdict files; their name order is not their number order."""
    folder = scratch_path(d.spark, "batches")
    for name, topic, keep in (("batch_0_29.csv", "performance", F.col("doc_id") % 2 == 0),
                              ("batch_120_149.csv", "pricing", F.col("doc_id") % 3 == 0),
                              ("batch_30_59.csv", "support", F.col("doc_id") % 5 == 0)):
        d.reviews.where(keep).select(F.col("doc_id").alias("index"), F.lit(topic).alias("verified_topic")) \
            .write.option("header", "true").csv(f"{folder}/{name}")
    return folder


BATCHES = """verdicts AS (
  SELECT doc_id AS row_index, 'performance' AS verified_topic, 'batch_0_29.csv' AS file FROM documents WHERE doc_id % 2 = 0
  UNION ALL SELECT doc_id, 'pricing', 'batch_120_149.csv' FROM documents WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, 'support', 'batch_30_59.csv' FROM documents WHERE doc_id % 5 = 0)"""


@query("s16_verdict_batches", f"WITH {BATCHES} SELECT row_index, verified_topic, file FROM verdicts")
def _(d):
    return corpus.read_verdict_batches(d.spark, write_batches(d)).select("row_index", "verified_topic", "file")


@query("s17_reports", """SELECT 'report_20240102_030405' AS report_name, 'en' AS dataset, count(*) AS review_count,
  count(DISTINCT source) AS n_results, 1 AS newest FROM documents WHERE lang = 'en'
UNION ALL SELECT 'report_20240101_030405', 'de', count(*), count(DISTINCT source), 2 FROM documents WHERE lang = 'de'""")
def _(d):
    listed = sinks.list_reports(sinks.load_reports(d.spark, saved_reports(d)))
    rank = F.row_number().over(W.orderBy(F.desc("report_ts")))
    return listed.select("report_name", "dataset", "review_count", "n_results", rank.alias("newest"))


@query("s17_one_report", """SELECT 'de' AS dataset, (SELECT count(*) FROM documents WHERE lang = 'de') AS review_count, source AS query,
  avg(1 + doc_id % 5) >= 1 AS passed, round(avg(1 + doc_id % 5), 6) AS mean FROM documents WHERE lang = 'de' GROUP BY source""")
def _(d):
    one = sinks.load_report(sinks.load_reports(d.spark, saved_reports(d)), datetime(2024, 1, 1, 3, 4, 5))
    return one.select("dataset", "review_count", "query", "passed", r6(F.element_at("details", "mean").cast("double")).alias("mean"))


def saved_reports(d: Tables) -> str:
    """Two reports, one a language, in one folder."""
    path = scratch_path(d.spark, "reports")
    for lang, day in (("de", 1), ("en", 2)):
        part = d.reviews.where(F.col("lang") == lang)
        size = part.agg(F.count("*")).scalar()
        rows = part.groupBy("product_id").agg(F.avg("rating").alias("mean")).select(
            F.lit(datetime(2024, 1, day, 3, 4, 5)).alias("report_ts"), F.lit(lang).alias("dataset"), size.alias("review_count"),
            F.lit("heuristic").alias("kind"), F.lit("mean_rating").alias("name"), F.col("product_id").alias("query"),
            F.lit(None).cast("string").alias("item"), (F.col("mean") >= 1).alias("passed"), F.lit(None).cast("string").alias("reasoning"),
            F.create_map(F.lit("mean"), F.col("mean").cast("string")).alias("details"))
        sinks.save_report(rows, path)
    return path


@query("s18_model_artifacts", f"""WITH {REVIEWS}, {tf_ctes('reviews', 'review_id', 'd')}, {vocab_ctes('d', 10000, 'reviews')}
SELECT term, total, df, round(idf, 6) AS idf, 'TF-IDF' AS model, (SELECT count(*) FROM reviews) AS corpus_size FROM d_vocab""")
def _(d):
    path = scratch_path(d.spark, "model")
    model = tfidf.fit(d.reviews)
    meta = models.metadata_row(d.spark, "TF-IDF", "documents", model.n_docs, {"max_features": model.max_features}, {})
    models.save_tfidf(model, path, meta)
    back = models.load_tfidf(d.spark, path)
    facts = models.load_metadata(d.spark, path).select(F.struct("model", "corpus_size")).scalar()
    return back.vocabulary.withColumn("m", facts).select(
        "term", "total", "df", r6("idf").alias("idf"), F.col("m.model").alias("model"), F.col("m.corpus_size").alias("corpus_size"))


@query("s19_train_all", f"""WITH {REVIEWS}, sizes AS (SELECT count(*) AS n FROM reviews)
SELECT 'TF-IDF' AS model, n AS corpus_size, 'max_features=10000, ngram_range=[1, 2]' AS parameters FROM sizes
UNION ALL SELECT 'Naive Bayes', n, 'alpha=1.0, max_features=5000' FROM sizes
UNION ALL SELECT 'Bayesian Net', n, 'structure=topic>sentiment>rating_category' FROM sizes
UNION ALL SELECT 'HMM', n, 'n_components=3, n_iter=100' FROM sizes""")
def _(d):
    labeled = labeling.auto_label(d.with_sentences, CORPUS_LEXICON)
    overview = train.train_all(d.spark, d.with_sentences, labeled, scratch_path(d.spark, "models"), polarity=d.polarity)
    return overview.select("model", "corpus_size", "parameters")


# Documents arrive in four deliveries with made-up times: (time, numbers of doc_id % 4). Lateness is an hour.
# The second repeats a part of the first in time; the third is new, but for texts known from the first, and its time lets the
# digests of the first go; the fourth repeats both, so only texts of the third are known.
DELIVERIES = [("10:00", (0, 1, 2)), ("10:30", (0,)), ("13:00", (3,)), ("13:30", (1, 3))]


@query("x01_arriving_reviews", f"""WITH RECURSIVE {trained_ctes()}, {VITERBI}, {LABELED},
first_kept AS (SELECT DISTINCT text FROM reviews WHERE doc_id % 4 <> 3),
third_kept AS (SELECT text FROM reviews WHERE doc_id % 4 = 3 EXCEPT SELECT text FROM first_kept),
fourth_kept AS (SELECT text FROM reviews WHERE doc_id % 4 IN (1, 3) EXCEPT SELECT text FROM third_kept),
kept_rows AS (SELECT '10:00' AS arrived_at, text FROM first_kept UNION ALL SELECT '13:00', text FROM third_kept UNION ALL SELECT '13:30', text FROM fourth_kept),
arrived AS (SELECT min(doc_id) AS doc_id, min(review_id) AS review_id, text AS raw, {NORMAL} AS text FROM reviews GROUP BY reviews.text
  HAVING {NORMAL} <> '' AND length({NORMAL}) BETWEEN 10 AND 5000),
{label_ctes(CORPUS_LEXICON, 'arrived', 'fresh')},
{classifier_ctes('labeled', 'arrived', lex.TOPICS)}
SELECT k.arrived_at, sha256(f.text) AS digest, f.topic_label, f.confidence_score, n.predicted_topic, round(n.confidence, 6) AS confidence,
  coalesce(array_to_string(d.states, '|'), '') AS states
FROM kept_rows k JOIN fresh f ON f.raw = k.text JOIN nb_predicted n USING (review_id) LEFT JOIN decoded d USING (review_id)""")
def _(d):
    """A stream over four deliveries, started anew for each: clean, drop late copies, label, classify, decode; then read the stored batches."""
    nb, model = classifier.fit(d.labeled, label="topic_label"), trained_hmm(d)
    inbox, out, checkpoint = (scratch_path(d.spark, name) for name in ("inbox", "scored", "stream-checkpoint"))
    documents = corpus.with_columns_from_documents(d.table("documents"))
    for hour, numbers in DELIVERIES:
        arriving = documents.where(F.pmod("doc_id", F.lit(4)).isin(*numbers)).withColumn("ts", F.lit(f"2024-01-01 {hour}:00").cast("timestamp"))
        arriving.write.mode("append").parquet(inbox)
        stream = scoring.arriving_reviews(d.spark, inbox, arriving.schema)
        scoring.write_scored(scoring.labeled_stream(stream, CORPUS_LEXICON, "ts"), nb, out, checkpoint, model, d.polarity).awaitTermination()
    return d.spark.read.parquet(out).select(
        F.date_format("ts", "HH:mm").alias("arrived_at"), F.sha2("text", 256).alias("digest"), "topic_label",
        big("confidence_score").alias("confidence_score"), "predicted_topic", r6("confidence").alias("confidence"),
        F.coalesce(F.array_join("sentiment_states", "|"), F.lit("")).alias("states"))
