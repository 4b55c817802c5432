"""Cleaning, predicates, samples, curation and text expressions (P, W, T, U, H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtable.functions import lexicons as lex, text as tx
from voxtable.operators import cleaning, expansion, labeling, probability, profiling, sampling, sentiment
from voxtable.plans.catalogue.base import *  # noqa: F403
from voxtable.plans.catalogue.base import query
from voxtable.plans.catalogue.sources import BATCHES, CURATED, curated_from, write_batches
from voxtable.sources import corpus, sinks
from voxtable.sources.scratch import literal_table, spread

COLS = ["review_id", "text", "rating", "title", "product_id"]


@query("p01_exact_dedup", f"""WITH {REVIEWS} SELECT review_id, text, rating FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY review_id) AS rn FROM reviews) WHERE rn = 1""")
def _(d):
    return cleaning.keep_first_copy(d.reviews.select("review_id", "text", "rating"))


@query("p02_has_text", f"WITH {REVIEWS} SELECT review_id, text FROM reviews WHERE text IS NOT NULL AND {NORMAL} <> ''")
def _(d):
    return cleaning.has_text(d.reviews).select("review_id", "text")


@query("p03_normal_space", f"WITH {REVIEWS} SELECT review_id, {NORMAL} AS text FROM reviews")
def _(d):
    return cleaning.with_normal_space(d.reviews).select("review_id", "text")


@query("p04_length", f"WITH {REVIEWS} SELECT review_id FROM reviews WHERE length({NORMAL}) BETWEEN 10 AND 5000")
def _(d):
    return d.reviews.where(cleaning.length_between(tx.normalize_space("text"))).select("review_id")


@query("p05_rating", """SELECT printf('R%06d', doc_id) AS review_id FROM documents WHERE NULLIF(n_chars % 8, 7) BETWEEN 1 AND 5""")
def _(d):
    odd = d.table("documents").select(tx.formatted_id("doc_id").alias("review_id"),
                                      F.nullif(F.col("n_chars") % 8, F.lit(7)).alias("rating"))
    return odd.where(cleaning.rating_between()).select("review_id")


@query("p06_clean", f"WITH {REVIEWS}, {CLEAN} SELECT {', '.join(COLS)} FROM cleaned")
def _(d):
    return cleaning.clean(d.reviews.select(*COLS))


@query("p06_clean_report", f"""WITH {REVIEWS}, {CLEAN}, c AS (
  SELECT (SELECT count(*) FROM reviews) AS a, (SELECT count(DISTINCT text) FROM reviews) AS b, (SELECT count(*) FROM cleaned) AS k)
SELECT a AS original_count, a - b AS duplicates_removed, k AS cleaned_count, a - k AS removed_count,
  round((a - k) / a * 100, 6) AS removed_pct FROM c""")
def _(d):
    return cleaning.clean_report(d.reviews).withColumn("removed_pct", r6("removed_pct"))


@query("p07_pattern_search", f"""WITH {REVIEWS} SELECT text, rating FROM (
  SELECT * FROM reviews WHERE regexp_matches(lower(text), 'th(on|re)b') ORDER BY review_id LIMIT 5)""")
def _(d):
    return profiling.reviews_with_term(d.reviews, "TH(on|re)b")


@query("p08_whole_word", f"WITH {REVIEWS} SELECT review_id FROM reviews WHERE {sql_has_word('text', 'que')}")
def _(d):
    return profiling.reviews_with_word(d.reviews, "que").select("review_id")


@query("p09_high_confidence", f"""WITH {REVIEWS}, {LABELED}
SELECT review_id, topic_label FROM labeled WHERE confidence_score >= 2 AND topic_label <> 'other'""")
def _(d):
    return sampling.high_confidence(d.labeled).select("review_id", "topic_label")


@query("p13_sequence_eligible", f"WITH {REVIEWS}, {SENTENCES} SELECT review_id, len(sentences) AS n FROM sents WHERE len(sentences) >= 2")
def _(d):
    return d.with_sentences.where(F.size("sentences") >= 2).select("review_id", big(F.size("sentences")).alias("n"))


@query("p14_prefilter", f"""WITH {REVIEWS}, {LABELED} SELECT review_id FROM labeled
WHERE topic_label = 'performance' AND rating >= 4 AND lang = 'en'""")
def _(d):
    unmoved = corpus.with_columns_from_documents(d.table("documents")).withColumn("sentiment", probability.inferred_sentiment())
    rows = spread(cleaning.prefilter(unmoved, None, "high", "positive", "en"), "review_id")
    return cleaning.prefilter(labeling.auto_label(rows, CORPUS_LEXICON).withColumn("topic", F.col("topic_label")), "performance").select("review_id")


@query("p15_language", "SELECT printf('R%06d', doc_id) AS review_id FROM documents WHERE lang = 'en'")
def _(d):
    return cleaning.prefilter(corpus.with_columns_from_documents(d.table("documents")), lang="en").select("review_id")


@query("p16_rating_category", f"""WITH {REVIEWS}
SELECT review_id, CASE WHEN rating < 3 THEN 'low' WHEN rating = 3 THEN 'medium' ELSE 'high' END AS rating_category FROM reviews""")
def _(d):
    return d.reviews.select("review_id", probability.rating_category().alias("rating_category"))


@query("p17_sentiment", f"""WITH {REVIEWS}
SELECT review_id, CASE WHEN l.toxic = 1 THEN 'negative' WHEN rating > 3 THEN 'positive' WHEN rating < 3 THEN 'negative'
  ELSE 'neutral' END AS sentiment FROM reviews LEFT JOIN labels l USING (doc_id)""")
def _(d):
    with_label = d.reviews.join(d.table("labels"), "doc_id", "left")
    label = F.when(F.col("toxic") == 1, "negative")
    return with_label.select("review_id", probability.inferred_sentiment("rating", label).alias("sentiment"))


@query("p18_coerce_topic", f"""WITH {REVIEWS}
SELECT review_id, coalesce({sql_list(lex.TOPICS)}[CAST(substr(product_id, 4) AS INTEGER) + 1], 'other') AS topic FROM reviews""")
def _(d):
    number = F.substring("product_id", 4, 10).cast("int")
    stored = F.coalesce(F.get(tx.string_array(lex.TOPICS), number), F.when(number > 12, F.col("product_id")))
    return d.reviews.select("review_id", labeling.coerce_topic(stored).alias("topic"))


TURN_WORDS = sql_words("lower(text)")
IS_QUESTION = f"""(coalesce({TURN_WORDS}[1] IN ({quoted(lex.QUESTION_WORDS)}), false) OR contains(text, '?')
  OR (len({TURN_WORDS}) > 4 AND list_has_any({TURN_WORDS}, {sql_list(lex.SENTENCE_MARKERS)})))"""


@query("p19_question_detector", f"SELECT conv_id * 1000 + turn AS query_id, {IS_QUESTION} AS is_question FROM conversations")
def _(d):
    return d.turns.select("query_id", expansion.looks_like_question("query").alias("is_question"))


@query("p20_query_words", f"""SELECT conv_id * 1000 + turn AS query_id, array_to_string({TURN_WORDS}, '|') AS keywords,
  false AS was_preprocessed FROM conversations""")
def _(d):
    return expansion.query_keywords(d.turns).select("query_id", joined("extracted_keywords").alias("keywords"), "was_preprocessed")


@query("p21_keyword_override", f"""WITH q AS (
  SELECT *, conv_id * 1000 + turn AS query_id, {IS_QUESTION} AND conv_id % 2 = 0 AND role = 'user'
    AND len({sql_runs('text', 6)}) > 0 AS used FROM conversations)
SELECT query_id, CASE WHEN used THEN array_to_string({sql_runs('text', 6)}, '|') ELSE array_to_string({TURN_WORDS}, '|') END AS keywords,
  used AS was_preprocessed FROM q""")
def _(d):
    given = d.table("conversations").where((F.col("conv_id") % 2 == 0) & (F.col("role") == "user")).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), tx.word_runs(F.upper("text"), 6).alias("keywords"))
    return expansion.query_keywords(d.turns, given).select("query_id", joined("extracted_keywords").alias("keywords"), "was_preprocessed")


@query("p22_curation_table", f"""WITH {REVIEWS}, {LABELED} SELECT review_id, rating, title, product_id, topic_label AS auto_topic,
  confidence_score, array_to_string(matched_keywords, '|') AS matched_keywords, '' AS verified_topic, '' AS notes FROM labeled""")
def _(d):
    return labeling.curation_table(d.labeled).drop("text").withColumn("matched_keywords", joined("matched_keywords")) \
        .withColumn("confidence_score", big("confidence_score"))


@query("p23_topic_override", f"""WITH {label_ctes(lex.QUERY_TOPIC_KEYWORDS, 'conversations')}
SELECT conv_id * 1000 + turn AS query_id, CASE WHEN turn % 2 = 0 THEN 'pricing' ELSE topic_label END AS topic FROM labeled""")
def _(d):
    given = F.when(F.col("turn") % 2 == 0, "pricing").when(F.col("turn") % 3 == 0, "")
    return d.turns.select("query_id", labeling.chosen_topic(given, labeling.detect_topic("query")).alias("topic"))


# ---- samples, windows, limits ---------------------------------------------------------------

@query("w01_rating_sample", f"""WITH {REVIEWS} SELECT review_id, rating FROM (
  SELECT *, row_number() OVER (PARTITION BY rating ORDER BY {SHUFFLE}) AS rn FROM reviews) WHERE rn <= 20""")
def _(d):
    return sampling.rating_sample(d.reviews, order=shuffle_key()).select("review_id", "rating")


W02 = f"""w02 AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY topic_label ORDER BY {SHUFFLE}) AS rn FROM labeled
  WHERE confidence_score >= 2 AND topic_label <> 'other') WHERE rn <= 50)"""


@query("w02_curation_sample", f"WITH {REVIEWS}, {LABELED}, {W02} SELECT review_id, topic_label FROM w02")
def _(d):
    return sampling.curation_sample(d.labeled, order=shuffle_key()).select("review_id", "topic_label")


@query("w07_token_window", f"""WITH {REVIEWS}, t AS (SELECT review_id, {sql_runs('text')} AS ws FROM reviews),
e AS (SELECT review_id, ws, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t)
SELECT review_id, row_number() OVER (PARTITION BY review_id ORDER BY i) - 1 AS hit,
  array_to_string(ws[greatest(i - 5, 1):least(i + 5, len(ws))], ' ') AS context FROM e WHERE contains(w, 'thon')""")
def _(d):
    return profiling.keyword_in_context(d.reviews, "thon").withColumn("hit", big("hit"))


@query("w08_page", f"""WITH {REVIEWS}, n AS (SELECT *, row_number() OVER (ORDER BY review_id) - 1 AS row_index FROM reviews)
SELECT row_index, review_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS preview
FROM n WHERE row_index BETWEEN 30 AND 39""")
def _(d):
    unmoved = corpus.with_columns_from_documents(d.table("documents"))
    return labeling.page_by_id(unmoved, 30, 10).select("row_index", "review_id", "preview")


def excerpt_sql(n: int, tags: bool) -> str:
    seg = "list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: contains(lower(s), term))[1]"
    clean = f"regexp_replace({sql_strip(seg)}, '<[^>]+>', '', 'g')" if tags else sql_strip(seg)
    cut = f"CASE WHEN length({clean}) > {n} THEN substr({clean}, 1, {n}) || '...' ELSE {clean} END"
    if not tags:
        return cut
    return f"CASE WHEN {seg} IS NULL THEN regexp_replace(substr(text, 1, {n}) || '...', '<[^>]+>', '', 'g') ELSE {cut} END"


HITS = "hits AS (" + " UNION ALL ".join(
    f"SELECT *, '{t}' AS term, {i} AS term_order FROM reviews WHERE {sql_has_word('text', t)}" for i, t in enumerate(CORPUS_TERMS)) + ")"


@query("w09_examples", f"""WITH {REVIEWS}, {HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY review_id) AS rn FROM hits)
SELECT term, rn AS example, review_id, rating, {excerpt_sql(150, True)} AS excerpt FROM r WHERE rn <= 3""")
def _(d):
    return profiling.examples_per_term(d.reviews, CORPUS_TERMS).withColumn("example", big("example"))


@query("w10_snippets", f"""WITH {REVIEWS}, {HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY review_id) AS rn FROM hits),
f AS (SELECT * FROM r WHERE rn = 1 ORDER BY term_order LIMIT 3)
SELECT CAST(term_order AS BIGINT) AS term_order, term, {excerpt_sql(100, False)} AS snippet FROM f""")
def _(d):
    return profiling.first_snippets(d.reviews, CORPUS_TERMS)


@query("w11_verification_sample", f"WITH {REVIEWS} SELECT review_id FROM reviews ORDER BY {SHUFFLE} LIMIT 100")
def _(d):
    return sampling.verification_sample(d.reviews, order=shuffle_key()).select("review_id")


@query("t02_shuffle", f"""WITH {REVIEWS}, s AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY rating ORDER BY {SHUFFLE}) AS rn FROM reviews) WHERE rn <= 20)
SELECT row_number() OVER (ORDER BY {SHUFFLE}) - 1 AS row_index, review_id FROM s""")
def _(d):
    sample = sampling.rating_sample(d.reviews, order=shuffle_key())
    return cleaning.dense_index(sample, *shuffle_key()).select("row_index", "review_id")


@query("t06_sorted_index", f"""WITH {REVIEWS} SELECT rating, count(*) AS n FROM reviews GROUP BY rating""")
def _(d):
    return profiling.rating_distribution(d.reviews).orderBy("rating")


@query("u01_union_of_strata", f"""WITH {REVIEWS} SELECT review_id, rating FROM (
  SELECT *, row_number() OVER (PARTITION BY rating ORDER BY {SHUFFLE}) AS rn FROM reviews) WHERE rn <= 20""")
def _(d):
    parts = [sampling.verification_sample(d.reviews.where(F.col("rating") == r), 20, shuffle_key()) for r in range(1, 6)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("review_id", "rating")


@query("u05_subset_of_stop_words", f"""SELECT conv_id * 1000 + turn AS query_id,
  len(list_filter({sql_latin('text')}, lambda w: w NOT IN ({quoted(lex.PHRASE_STOP_WORDS)}))) = 0 AS only_stop_words FROM conversations""")
def _(d):
    rest = F.array_except(tx.latin_words("query"), tx.string_array(lex.PHRASE_STOP_WORDS))
    return d.turns.select("query_id", (F.size(rest) == 0).alias("only_stop_words"))


@query("u06_last_verdict", f"WITH {BATCHES} SELECT row_index, arg_max(verified_topic, file) AS verified_topic FROM verdicts GROUP BY row_index")
def _(d):
    verdicts = corpus.read_verdict_batches(d.spark, write_batches(d))
    return verdicts.groupBy("row_index").agg(F.max_by("verified_topic", F.struct("file", "position")).alias("verified_topic"))


# ---- curation joins ---------------------------------------------------------------------------

@query("j02_reviews_with_labels", f"WITH {REVIEWS} SELECT review_id, rating, quality, toxic FROM reviews JOIN labels USING (doc_id)")
def _(d):
    return d.reviews.join(d.table("labels"), "doc_id").select("review_id", "rating", "quality", "toxic")


INDEXED = f"""indexed AS (SELECT *, row_number() OVER (ORDER BY review_id) - 1 AS row_index FROM curated)"""


@query("j04_verdict_upsert", f"""WITH {REVIEWS}, {LABELED}, {CURATED}, {INDEXED}, {BATCHES},
last AS (SELECT row_index, arg_max(verified_topic, file) AS v FROM verdicts GROUP BY row_index)
SELECT row_index, review_id, coalesce(v, verified_topic) AS verified_topic FROM indexed FULL JOIN last USING (row_index)""")
def _(d):
    table = cleaning.dense_index(curated_from(d.labeled).select("review_id", "verified_topic"), *tx.id_order())
    verdicts = corpus.read_verdict_batches(d.spark, write_batches(d))
    return labeling.apply_verdicts(table, verdicts, strict=False).select("row_index", "review_id", "verified_topic")


@query("j04_unknown_verdicts", f"""WITH {REVIEWS}, {LABELED}, {CURATED}, {INDEXED}, {BATCHES}
SELECT row_index, verified_topic FROM verdicts WHERE row_index NOT IN (SELECT row_index FROM indexed)""")
def _(d):
    table = cleaning.dense_index(curated_from(d.labeled).select("review_id"), *tx.id_order())
    return labeling.unknown_verdicts(table, corpus.read_verdict_batches(d.spark, write_batches(d))).select("row_index", "verified_topic")


@query("j05_direct_update", f"""WITH {REVIEWS}, {LABELED}, {CURATED}, {INDEXED}
SELECT row_index, review_id, CASE WHEN l.quality = 1 THEN 'pricing' WHEN l.quality = 0 THEN 'support' ELSE verified_topic END AS verified_topic
FROM indexed i LEFT JOIN labels l ON l.doc_id = i.row_index""")
def _(d):
    table = cleaning.dense_index(curated_from(d.labeled).select("review_id", "verified_topic"), *tx.id_order())
    updates = d.table("labels").select(F.col("doc_id").alias("row_index"), F.when(F.col("quality") == 1, "pricing").otherwise("support")
                                       .alias("verified_topic"), F.lit("").alias("file"), F.lit(0).alias("position"))
    return labeling.apply_verdicts(table, updates).select("row_index", "review_id", "verified_topic")


@query("a34_verification_accuracy", f"""WITH {REVIEWS}, {LABELED}, {CURATED}
SELECT count(*) FILTER (WHERE verified_topic = auto_topic) AS correct, count(*) FILTER (WHERE verified_topic <> auto_topic) AS wrong,
  round(count(*) FILTER (WHERE verified_topic = auto_topic) / count(verified_topic), 6) AS accuracy FROM curated""")
def _(d):
    return labeling.verification_accuracy(curated_from(d.labeled)).withColumn("accuracy", r6("accuracy"))


@query("a35_curation_progress", f"""WITH {REVIEWS}, {LABELED}, {CURATED}
SELECT count(verified_topic) AS reviewed, count(*) AS total FROM curated""")
def _(d):
    return labeling.curation_progress(curated_from(d.labeled))


# ---- text expressions -------------------------------------------------------------------------

@query("h01_word_tokens", f"WITH {REVIEWS} SELECT review_id, array_to_string({sql_runs('text', 2)}, '|') AS tokens FROM reviews")
def _(d):
    return d.reviews.select("review_id", joined(tx.search_tokens("text")).alias("tokens"))


@query("h02_search_terms", f"""WITH {REVIEWS}, t AS (SELECT review_id, list_filter({sql_runs('text', 2)},
  lambda t: t NOT IN ({quoted(lex.SEARCH_STOP_WORDS)})) AS ts FROM reviews)
SELECT review_id, array_to_string(list_concat(ts, {sql_ngrams('ts', 2)}), '|') AS terms FROM t""")
def _(d):
    return d.reviews.select("review_id", joined(tx.search_terms("text")).alias("terms"))


@query("h03_word_count", f"WITH {REVIEWS} SELECT review_id, len({sql_words('text')}) AS n_words FROM reviews")
def _(d):
    return d.reviews.select("review_id", big(F.size(tx.whitespace_words("text"))).alias("n_words"))


@query("h04_sentences", f"""WITH {REVIEWS}, {SENTENCES}
SELECT review_id, array_to_string(sentences, '|') AS sentences, len(sentences) AS sentence_count FROM sents""")
def _(d):
    return cleaning.with_sentences(d.reviews).select("review_id", joined("sentences").alias("sentences"),
                                                     big("sentence_count").alias("sentence_count"))


@query("h05_stored_or_split", f"""WITH {REVIEWS}, {SENTENCES}
SELECT review_id, CASE WHEN doc_id % 2 = 0 THEN text || '!' WHEN len(sentences) = 0 THEN text ELSE array_to_string(sentences, '|') END AS sentences FROM sents""")
def _(d):
    stored = F.when(F.col("doc_id") % 2 == 0, F.array(F.concat("text", F.lit("!")))).when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>"))
    return d.reviews.select("review_id", joined(tx.review_sentences("text", stored)).alias("sentences"))


@query("h06_cut", f"""WITH {REVIEWS} SELECT review_id, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END AS cut300,
  substr(text, 1, 300) AS head300 FROM reviews""")
def _(d):
    return d.reviews.select("review_id", tx.cut("text", 300).alias("cut300"), tx.cut("text", 300, "").alias("head300"))


@query("h07_clean_excerpt", f"""WITH p AS (SELECT page_id, html AS text, 'er' AS term FROM pages)
SELECT page_id, {excerpt_sql(150, True)} AS excerpt FROM p""")
def _(d):
    return d.table("pages").select("page_id", tx.clean_excerpt("html", "er").alias("excerpt"))


@query("h08_snippet", f"WITH {REVIEWS}, t AS (SELECT *, 'que' AS term FROM reviews) SELECT review_id, {excerpt_sql(100, False)} AS snippet FROM t")
def _(d):
    return d.reviews.select("review_id", tx.snippet("text", "que").alias("snippet"))


@query("h09_strip_tags", "SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS text FROM pages")
def _(d):
    return d.table("pages").select("page_id", tx.strip_tags("html").alias("text"))


@query("h10_context_strings", f"""WITH {REVIEWS}, t AS (SELECT review_id, {sql_runs('text')} AS ws FROM reviews),
e AS (SELECT review_id, ws, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t)
SELECT review_id, string_agg(array_to_string(ws[greatest(i - 3, 1):least(i + 3, len(ws))], ' '), '|' ORDER BY i) AS contexts
FROM e WHERE contains(w, 'que') GROUP BY review_id""")
def _(d):
    found = d.reviews.select("review_id", tx.context_windows("text", "que", 3).alias("c"))
    return found.where(F.size("c") > 0).select("review_id", joined("c").alias("contexts"))


@query("h11_stars", f"""WITH {REVIEWS} SELECT review_id, repeat('*', rating) AS plain,
  repeat('★', rating) || repeat('☆', 5 - rating) AS stars FROM reviews""")
def _(d):
    return d.reviews.select("review_id", tx.plain_stars(F.col("rating")).alias("plain"), tx.rating_stars("rating").alias("stars"))


@query("h17_json_encode", f"""WITH {REVIEWS}, {LABELED} SELECT review_id,
  '[' || array_to_string(list_transform(matched_keywords, lambda k: '"' || k || '"'), ',') || ']' AS encoded FROM labeled""")
def _(d):
    return d.labeled.select("review_id", F.to_json("matched_keywords").alias("encoded"))


@query("h18_json_length", f"WITH {REVIEWS}, {LABELED} SELECT review_id, len(matched_keywords) AS n FROM labeled")
def _(d):
    return d.labeled.select("review_id", big(sinks.json_length(F.to_json("matched_keywords"))).alias("n"))


@query("h19_formats", """SELECT printf('R%06d', event_id * 1000) AS review_id, printf('%.1f%%', floor(value) / 8 * 100) AS pct,
  printf('%.2f', floor(value) / 8) AS fixed, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events""")
def _(d):
    e = d.table("events")
    return e.select(tx.formatted_id(F.col("event_id") * 1000).alias("review_id"), tx.percent_text(F.floor("value") / 8).alias("pct"),
                    tx.fixed(F.floor("value") / 8, 2).alias("fixed"), F.date_format("ts", "yyyyMMdd_HHmmss").alias("stamp"))


@query("h20_clamp", "SELECT event_id, round(greatest(0.0::DOUBLE, 1 - value / 50 - 0.1::DOUBLE), 6) AS rest FROM events")
def _(d):
    return d.table("events").select("event_id", r6(F.greatest(F.lit(0.0), 1 - F.col("value") / 50 - 0.1)).alias("rest"))


@query("h21_query_text", f"""SELECT conv_id * 1000 + turn AS query_id, lower({sql_strip('text')}) AS lowered, contains(text, '?') AS has_mark,
  coalesce({TURN_WORDS}[1], '') AS first_word FROM conversations""")
def _(d):
    return d.turns.select("query_id", F.lower(tx.strip("query")).alias("lowered"), F.contains("query", F.lit("?")).alias("has_mark"),
                          F.coalesce(F.get(tx.whitespace_words(F.lower("query")), F.lit(0)), F.lit("")).alias("first_word"))
