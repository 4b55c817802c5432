"""Vocabulary, retrieval, expansion and search checks (A12, A23-A29, J06-J09, J12-J13, M01-M02, M11-M12, ...)."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtable.functions import lexicons as lex, text as tx
from voxtable.operators import evaluation, expansion, postings, tfidf
from voxtable.plans.catalogue.base import *  # noqa: F403
from voxtable.plans.catalogue.base import query
from voxtable.sources.scratch import materialize, small


def index_of(d: Tables):
    model = tfidf.fit(d.reviews)
    return model, tfidf.transform(d.reviews, model, packed=True)


@query("a12_tfidf_fit", f"""WITH {REVIEWS}, {tf_ctes('reviews', 'review_id', 'd')}, {vocab_ctes('d', 10000, 'reviews')}
SELECT term, total, df, round(idf, 6) AS idf FROM d_vocab""")
def _(d):
    return tfidf.fit(d.reviews).vocabulary.select("term", "total", "df", r6("idf").alias("idf"))


@query("a12_tfidf_index", f"WITH {INDEX} SELECT review_id, term, round(weight, 6) AS weight FROM postings")
def _(d):
    model, weights = index_of(d)
    return weights.withColumn("weight", r6("weight"))


@query("m01_tfidf_transform", f"""WITH {INDEX}, {QUERY_TERMS}, {score_ctes('asked')}
SELECT query_id, term, round(weight, 6) AS query_weight FROM q_weights""")
def _(d):
    model = tfidf.fit(d.reviews)
    return tfidf.query_weights(d.query_terms, model).withColumn("query_weight", r6("query_weight"))


@query("j09_postings_join", f"WITH {INDEX}, {QUERY_TERMS}, {score_ctes('asked')} SELECT query_id, review_id, round(score, 6) AS score FROM q_score")
def _(d):
    model, weights = index_of(d)
    return tfidf.score(weights, tfidf.query_weights(d.query_terms, model)).withColumn("score", r6("score"))


RANKED = f"{INDEX}, {QUERY_TERMS}, {score_ctes('asked')}, {top_ctes('q_score', 500)}"


_blocks: dict = {}


def built_blocks(d: Tables):
    model = tfidf.fit(d.reviews)
    return model, postings.build(postings.vectors(d.reviews, model))


def blocks_of(d: Tables):
    """The block index, built and stored once per application and folder; ``a12_block_index`` builds it anew."""
    key = (d.spark.sparkContext.applicationId, d.folder)
    if key not in _blocks:
        _blocks[key] = built_blocks(d)
    return _blocks[key]


@query("a12_block_index", f"""WITH {INDEX} SELECT term, count(*) AS n, round(max(weight), 6) AS top FROM postings GROUP BY term""")
def _(d):
    blocks = built_blocks(d)[1].blocks.select("term", "n", F.array_max(F.transform("entries", lambda e: e["weight"])).alias("top"))
    return blocks.groupBy("term").agg(F.sum("n").alias("n"), r6(F.max("top")).alias("top"))


def ranked_of(d: Tables, k: int = 500):
    model, index = blocks_of(d)
    return postings.retrieve(index, d.query_terms, model, k)


@query("m02_retrieve", f"WITH {RANKED} SELECT query_id, review_id, rank, round(score, 6) AS score FROM ranked")
def _(d):
    return ranked_of(d).select("query_id", "review_id", big("rank").alias("rank"), r6("score").alias("score"))


@query("t01_top_k_single", f"""WITH {INDEX}, asked AS (SELECT 1 AS query_id, {sql_list(CORPUS_TERMS)} AS terms), {score_ctes('asked')}
SELECT review_id, round(score, 6) AS score FROM q_score ORDER BY round(score, 9) DESC, review_id LIMIT 50""")
def _(d):
    return tfidf.retrieve_one(d.reviews, CORPUS_TERMS, tfidf.fit(d.reviews), 50).withColumn("score", r6("score"))


@query("p12_positive_scores", f"""WITH {INDEX}, {QUERY_TERMS}, {score_ctes('asked')}
SELECT query_id, count(*) AS n_positive FROM q_score WHERE score > 0 GROUP BY query_id""")
def _(d):
    model, index = blocks_of(d)
    return postings.match_counts(index, tfidf.query_weights(d.query_terms, model)).withColumnRenamed("n", "n_positive")


@query("j12_judged_results", f"""WITH {RANKED} SELECT query_id, review_id, CAST(1 + doc_id % 5 AS INTEGER) >= 3 AS is_relevant
FROM ranked JOIN documents ON printf('R%06d', doc_id) = review_id WHERE doc_id % 20 = query_id""")
def _(d):
    return evaluation.judged_results(ranked_of(d), d.judgments).select("query_id", "review_id", "is_relevant")


@query("a26_precision_at_k", f"""WITH {RANKED} SELECT query_id, count(*) AS judged, round(avg(CASE WHEN doc_id % 5 >= 2 THEN 1 ELSE 0 END), 6) AS precision
FROM ranked JOIN documents ON printf('R%06d', doc_id) = review_id WHERE doc_id % 20 = query_id AND rank <= 50 GROUP BY query_id""")
def _(d):
    return evaluation.precision_at_k(ranked_of(d), d.judgments, 50).withColumn("precision", r6("precision"))


@query("a26_relevant_term_share", f"""WITH {EXPANSION}, {TERM_CACHE}
SELECT query_id, round(avg(CASE WHEN is_relevant THEN 1 ELSE 0 END), 6) AS relevant_share
FROM expanded_rows JOIN cache USING (term) GROUP BY query_id""")
def _(d):
    terms = exploded(expansion.expand(d.queries, d.synonyms), ["query_id"], "expanded_terms", "term")
    return evaluation.relevant_term_share(terms.join(d.term_cache, "term")).withColumn("relevant_share", r6("relevant_share"))


@query("a24_score_ordering", f"""WITH {RANKED} SELECT 'score_ordering' AS name, query_id, NOT bool_or(rises) AS passed, count(*) AS n_scores FROM (
  SELECT query_id, coalesce(round(score, 9) > lag(round(score, 9)) OVER (PARTITION BY query_id ORDER BY rank), false) AS rises FROM ranked) GROUP BY query_id""")
def _(d):
    return evaluation.score_ordering(ranked_of(d).withColumn("score", F.round("score", 9)))


@query("w06_adjacent_scores", f"""WITH {RANKED} SELECT query_id, rank, round(lag(score) OVER (PARTITION BY query_id ORDER BY rank) - score, 6) AS drop FROM ranked""")
def _(d):
    w = W.partitionBy("query_id").orderBy("rank")
    return ranked_of(d).select("query_id", big("rank").alias("rank"), r6(F.lag("score").over(w) - F.col("score")).alias("drop"))


# ---- expansion --------------------------------------------------------------------------------

@query("j06_synonyms", f"WITH {QUERY_TERMS}, {SYNONYMS} SELECT word, syn, rank FROM synonyms")
def _(d):
    return expansion.usable_synonyms(d.synonyms).select("word", "syn", big("rank").alias("rank"))


@query("m11_beam_expansion", f"WITH {EXPANSION} SELECT query_id, array_to_string(terms, '|') AS expanded_terms FROM expanded")
def _(d):
    return expansion.expand(d.queries, d.synonyms).select("query_id", joined("expanded_terms").alias("expanded_terms"))


PATH_NO = "row_number() OVER (PARTITION BY query_id ORDER BY depth, bno)"


def paths_of(d: Tables):
    expanded = expansion.expand(d.queries, d.synonyms)
    flat = expanded.select("query_id", F.posexplode_outer("beam_paths").alias("i", "p")).where(F.col("i").isNotNull())
    return flat.select("query_id", (F.col("i") + 1).cast("bigint").alias("path_no"), F.col("p.path").alias("path"), F.col("p.score").alias("score"))


@query("w03_beam_paths", f"""WITH {EXPANSION} SELECT query_id, {PATH_NO} AS path_no, array_to_string(path, '|') AS path, round(score, 6) AS score FROM paths""")
def _(d):
    return paths_of(d).select("query_id", "path_no", joined("path").alias("path"), r6("score").alias("score"))


@query("h22_path_text", f"""WITH {EXPANSION} SELECT query_id, {PATH_NO} AS path_no,
  array_to_string(path, ' → ') || printf(' (score: %.2f)', score) AS shown FROM paths""")
def _(d):
    return paths_of(d).select("query_id", "path_no", tx.beam_path_text("path", "score").alias("shown"))


@query("t04_first_paths", f"""WITH {EXPANSION}, n AS (SELECT *, {PATH_NO} AS path_no FROM paths)
SELECT query_id, string_agg(array_to_string(path, '|'), '#' ORDER BY path_no) AS first_five FROM n WHERE path_no <= 5 GROUP BY query_id""")
def _(d):
    expanded = expansion.expand(d.queries, d.synonyms).where(F.size("beam_paths") > 0)
    five = F.transform(F.slice("beam_paths", 1, 5), lambda p: F.array_join(p["path"], "|"))
    return expanded.select("query_id", joined(five, "#").alias("first_five"))


@query("u02_term_union", f"WITH {EXPANSION} SELECT query_id, count(*) AS n_terms FROM expanded_rows GROUP BY query_id")
def _(d):
    return expansion.expand(d.queries, d.synonyms).select("query_id", big(F.size("expanded_terms")).alias("n_terms"))


TURN_PAIR = f"""turn_pairs AS (
  SELECT conv_id * 1000 + turn AS query_id, list_distinct({sql_words('lower(text)')}) AS a,
    list_distinct(coalesce({sql_words('lower(lead(text) OVER (PARTITION BY conv_id ORDER BY turn))')}, CAST([] AS VARCHAR[]))) AS b
  FROM conversations)"""


def turn_pairs(d: Tables):
    following = F.lead("query").over(W.partitionBy("conv_id").orderBy("turn"))
    words = lambda c: tx.whitespace_words(F.lower(F.coalesce(c, F.lit(""))))
    staged = d.turns.withColumn("following", following)
    return staged.select("query_id", words(F.col("query")).alias("a"), words(F.col("following")).alias("b"))


@query("m12_expansion_score", f"""WITH {TURN_PAIR} SELECT query_id, round(len(list_filter(b, lambda x: NOT list_contains(a, x))) * 0.4
  + len(list_filter(b, lambda x: list_contains(a, x))) / greatest(len(a), 1) * 0.5 + 0.1, 6) AS score FROM turn_pairs""")
def _(d):
    return turn_pairs(d).select("query_id", r6(expansion.expansion_score(F.col("a"), F.col("b"))).alias("score"))


@query("u03_retained_words", f"""WITH {TURN_PAIR} SELECT query_id, array_to_string(list_sort(list_filter(b, lambda x: list_contains(a, x))), '|') AS retained FROM turn_pairs""")
def _(d):
    return turn_pairs(d).select("query_id", joined(F.array_sort(F.array_intersect("a", "b"))).alias("retained"))


@query("u04_new_words", f"""WITH {TURN_PAIR} SELECT query_id, array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), '|') AS new_words FROM turn_pairs""")
def _(d):
    return turn_pairs(d).select("query_id", joined(F.array_sort(F.array_except("b", "a"))).alias("new_words"))


@query("u04_removed_terms", f"""WITH {EXPANSION}, {FILTERED} SELECT e.query_id,
  array_to_string(list_sort(list_filter(e.terms, lambda t: NOT list_contains(f.terms, t))), '|') AS removed FROM expanded e JOIN filtered f USING (query_id)""")
def _(d):
    expanded = materialize(expansion.expand(d.queries, d.synonyms), "expanded")
    filtered = expansion.filter_terms(expanded, d.term_cache)
    return expansion.removed_terms(expanded, filtered).select("query_id", joined("removed_terms").alias("removed"))


@query("j07_term_filter", f"WITH {EXPANSION}, {FILTERED} SELECT query_id, array_to_string(terms, '|') AS filtered_terms FROM filtered")
def _(d):
    expanded = expansion.expand(d.queries, d.synonyms)
    return expansion.filter_terms(expanded, d.term_cache).select("query_id", joined("filtered_terms").alias("filtered_terms"))


@query("j08_undecided_terms", f"""WITH {EXPANSION}, {TERM_CACHE} SELECT DISTINCT query_id, term FROM expanded_rows e JOIN asked a USING (query_id)
WHERE NOT list_contains(a.terms, term) AND term NOT IN (SELECT term FROM cache)""")
def _(d):
    return expansion.undecided_terms(expansion.expand(d.queries, d.synonyms), d.term_cache)


@query("j13_matching_terms", f"""WITH {REVIEWS}, w AS (SELECT review_id, {sql_words('lower(text)')} AS ws FROM reviews)
SELECT review_id, array_to_string(list_filter({sql_list(['Thon', 'que', 'nicht', 'the', 'para'])}, lambda t: list_contains(ws, lower(t))), '|') AS matching FROM w""")
def _(d):
    rows = d.reviews.withColumn("terms", tx.string_array(["Thon", "que", "nicht", "the", "para"]))
    return tfidf.matching_terms(rows).select("review_id", joined("matching_terms").alias("matching"))


# ---- checks -----------------------------------------------------------------------------------

COUNTS = f"""{INDEX}, {EXPANSION}, {score_ctes('asked', 'q')}, {score_ctes('expanded', 'x')},
counts AS (
  SELECT a.query_id, coalesce(b.n, 0) AS base_count, coalesce(e.n, 0) AS expanded_count FROM asked a
  LEFT JOIN (SELECT query_id, count(*) AS n FROM q_score GROUP BY query_id) b USING (query_id)
  LEFT JOIN (SELECT query_id, count(*) AS n FROM x_score GROUP BY query_id) e USING (query_id))"""


def result_counts(d: Tables):
    model, index = blocks_of(d)
    expanded = expansion.expand(d.queries, d.synonyms).select("query_id", F.col("expanded_terms").alias("terms"))
    count = lambda terms, name: postings.match_counts(index, tfidf.query_weights(terms, model)).withColumnRenamed("n", name)
    both = d.queries.select("query_id").join(count(d.query_terms, "base_count"), "query_id", "left").join(
        count(expanded, "expanded_count"), "query_id", "left")
    return both.fillna(0, ["base_count", "expanded_count"])


@query("a23_recall_improvement", f"""WITH {COUNTS} SELECT 'recall_improvement' AS name, query_id, expanded_count >= base_count AS passed,
  base_count, expanded_count, expanded_count - base_count AS delta FROM counts""")
def _(d):
    return evaluation.recall_improvement(result_counts(d))


@query("a27_recall_ratio", f"WITH {COUNTS} SELECT query_id, round(expanded_count / nullif(base_count, 0), 6) AS ratio FROM counts")
def _(d):
    return evaluation.recall_ratio(result_counts(d)).withColumn("ratio", r6("ratio"))


@query("a25_expansion_not_empty", f"""WITH {EXPANSION} SELECT 'expansion_not_empty' AS name, query_id, len(terms) > 0 AS passed, len(terms) AS term_count FROM expanded""")
def _(d):
    return evaluation.expansion_not_empty(expansion.expand(d.queries, d.synonyms)).withColumn("term_count", big("term_count"))


MATCHED = f"""{RANKED}, review_words AS MATERIALIZED (
  SELECT DISTINCT review_id, unnest({sql_words('lower(text)')}) AS term FROM reviews),
hit_terms AS (
  SELECT DISTINCT k.query_id, k.review_id, w.term FROM ranked k JOIN review_words w USING (review_id)
  JOIN (SELECT DISTINCT query_id, unnest(terms) AS term FROM asked) a ON a.query_id = k.query_id AND a.term = w.term)"""


def matched_of(d: Tables):
    """The ranked ids are few beside the texts: stored and counted, they pick theirs without moving the others."""
    ranked = materialize(ranked_of(d), "ranked")
    rows = d.reviews.select("review_id", "text").join(small(ranked, ranked.count()), "review_id").join(d.query_terms, "query_id")
    return tfidf.matching_terms(rows)


@query("a28_term_coverage", f"""WITH {MATCHED}
SELECT k.query_id, round(count(DISTINCT h.review_id) / count(DISTINCT k.review_id), 6) AS coverage
FROM ranked k LEFT JOIN hit_terms h ON h.query_id = k.query_id AND h.review_id = k.review_id GROUP BY k.query_id""")
def _(d):
    return evaluation.term_coverage(matched_of(d)).withColumn("coverage", r6("coverage"))


@query("a29_top_matching_terms", f"""WITH {MATCHED} SELECT query_id, term, count(*) AS n_reviews FROM hit_terms GROUP BY query_id, term""")
def _(d):
    return evaluation.top_matching_terms(matched_of(d))
