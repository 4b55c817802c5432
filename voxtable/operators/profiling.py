"""Corpus profile: distributions, lengths, vocabulary, phrases, terms, context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from voxtable.functions import lexicons as lex, text as tx
from voxtable.operators.rows import exploded, numbered
from voxtable.sources.scratch import literal_table


def rating_distribution(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("rating").agg(F.count("*").alias("n"))


def corpus_stats(reviews: DataFrame) -> DataFrame:
    has_sentences = "sentences" in reviews.columns
    return reviews.agg(F.count("*").alias("total_reviews"), F.avg(F.length("text")).alias("avg_text_length"),
                       F.lit(has_sentences).alias("has_sentences"))


def length_stats(reviews: DataFrame) -> DataFrame:
    """One row for characters, one for words: mean, median, min, max, sample deviation.

    Lengths repeat, so the exact median works on a histogram of lengths.
    """
    def stats(c, p):
        return [F.avg(c).alias(f"{p}_mean"), F.median(c).alias(f"{p}_median"), F.min(c).alias(f"{p}_min"),
                F.max(c).alias(f"{p}_max"), F.stddev_samp(c).alias(f"{p}_std")]

    sizes = reviews.select(F.length("text").alias("chars"), F.size(tx.whitespace_words("text")).alias("words"))
    wide = sizes.agg(*stats("chars", "c"), *stats("words", "w"))
    names = ["mean", "median", "min", "max", "std"]
    pack = [F.struct(F.lit(u).alias("unit"), *[F.col(f"{p}_{n}").cast("double").alias(n) for n in names])
            for u, p in (("characters", "c"), ("words", "w"))]
    return wide.select(F.inline(F.array(*pack)))


def top_counts(df: DataFrame, key: str, n: int) -> DataFrame:
    """Most common keys; ties in key order."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)


def vocabulary(reviews: DataFrame, top_n: int = 50, stop_words=lex.VOCABULARY_STOP_WORDS) -> DataFrame:
    words = exploded(reviews, [], tx.without(tx.latin_words("text", 3), stop_words), "word")
    return top_counts(words, "word", top_n)


def common_phrases(reviews: DataFrame, n: int = 2, top_k: int = 30, stop_words=lex.PHRASE_STOP_WORDS) -> DataFrame:
    """Contiguous phrases of one review; a phrase made only of stop words does not count."""
    phrases = exploded(reviews, [], tx.ngrams(tx.latin_words("text"), n), "phrase")
    ranked = phrases.groupBy("phrase").agg(F.count("*").alias("n"))
    other = F.size(F.array_except(F.split("phrase", " "), tx.string_array(stop_words))) > 0
    return ranked.where(other).orderBy(F.desc("n"), "phrase").limit(top_k)


def term_occurrences(reviews: DataFrame, terms, *carry: str) -> DataFrame:
    """(review, term) pairs for whole-word hits; one scan of each text for the whole list."""
    return exploded(reviews, ["review_id", *carry], tx.matched_words("text", terms), "term")


def term_frequencies(reviews: DataFrame, terms) -> DataFrame:
    """Reviews that contain each term, with the percent of the corpus; absent terms count 0."""
    counts = term_occurrences(reviews, terms).groupBy("term").agg(F.count("*").alias("n"))
    total = reviews.agg(F.count("*")).scalar()
    wanted = literal_table(reviews.sparkSession, {"term": list(terms)})
    n = F.coalesce("n", F.lit(0))
    return wanted.join(counts, "term", "left").select("term", n.alias("n"), (n / total * 100).alias("pct"))


def group_frequencies(reviews: DataFrame, groups: dict | None = None) -> DataFrame:
    """Document frequency of each term of each group, with the group total."""
    groups = groups or lex.SYNONYM_GROUPS
    pairs = [(g, t) for g, ts in groups.items() for t in [g, *ts]]
    terms = list(dict.fromkeys(t for _, t in pairs))
    counts = term_occurrences(reviews, terms).groupBy("term").agg(F.count("*").alias("n"))
    wanted = literal_table(reviews.sparkSession, {"primary_term": [p[0] for p in pairs], "term": [p[1] for p in pairs]})
    joined = wanted.join(counts, "term", "left").select("primary_term", "term", F.coalesce("n", F.lit(0)).alias("n"))
    return joined.withColumn("group_total", F.sum("n").over(W.partitionBy("primary_term")))


def term_ratings(reviews: DataFrame, terms) -> DataFrame:
    """Rating histogram and mean rating of the reviews that contain each term.

    The mean is weighted from the histogram, which has at most a row per term and rating.
    """
    hist = term_occurrences(reviews, terms, "rating").groupBy("term", "rating").agg(F.count("*").alias("n"))
    w = W.partitionBy("term")
    mean = F.sum(F.col("n") * F.col("rating")).over(w) / F.sum("n").over(w)
    return hist.select("term", "rating", "n", mean.alias("avg_rating"))


def reviews_with_term(reviews: DataFrame, term: str, limit: int = 5) -> DataFrame:
    """Case-insensitive pattern search; the term is a regular expression."""
    hits = reviews.where(F.coalesce(F.lower("text").rlike(term.lower()), F.lit(False)))
    return hits.orderBy(*tx.id_order()).limit(limit).select("text", "rating")


def reviews_with_word(reviews: DataFrame, term: str) -> DataFrame:
    return reviews.where(tx.has_word("text", term))


def cooccurring_words(reviews: DataFrame, terms, window: int = 5, top_n: int = 15,
                      stop_words=lex.CONTEXT_STOP_WORDS, reviews_per_term: int | None = None) -> DataFrame:
    """Words near tokens that contain one of the terms, in reviews with that term as a word.

    The windows are cut inside each row. ``reviews_per_term`` limits each term to its first
    reviews, as in a quick look; by default every review counts.
    """
    hits = term_occurrences(reviews, terms, "text")
    if reviews_per_term:
        w = W.partitionBy("term").orderBy(*tx.id_order())
        hits = hits.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= reviews_per_term)
    near = None
    for t in terms:
        branch = tx.context_words("text", t, window)
        near = F.when(F.col("term") == t, branch) if near is None else near.when(F.col("term") == t, branch)
    words = exploded(hits, [], near, "word").where(F.col("word").rlike("^[a-z]{3,}$"))
    drop = set(stop_words) | {t.lower() for t in terms}
    return top_counts(words.where(~F.col("word").isin(sorted(drop))), "word", top_n)


def keyword_in_context(reviews: DataFrame, term: str, window: int = 5) -> DataFrame:
    return numbered(reviews, ["review_id"], tx.context_windows("text", term, window), "hit", "context")


def examples_per_term(reviews: DataFrame, terms, m: int = 3) -> DataFrame:
    """First m reviews per term with an excerpt around the term.

    Only ids go through the ranking; the texts of the few winners are joined back.
    """
    hits = term_occurrences(reviews, terms)
    w = W.partitionBy("term").orderBy(*tx.id_order())
    top = hits.withColumn("example", F.row_number().over(w)).where(F.col("example") <= m)
    out = reviews.join(F.broadcast(top), "review_id")  # at most m rows per listed term
    return out.select("term", "example", "review_id", "rating", tx.clean_excerpt("text", F.col("term")).alias("excerpt"))


def first_snippets(reviews: DataFrame, terms, limit: int = 3) -> DataFrame:
    """Snippet of the first matching review per term, the first ``limit`` terms in list order."""
    hits = term_occurrences(reviews, terms)
    first = hits.groupBy("term").agg(F.min_by("review_id", F.struct(F.length("review_id"), "review_id")).alias("review_id"))
    ranks = literal_table(reviews.sparkSession, {"term": list(terms), "term_order": list(range(len(terms)))})
    chosen = ranks.join(first, "term").orderBy("term_order").limit(limit)
    out = reviews.join(F.broadcast(chosen), "review_id")  # at most ``limit`` rows
    return out.select("term_order", "term", tx.snippet("text", F.col("term")).alias("snippet"))
