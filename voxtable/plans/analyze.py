"""Answer a whole table of queries: expand, filter terms, retrieve, classify, reason, summarise.

Every result is a DataFrame keyed by query_id, so ten thousand queries are the same plan as one.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from voxtable.functions import text as tx
from voxtable.operators import classifier, expansion, hmm, labeling, postings, probability, sentiment, tfidf
from voxtable.sources.scratch import materialize, small


class Models(NamedTuple):
    index: tfidf.TfidfModel
    postings: DataFrame
    nb: classifier.NaiveBayesModel
    tables: DataFrame | None
    sequence_model: hmm.HmmModel | None
    synonyms: DataFrame | None = None
    term_cache: DataFrame | None = None
    keywords: DataFrame | None = None
    polarity: DataFrame | None = None


class Analysis(NamedTuple):
    keywords: DataFrame       # query_id, original_query, extracted_keywords, was_preprocessed
    expansion: DataFrame      # query_id, original_query, expanded_terms, beam_paths, filtered_terms
    candidates: DataFrame     # ranked, classified and flagged reviews per query
    analysed: DataFrame       # the candidates that count: kept ones, or all on fallback
    distribution: DataFrame   # query_id, predicted_topic, n over all candidates
    insights: DataFrame       # query_id, topic and four probabilities
    sequences: DataFrame      # query_id, review_id, states, transitions
    summary: DataFrame        # query_id, summary


NO_MATCH = "No matching reviews found for the current filters and query."


def summary_text(n: Column, topic: Column, p_pos: Column, p_neg: Column, rating: Column, length: Column) -> Column:
    full = F.format_string(
        "Analyzed %d reviews for topic '%s'. P(positive|topic)=%s, P(negative|topic)=%s. "
        "Average rating is %s/5. Average sentiment-sequence length is %s sentences.",
        n, topic, tx.fixed(p_pos, 2), tx.fixed(p_neg, 2), tx.fixed(rating, 2), tx.fixed(length, 1))
    return F.when(n > 0, full).otherwise(NO_MATCH)


def summaries(queries: DataFrame, analysed: DataFrame, insights: DataFrame, sequences: DataFrame) -> DataFrame:
    """One fixed sentence per query; queries without reviews get the no-match text."""
    ratings = analysed.groupBy("query_id").agg(F.count("*").alias("n"), F.avg("rating").alias("rating"))
    lengths = sequences.groupBy("query_id").agg(F.avg(F.size("sentiment_states")).alias("length"))
    joined = queries.select("query_id").join(insights, "query_id", "left").join(ratings, "query_id", "left") \
        .join(lengths, "query_id", "left")
    text = summary_text(F.coalesce("n", F.lit(0)), F.col("topic"), F.col("p_positive_given_topic"),
                        F.col("p_negative_given_topic"), F.col("rating"), F.coalesce("length", F.lit(0.0)))
    return joined.select("query_id", text.alias("summary"))


def query_insights(queries: DataFrame, tables: DataFrame | None) -> DataFrame:
    """(query_id, target_topic) -> the four probabilities; 0.5 everywhere without tables."""
    topic = labeling.coerce_topic("target_topic")
    names = ["p_positive_given_topic", "p_negative_given_topic", "p_high_rating_given_positive",
             "p_low_rating_given_negative"]
    if tables is None:
        return queries.select("query_id", topic.alias("topic"), *[F.lit(0.5).alias(n) for n in names])
    rows = probability.insights(tables)  # one row per topic
    return queries.select("query_id", topic.alias("topic")).join(F.broadcast(rows), "topic").select(
        "query_id", "topic", *names)


def analyze(queries: DataFrame, reviews: DataFrame, models: Models, top_k: int = 500, min_confidence: float = 0.5,
            beam_width: int = 3, max_depth: int = 2) -> Analysis:
    """``queries``: query_id, query and optionally topic_filter. ``reviews``: the review columns.

    The expanded queries, the candidates' reviews and their verdicts (top_k per query) are stored once; everything after
    them works on those small tables instead of repeating the expansion or the retrieval.
    """
    override = F.col("topic_filter") if "topic_filter" in queries.columns else F.lit(None).cast("string")
    targets = queries.select("query_id", "query", labeling.chosen_topic(override, labeling.detect_topic("query")).alias("target_topic"))
    keywords = expansion.query_keywords(queries, models.keywords)
    words = keywords.select("query_id", F.array_join("extracted_keywords", " ").alias("query"))
    expanded = expansion.expand(words, models.synonyms, beam_width, max_depth).drop("original_query") \
        .join(queries.select("query_id", F.col("query").alias("original_query")), "query_id")
    expanded = materialize(expanded, "expanded-queries")
    if models.term_cache is None:
        expanded = expanded.withColumn("filtered_terms", F.col("expanded_terms"))
    else:
        expanded = materialize(expanded.join(expansion.filter_terms(expanded, models.term_cache), "query_id"), "filtered-queries")

    terms = expanded.select("query_id", F.col("filtered_terms").alias("terms"))
    ranked = materialize(postings.retrieve_plain(models.postings, terms, models.index, top_k), "ranked")
    # The ranked ids are few beside the corpus; broadcast, they pick their reviews without moving the rest. As a filter (not as a
    # join) they come before computed columns, so only these reviews are split into sentences. A review that many queries found
    # is stored, classified and decoded once; the rows a query are ids and verdicts.
    n_ranked = ranked.count()
    picked = reviews.where(F.col("review_id").isin(small(ranked.select("review_id").distinct(), n_ranked)))
    picked = materialize(picked.withColumn("_row", F.monotonically_increasing_id()), "candidates")
    firsts = picked.groupBy("review_id").agg(F.min("_row").alias("_row"))
    single = picked.join(small(firsts.select("_row"), n_ranked), "_row", "left_semi")

    topics = classifier.predict(single.select("review_id", "text"), models.nb)
    scored = materialize(ranked.join(targets.select("query_id", "target_topic"), "query_id").join(topics, "review_id"), "classified")
    flagged = classifier.topic_filter(scored, "target_topic", min_confidence)
    counted = F.col("kept") | F.col("fallback_used")
    candidates = picked.drop("_row").join(flagged, "review_id")
    analysed = candidates.where(counted)

    stored = "sentences" if "sentences" in candidates.columns else None
    wanted = small(flagged.where(counted).select("review_id").distinct(), n_ranked)
    split = single.join(wanted, "review_id", "left_semi").select("review_id", tx.review_sentences("text", stored).alias("sentences"))
    observed = sentiment.observations(split, models.polarity)
    decoded = hmm.analyze(observed, models.sequence_model).join(split, "review_id")
    sequences = analysed.select("query_id", "review_id", "rank").join(decoded, "review_id").select(
        "query_id", "review_id", "rank", "sentences", "sentiment_states", "transitions")
    insight_rows = query_insights(targets, models.tables)
    summary = summaries(queries, analysed, insight_rows, sequences)
    return Analysis(keywords, expanded, candidates, analysed, classifier.topic_distribution(candidates), insight_rows,
                    sequences, summary)


def prompt_table(analysis: Analysis, max_reviews: int = 10, max_sequences: int = 5) -> DataFrame:
    """Per query the text a summary model would get: statistics, first sequences, first reviews.

    At most ``max_reviews`` + ``max_sequences`` ranked rows per query are gathered.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy("query_id").orderBy("rank")
    line = F.concat(F.lit("["), tx.plain_stars(F.col("rating")), F.lit("] "), tx.cut("text", 300))
    rows = analysis.analysed.select("query_id", "rank", line.alias("line")).withColumn("i", F.row_number().over(w))
    reviews = rows.where(F.col("i") <= max_reviews).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("i", "line"))).alias("r"))
    seqs = analysis.sequences.select("query_id", "rank", F.concat(
        "review_id", F.lit(": "), F.array_join("sentiment_states", ",")).alias("line")).withColumn("i", F.row_number().over(w))
    sequences = seqs.where(F.col("i") <= max_sequences).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("i", "line"))).alias("s"))
    counts = analysis.analysed.groupBy("query_id").agg(F.count("*").alias("n"))
    lines = lambda c, sep: F.array_join(F.transform(c, lambda x: x["line"]), sep)
    joined = analysis.insights.join(counts, "query_id").join(reviews, "query_id").join(sequences, "query_id", "left")
    head = F.format_string(
        "Review count: %d\nTopic: %s\nP(positive|topic): %s\nP(negative|topic): %s\n"
        "P(high_rating|positive): %s\nP(low_rating|negative): %s",
        "n", "topic", *[tx.fixed(c, 4) for c in (
            "p_positive_given_topic", "p_negative_given_topic", "p_high_rating_given_positive",
            "p_low_rating_given_negative")])
    return joined.select("query_id", head.alias("statistics"),
                         F.coalesce(lines("s", "\n"), F.lit("")).alias("sequences"), lines("r", "\n\n").alias("reviews"))


def sequence_cards(sequences: DataFrame, reviews: DataFrame) -> DataFrame:
    """Sequences of two or more sentences with the stars and head of their review, if it is there."""
    shown = sequences.where(F.size("sentiment_states") > 1)
    side = reviews.select("review_id", "rating", "text")
    joined = shown.join(side, "review_id", "left")
    return joined.select("review_id", tx.timeline("sentiment_states").alias("flow"),
                         F.coalesce(tx.rating_stars("rating"), F.lit("")).alias("stars"),
                         F.coalesce(tx.cut("text", 100), F.lit("")).alias("head"))
