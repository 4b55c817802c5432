"""TF-IDF: vocabulary, weights, index, retrieval.

Terms are counted inside each row, so the only wide shuffle of a fit is the vocabulary count,
which combines on the map side. The fitted vocabulary has a fixed maximum number of rows and
is stored as a small table.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from voxtable.functions import lexicons as lex, text as tx
from voxtable.operators import counting
from voxtable.operators.rows import unpacked
from voxtable.sources.scratch import BROADCAST_ROWS, literal_table, materialize, small


class TfidfModel(NamedTuple):
    vocabulary: DataFrame  # term, total, df, idf
    n_docs: int
    max_features: int
    stop_words: list


def counted_terms(docs: DataFrame, *keys: str, text: str = "text", stop_words=None) -> DataFrame:
    """One row per document: its keys and ARRAY<STRUCT<term, tf>>."""
    return docs.select(*keys, tx.term_counts(tx.search_terms(text, stop_words)).alias("terms"))


def _totals(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))


def term_totals(docs: DataFrame, key: str = "review_id", stop_words=None) -> DataFrame:
    """(term, total, df) of every unigram and bigram."""
    return _totals(unpacked(counted_terms(docs, key, stop_words=stop_words), [], "terms", "term"))


def frequent_term_totals(docs: DataFrame, max_features: int, stop_words=None) -> DataFrame:
    """Totals of a set of terms that surely holds the ``max_features`` most frequent ones.

    A bigram is never more frequent than either of its words, and the words alone already set
    a floor: the total of the word in place ``max_features``. Bigrams with a word under that
    floor cannot qualify and are dropped before the shuffle. The long tail of rare bigrams,
    most of the shuffle on a large corpus, is never sent; the price is a second pass over the text.
    """
    words = materialize(counting.word_totals(docs, stop_words), "word-totals")
    floor = frequency_floor(words, max_features)
    frequent = words.where(F.col("total") >= floor).select("term")
    n_frequent = frequent.count()  # ties at the floor can make it larger than max_features
    if n_frequent <= BROADCAST_ROWS:
        known = sorted(r["term"] for r in frequent.collect())
        pairs = counting.pair_totals(docs, known, stop_words).where(F.col("total") >= floor)
        pairs = pairs.withColumns({"first": F.expr(f"int(pair div {max(n_frequent, 1)})"), "second": F.expr(f"int(pair % {max(n_frequent, 1)})")})
        for side in ("first", "second"):
            named = literal_table(docs.sparkSession, {side: pa.array(range(n_frequent), pa.int32()), f"{side}_word": pa.array(known, pa.string())})
            pairs = pairs.join(F.broadcast(named), side)
        return words.where(F.col("total") >= floor).unionByName(
            pairs.select(F.concat_ws(" ", "first_word", "second_word").alias("term"), "total", "df"))
    kept = tx.without(tx.search_tokens("text"), lex.SEARCH_STOP_WORDS if stop_words is None else stop_words)
    pairs = unpacked(docs.select(tx.let(kept, lambda ts: tx.term_counts(tx.ngrams(ts, 2))).alias("terms")), [], "terms", "term")
    pairs = pairs.withColumns({"first": F.substring_index("term", " ", 1), "second": F.substring_index("term", " ", -1)})
    for side in ("first", "second"):
        pairs = pairs.join(frequent.select(F.col("term").alias(side)), side, "left_semi")
    return words.unionByName(_totals(pairs)).where(F.col("total") >= floor)


def frequency_floor(totals: DataFrame, n: int) -> int:
    """The n-th largest total (0 when there are fewer rows), from the histogram of totals.

    Only the distinct totals are sorted, never the terms.
    """
    histogram = totals.groupBy("total").agg(F.count("*").alias("terms"))
    running = F.sum("terms").over(W.orderBy(F.desc("total")))
    reached = histogram.withColumn("running", running).where(F.col("running") >= n)
    return reached.agg(F.max("total")).first()[0] or 0


def vocabulary_table(docs: DataFrame, n_docs: int, max_features: int, key: str = "review_id",
                     stop_words=None) -> DataFrame:
    """The ``max_features`` most frequent terms (ties in term order) with df and idf."""
    totals = frequent_term_totals(docs, max_features, stop_words)
    top = totals.orderBy(F.desc("total"), "term").limit(max_features)
    return top.withColumn("idf", F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1)


def fit(docs: DataFrame, max_features: int = 10_000, key: str = "review_id", stop_words=None,
        n_docs: int | None = None) -> TfidfModel:
    n_docs = docs.count() if n_docs is None else n_docs
    vocab = materialize(vocabulary_table(docs, n_docs, max_features, key, stop_words), "vocabulary")
    return TfidfModel(vocab, n_docs, max_features, list(lex.SEARCH_STOP_WORDS if stop_words is None else stop_words))


def known_terms(terms: DataFrame, max_features: int, *columns: str) -> list | None:
    """The rows of a model's terms for the tasks that count them; None where they are too many to hold."""
    return terms.where(F.col("term").isNotNull()).select("term", "idf", *columns).collect() if max_features <= BROADCAST_ROWS else None


def weight_lists(docs: DataFrame, model: TfidfModel, *keys: str, text: str = "text") -> DataFrame:
    """(keys, lists ARRAY<ARRAY<STRUCT<term, w = tf * idf>>>, norm) of the known terms, one row per distinct keys.

    A document's weights are one array; the shuffle by the keys moves it as it is and brings rows of the same keys together. A
    single key is looked at first: where no two rows share one, there is nothing to bring together and no shuffle.
    """
    known = known_terms(model.vocabulary, model.max_features)
    if known is not None:
        own = counting.weights(docs, [r["term"] for r in known], [r["idf"] for r in known], *keys, text=text, stop_words=model.stop_words)
        if len(keys) == 1 and docs.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1).isEmpty():
            return own.select(*keys, F.array("ws").alias("lists"), F.sqrt("square").alias("norm"))
        return own.groupBy(*keys).agg(F.collect_list("ws").alias("lists"), F.sqrt(F.sum("square")).alias("norm"))
    met = raw_weights(docs, model, *keys, text=text)
    return met.groupBy(*keys).agg(F.array(F.collect_list(F.struct("term", "w"))).alias("lists"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def raw_weights(docs: DataFrame, model: TfidfModel, *keys: str, text: str = "text") -> DataFrame:
    """(keys, term, w = tf * idf) for the known terms, counted inside each row; the vocabulary side is small."""
    exploded = unpacked(counted_terms(docs, *keys, text=text, stop_words=model.stop_words), list(keys), "terms", "term")
    known = exploded.join(small(model.vocabulary.select("term", "idf"), model.max_features), "term")
    return known.select(*keys, "term", (F.col("tf") * F.col("idf")).alias("w"))


def transform(docs: DataFrame, model: TfidfModel, *keys: str, text: str = "text", packed: bool = False) -> DataFrame:
    """L2-normalised weights (keys, term, weight).

    The known terms of one document are gathered again to divide by their norm; a document is
    one input row, so the group is bounded by that row. One shuffle of the kept terms, none for a
    corpus bucketed by the keys. ``packed`` counts in Arrow batches, several times faster, and
    shuffles one array a document, for bucketed tables too.
    """
    keys = keys or ("review_id",)
    if packed:
        lists = weight_lists(docs, model, *keys, text=text).select(*keys, "norm", F.explode_outer("lists").alias("ws"))
        flat = unpacked(lists, [*keys, "norm"], "ws", "term")
    else:
        vectors = raw_weights(docs, model, *keys, text=text).groupBy(*keys).agg(
            F.collect_list(F.struct("term", "w")).alias("ws"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        flat = vectors.select(*keys, "norm", F.inline("ws"))
    return flat.select(*keys, "term", (F.col("w") / F.col("norm")).alias("weight"))


def query_weights(queries: DataFrame, model: TfidfModel) -> DataFrame:
    """Unit vectors of queries given as ordered term lists (query_id, terms)."""
    joined = queries.where(F.size("terms") > 0).select("query_id", F.array_join("terms", " ").alias("text"))
    return transform(joined, model, "query_id").withColumnRenamed("weight", "query_weight")


SALTS = 32


def score(postings: DataFrame, weights: DataFrame) -> DataFrame:
    """Cosine per (query, review) with at least one common term, so every score is positive.

    The query side is stored and counted: a small one is broadcast; a large one is repeated
    once per salt, so that the postings of a term found in most reviews meet it in many tasks.
    """
    weights = materialize(weights, "query-weights")
    n = weights.count()
    if n <= BROADCAST_ROWS:
        hits = postings.join(F.broadcast(weights), "term")
    else:
        salt = F.pmod(F.xxhash64("review_id"), F.lit(SALTS)).cast("int")
        repeated = weights.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = postings.withColumn("salt", salt).join(repeated, ["term", "salt"])
    return hits.groupBy("query_id", "review_id").agg(F.sum(F.col("weight") * F.col("query_weight")).alias("score"))


def top_k(scored: DataFrame, k: int = 500) -> DataFrame:
    """Best k reviews per query; scores equal to 9 decimals go in review order."""
    w = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), *tx.id_order())
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def retrieve(postings: DataFrame, queries: DataFrame, model: TfidfModel, k: int = 500) -> DataFrame:
    """(query_id, review_id, score, rank) for a whole table of queries."""
    return top_k(score(postings, query_weights(queries, model)), k)


def retrieve_one(docs: DataFrame, terms: list[str], model: TfidfModel, k: int = 500) -> DataFrame:
    """Top k for one term list straight from the texts.

    Norm and dot product are sums over the same rows, so one narrow aggregate per document
    replaces the index; the result is a distributed top-k without a global sort.
    """
    query = literal_table(docs.sparkSession, {"query_id": ["q"], "text": [" ".join(terms)]})
    wq = transform(query, model, "query_id").select("term", "weight")
    lookup = model.vocabulary.select("term", "idf").join(wq, "term", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    known = known_terms(lookup, model.max_features, "weight")
    if known is not None:
        factors = np.array([[r["weight"]] for r in known], "float64").reshape(-1, 1)
        own = counting.sums(docs, [r["term"] for r in known], [r["idf"] for r in known], factors, "review_id", stop_words=model.stop_words)
        per_doc = own.groupBy("review_id").agg(F.sum("s_0").alias("dot"), F.sqrt(F.sum("square")).alias("norm"))
    else:
        exploded = unpacked(counted_terms(docs, "review_id", stop_words=model.stop_words), ["review_id"], "terms", "term")
        w = F.col("tf") * F.col("idf")
        per_doc = exploded.join(lookup, "term").groupBy("review_id").agg(
            F.sum(w * F.col("weight")).alias("dot"), F.sqrt(F.sum(w * w)).alias("norm"))
    scored = per_doc.where(F.col("dot") > 0).select("review_id", (F.col("dot") / F.col("norm")).alias("score"))
    return scored.orderBy(F.desc(F.round("score", 9)), *tx.id_order()).limit(k)


def matching_terms(reviews: DataFrame, terms: str = "terms", text: str = "text") -> DataFrame:
    """Which of the row's terms occur in the row's text as whitespace-separated words."""
    words = tx.whitespace_words(F.lower(F.col(text)))
    found = tx.let(words, lambda ws: F.filter(F.col(terms), lambda t: F.array_contains(ws, F.lower(t))))
    return reviews.withColumn("matching_terms", found)
