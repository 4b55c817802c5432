"""Probability tables of the chain topic -> sentiment -> rating category.

One scan groups the corpus into at most topics x sentiments x categories counts; every table
and every answer is derived from those few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from voxtable.functions import lexicons as lex
from voxtable.operators.labeling import coerce_topic
from voxtable.sources.scratch import literal_table, materialize


def rating_category(rating="rating") -> Column:
    r = F.col(rating) if isinstance(rating, str) else rating
    return F.when(r <= 2, "low").when(r == 3, "medium").otherwise("high")


def inferred_sentiment(rating="rating", label: Column | None = None) -> Column:
    """The label where there is one, else by rating."""
    r = F.col(rating) if isinstance(rating, str) else rating
    by_rating = F.when(r >= 4, "positive").when(r <= 2, "negative").otherwise("neutral")
    return by_rating if label is None else F.coalesce(label, by_rating)


def as_evidence(reviews: DataFrame, *keys: str) -> DataFrame:
    """The keys, topic, sentiment, rating_category of each review; a missing topic counts as other."""
    topic = coerce_topic("topic") if "topic" in reviews.columns else F.lit("other")
    label = F.col("sentiment") if "sentiment" in reviews.columns else None
    return reviews.select(*keys, topic.alias("topic"), inferred_sentiment("rating", label).alias("sentiment"),
                          rating_category().alias("rating_category"))


def joint_counts(reviews: DataFrame) -> DataFrame:
    return as_evidence(reviews).groupBy("topic", "sentiment", "rating_category").agg(F.count("*").alias("n"))


def fit(reviews: DataFrame) -> DataFrame:
    """The fitted model: the joint counts as a stored table."""
    return materialize(joint_counts(reviews), "joint-counts")


def topic_prior(model: DataFrame) -> DataFrame:
    per = model.groupBy("topic").agg(F.sum("n").alias("n"))
    return per.select("topic", (F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1)))).alias("p"))


def _conditional(model: DataFrame, parent: str, child: str) -> DataFrame:
    """count(parent, child) / count(parent) over all pairs of seen states, 0 for unseen pairs."""
    seen = model.groupBy(parent, child).agg(F.sum("n").alias("n"))
    p = F.col("n") / F.sum("n").over(W.partitionBy(parent))
    return seen.select(parent, child, p.alias("p"))


def sentiment_given_topic(model: DataFrame) -> DataFrame:
    return _conditional(model, "topic", "sentiment")


def rating_given_sentiment(model: DataFrame) -> DataFrame:
    return _conditional(model, "sentiment", "rating_category")


def all_tables(model: DataFrame) -> DataFrame:
    """The three tables in one: (table_name, parent, state, p)."""
    prior = topic_prior(model).select(F.lit("topic").alias("table_name"), F.lit("").alias("parent"),
                                      F.col("topic").alias("state"), "p")
    s = sentiment_given_topic(model).select(F.lit("sentiment").alias("table_name"), F.col("topic").alias("parent"),
                                            F.col("sentiment").alias("state"), "p")
    r = rating_given_sentiment(model).select(F.lit("rating_category").alias("table_name"),
                                             F.col("sentiment").alias("parent"),
                                             F.col("rating_category").alias("state"), "p")
    return prior.unionByName(s).unionByName(r)


def insights(model: DataFrame, topics: list[str] | None = None) -> DataFrame:
    """Per topic: P(pos|topic), P(neg|topic), P(high|pos), P(low|neg).

    Unseen topic: 0.5 and 0.5. Unseen sentiment under a seen topic: 0. Unseen parent sentiment
    or rating state: 0.5.
    """
    wanted = literal_table(model.sparkSession, {"topic": list(topics or lex.TOPICS)})
    n = F.col("n")

    def count_of(*conditions: Column) -> Column:
        both = conditions[0]
        for c in conditions[1:]:
            both = both & c
        return F.sum(F.when(both, n).otherwise(0))

    sent = lambda s: F.col("sentiment") == s
    cat = lambda c: F.col("rating_category") == c
    per = model.groupBy("topic").agg(F.sum("n").alias("_n"), count_of(sent("positive")).alias("_pos"),
                                     count_of(sent("negative")).alias("_neg"))

    def tail(category: str, sentiment: str) -> Column:
        parent, state = count_of(sent(sentiment)), count_of(cat(category))
        return F.when((parent > 0) & (state > 0), count_of(sent(sentiment), cat(category)) / parent).otherwise(0.5)

    tails = model.agg(F.struct(tail("high", "positive").alias("h"), tail("low", "negative").alias("l"))).scalar()
    joined = wanted.join(per, "topic", "left").withColumn("_t", tails)
    half = F.lit(0.5)
    return joined.select(
        "topic",
        F.coalesce(F.col("_pos") / F.col("_n"), half).alias("p_positive_given_topic"),
        F.coalesce(F.col("_neg") / F.col("_n"), half).alias("p_negative_given_topic"),
        F.coalesce(F.col("_t.h"), half).alias("p_high_rating_given_positive"),
        F.coalesce(F.col("_t.l"), half).alias("p_low_rating_given_negative"))


def with_neutral(insight_rows: DataFrame) -> DataFrame:
    rest = 1 - F.col("p_positive_given_topic") - F.col("p_negative_given_topic")
    return insight_rows.withColumn("p_neutral_given_topic", F.greatest(F.lit(0.0), rest))


def rating_given_topic(model: DataFrame) -> DataFrame:
    """P(rating | topic), summed over sentiment."""
    s = sentiment_given_topic(model).withColumnRenamed("p", "ps")
    r = rating_given_sentiment(model).withColumnRenamed("p", "pr")
    return s.join(r, "sentiment").groupBy("topic", "rating_category").agg(
        F.sum(F.col("ps") * F.col("pr")).alias("p"))


def topic_given_rating(model: DataFrame) -> DataFrame:
    """Posterior P(topic | rating)."""
    prior = topic_prior(model).withColumnRenamed("p", "pt")
    joint = rating_given_topic(model).join(prior, "topic").withColumn("pj", F.col("p") * F.col("pt"))
    return joint.select("rating_category", "topic",
                        (F.col("pj") / F.sum("pj").over(W.partitionBy("rating_category"))).alias("p"))


def log_likelihood(model: DataFrame, held_out: DataFrame) -> DataFrame:
    """Log-likelihood of held-out rows; combinations the model never saw are counted apart."""
    rows = joint_counts(held_out).withColumnRenamed("n", "m")
    t = topic_prior(model).withColumnRenamed("p", "pt")
    s = sentiment_given_topic(model).withColumnRenamed("p", "ps")
    r = rating_given_sentiment(model).withColumnRenamed("p", "pr")
    joined = rows.join(t, "topic", "left").join(s, ["topic", "sentiment"], "left").join(
        r, ["sentiment", "rating_category"], "left")
    p = F.col("pt") * F.col("ps") * F.col("pr")
    return joined.agg(F.sum(F.col("m") * F.log(p)).alias("log_likelihood"), F.sum("m").alias("n_rows"),
                      F.sum(F.when(p.isNull(), F.col("m")).otherwise(0)).alias("n_impossible"))


# ---- folds ---------------------------------------------------------------------------------

def fold_counts(reviews: DataFrame, fold: Column) -> DataFrame:
    """Joint counts of each fold, from one pass; ``fold`` is an expression over ``reviews``. Few rows, stored."""
    own = as_evidence(reviews.withColumn("_fold", fold), "_fold").withColumnRenamed("_fold", "fold")
    return materialize(own.groupBy("fold", "topic", "sentiment", "rating_category").agg(F.count("*").alias("n")), "fold-counts")


def _without(counts: DataFrame, *keys: str) -> DataFrame:
    """(fold, keys, n) counted over all other folds: the total less the fold's own. Combinations seen nowhere else are left out."""
    own = counts.groupBy("fold", *keys).agg(F.sum("n").alias("own"))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    folds = counts.agg(F.collect_set("fold")).scalar()
    every = total.withColumn("folds", folds).withColumn("fold", F.explode("folds")).join(own, ["fold", *keys], "left")
    rest = every.select("fold", *keys, (F.col("total") - F.coalesce("own", F.lit(0))).alias("n"))
    return rest.where(F.col("n") > 0)


def cross_validated(counts: DataFrame) -> DataFrame:
    """(fold, log_likelihood, n_rows, n_impossible): each fold's rows under the tables of all other folds.

    Fitting is subtraction of counts, so five models cost one pass over the reviews. Rows whose combination the other folds never
    saw are counted apart.
    """
    share = lambda *given: F.col("n") / F.sum("n").over(W.partitionBy("fold", *given))
    t = _without(counts, "topic")
    s, r = _without(counts, "topic", "sentiment"), _without(counts, "sentiment", "rating_category")
    t, s, r = t.withColumn("pt", share()), s.withColumn("ps", share("topic")), r.withColumn("pr", share("sentiment"))
    held = counts.withColumnRenamed("n", "m")
    joined = (held.join(t.drop("n"), ["fold", "topic"], "left").join(s.drop("n"), ["fold", "topic", "sentiment"], "left")
              .join(r.drop("n"), ["fold", "sentiment", "rating_category"], "left"))
    p = F.col("pt") * F.col("ps") * F.col("pr")
    return joined.groupBy("fold").agg(F.sum(F.col("m") * F.log(p)).alias("log_likelihood"), F.sum("m").alias("n_rows"),
                                      F.sum(F.when(p.isNull(), F.col("m")).otherwise(0)).alias("n_impossible"))
