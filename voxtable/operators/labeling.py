"""Keyword topics for reviews and queries, and the curation table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxtable.functions import lexicons as lex, text as tx
from voxtable.operators import positions


def label_struct(text, lexicon: dict) -> Column:
    """STRUCT<topic_label, confidence_score, matched_keywords> of one text.

    Substring hits per topic; the first topic in lexicon order wins ties, no hit gives 'other'.
    """
    c = F.col(text) if isinstance(text, str) else text
    empty = F.array().cast("array<string>")

    def pick(hits: Column) -> Column:
        sizes = F.transform(hits, lambda h: F.size(h))
        return tx.let(sizes, lambda ns: tx.let(F.array_position(ns, F.array_max(ns)).cast("int") - 1, lambda i: F.struct(
            F.when(F.get(ns, i) > 0, F.get(tx.string_array(lexicon), i)).otherwise("other").alias("topic_label"),
            F.get(ns, i).alias("confidence_score"),
            F.when(F.get(ns, i) > 0, F.get(hits, i)).otherwise(empty).alias("matched_keywords"))))

    def hits_of(lowered: Column) -> Column:
        found = [F.filter(tx.string_array(words), lambda k: F.contains(lowered, k)) for words in lexicon.values()]
        return tx.let(F.array(*found), pick)

    return tx.let(F.lower(c), hits_of)


def auto_label(reviews: DataFrame, lexicon: dict | None = None) -> DataFrame:
    """Adds topic_label, confidence_score and matched_keywords; no shuffle.

    The three columns come out of one generated row, so a later filter on one of them does
    not make the text be searched again.
    """
    return reviews.select("*", F.inline(F.array(label_struct("text", lexicon or lex.LABEL_TOPIC_KEYWORDS))))


def detect_topic(query, lexicon: dict | None = None) -> Column:
    """Topic of a query by substring hits of the short lexicon."""
    return label_struct(query, lexicon or lex.QUERY_TOPIC_KEYWORDS)["topic_label"]


def coerce_topic(topic) -> Column:
    c = F.col(topic) if isinstance(topic, str) else topic
    return F.when(c.isin(lex.TOPICS), c).otherwise(F.lit("other"))


def known_topic(topic) -> Column:
    """Topic, or null when it is not one of the known ones."""
    c = F.col(topic) if isinstance(topic, str) else topic
    return F.when(c.isin(lex.TOPICS), c)


def chosen_topic(override, detected: Column) -> Column:
    c = F.col(override) if isinstance(override, str) else override
    return F.coalesce(F.nullif(c, F.lit("")), detected)


def curation_table(sample: DataFrame) -> DataFrame:
    """Columns of the hand-verification file."""
    return sample.select(
        "review_id", "text", "rating", "title", "product_id",
        F.col("topic_label").alias("auto_topic"), "confidence_score", "matched_keywords",
        F.lit("").alias("verified_topic"), F.lit("").alias("notes"))


def label_distribution(labeled: DataFrame, label: str = "topic_label") -> DataFrame:
    """Count and percent per label. The total comes from the grouped rows, not a second scan."""
    counts = labeled.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(label, "n", (F.col("n") / total * 100).alias("pct"))


def dominant_label(labeled: DataFrame, label: str = "topic_label") -> DataFrame:
    counts = labeled.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    first = F.min_by(F.col(label), F.struct(-F.col("n"), F.col(label)))
    return counts.agg(first.alias("dominant_label"), F.max("n").alias("n"),
                      (F.max("n") / F.sum("n")).alias("share"))


def apply_verdicts(curated: DataFrame, verdicts: DataFrame, strict: bool = True) -> DataFrame:
    """Last verdict per row (by file, then position) replaces ``verified_topic``.

    ``strict`` leaves unknown row numbers out; otherwise they are appended as new rows.
    The last verdict is an aggregate, so repeated verdicts on one row combine before the shuffle.
    """
    last = verdicts.groupBy("row_index").agg(
        F.max_by("verified_topic", F.struct("file", "position")).alias("_verdict"))
    joined = curated.join(last, "row_index", "left" if strict else "full")
    return joined.withColumn("verified_topic", F.coalesce("_verdict", "verified_topic")).drop("_verdict")


def unknown_verdicts(curated: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdicts whose row number is not in the table."""
    return verdicts.join(curated.select("row_index"), "row_index", "left_anti")


def curation_progress(curated: DataFrame) -> DataFrame:
    done = F.col("verified_topic").isNotNull() & (F.col("verified_topic") != "")
    return curated.agg(F.count_if(done).alias("reviewed"), F.count("*").alias("total"))


def verification_accuracy(curated: DataFrame) -> DataFrame:
    """correct / (correct + wrong); rows without a verdict or marked ambiguous do not count."""
    judged = ~F.coalesce(F.col("verified_topic"), F.lit("")).isin("", "ambiguous")
    right = F.count_if(judged & (F.col("verified_topic") == F.col("auto_topic")))
    wrong = F.count_if(judged & (F.col("verified_topic") != F.col("auto_topic")))
    return curated.agg(right.alias("correct"), wrong.alias("wrong"),
                       (right / F.nullif(right + wrong, F.lit(0))).alias("accuracy"))


def page(table: DataFrame, start: int, size: int = 10, index: str = "row_index") -> DataFrame:
    """Rows [start, start + size) with a 500-character preview."""
    rows = table.where((F.col(index) >= start) & (F.col(index) < start + size))
    return rows.withColumn("preview", tx.cut("text", 500))


def page_by_id(table: DataFrame, start: int, size: int = 10, key: str = "review_id") -> DataFrame:
    """The page of a table without row numbers, in id order: the keys are counted, the page's rows are read."""
    return positions.page(table, start, size, key).withColumn("preview", tx.cut("text", 500))
