"""Text expressions against hand-made values and plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from voxtable.functions import lexicons as lex, text as tx


def one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "text string").select(*columns).first()


def test_stop_words_equal_spark_default(spark):
    from pyspark.ml.feature import StopWordsRemover

    default = [w for w in StopWordsRemover.loadDefaultStopWords("english") if re.fullmatch(r"\w\w+", w)]
    assert sorted(default) == sorted(lex.SEARCH_STOP_WORDS)


@pytest.mark.parametrize("text", ["Café_1 au-lait, naïve x", "don't STOP!", "a b\tc", "", "½ kg ⅷ 二"])
def test_words_like_python(spark, text):
    row = one(spark, text, tx.word_runs("text").alias("w"), tx.whitespace_words("text").alias("s"), tx.latin_words("text", 3).alias("l"))
    assert row["w"] == re.findall(r"\w+", text.lower())
    assert row["s"] == text.split()
    assert row["l"] == re.findall(r"\b[a-z]{3,}\b", text.lower())


def test_normal_space(spark):
    assert one(spark, "  a \n\x1cb  ", tx.normalize_space("text").alias("t"))["t"] == "a b"


def test_terms_and_counts(spark):
    row = one(spark, "fast app and fast app", tx.search_terms("text").alias("t"), tx.term_counts(tx.search_terms("text")).alias("c"))
    assert row["t"] == ["fast", "app", "fast", "app", "fast app", "app fast", "fast app"]
    assert {(c["term"], c["tf"]) for c in row["c"]} == {("fast", 2), ("app", 2), ("fast app", 2), ("app fast", 1)}
    assert one(spark, "the", tx.term_counts(tx.search_terms("text")).alias("c"))["c"] == []


def test_ngrams_short(spark):
    assert one(spark, "one", tx.ngrams(tx.latin_words("text"), 2).alias("n"))["n"] == []


def test_matched_words_are_whole_and_ordered(spark):
    terms = ["user-friendly", "fast", "user", "os"]
    row = one(spark, "A user-friendly tool, cost is low; fast.", tx.matched_words("text", terms).alias("m"))
    assert row["m"] == ["user-friendly", "fast", "user"]


@pytest.mark.parametrize("text,expected", [
    ("Great software. Works well.", ["Great software.", "Works well."]),
    ("Ask Dr. Who! Now", ["Ask Dr. Who!", "Now"]),
    ('He said "no." Then left.', ['He said "no."', "Then left."]),
    ("no end", ["no end"]),
])
def test_sentences(spark, text, expected):
    assert one(spark, text, tx.sentences("text").alias("s"))["s"] == expected


def test_review_sentences_fall_back(spark):
    assert one(spark, "  ", tx.review_sentences("text").alias("s"))["s"] == ["  "]


def test_excerpts(spark):
    text = "First one. The <b>slow</b> app. Third"
    row = one(spark, text, tx.clean_excerpt("text", "slow").alias("e"), tx.snippet("text", "SLOW").alias("s"),
              tx.clean_excerpt("text", "zzz", 5).alias("h"), tx.cut("text", 5).alias("c"))
    assert row["e"] == "The slow app"
    assert row["s"] == "The <b>slow</b> app"
    assert row["h"] == "First..."
    assert row["c"] == "First..."


def test_context(spark):
    row = one(spark, "a b c d crashed e f", tx.context_windows("text", "crash", 2).alias("w"))
    assert row["w"] == ["c d crashed e f"]


@pytest.mark.parametrize("value", [0.975, 0.125, 2.675, 0.5, 1234.005])
def test_fixed_like_python(spark, value):
    got = spark.createDataFrame([(value,)], "v double").select(tx.fixed("v", 2).alias("f")).first()["f"]
    assert got == f"{value:.2f}"


def test_ids_and_stars(spark):
    row = spark.range(1).select(tx.formatted_id(F.lit(42)).alias("a"), tx.formatted_id(F.lit(12345678)).alias("b"),
                                tx.rating_stars(F.lit(2)).alias("s")).first()
    assert (row["a"], row["b"], row["s"]) == ("R000042", "R12345678", "★★☆☆☆")


def test_sentences_take_no_pattern_for_white_space_and_plain_texts(spark):
    """Ends are trimmed without a pattern, and the pattern of abbreviations runs only where one occurs; the same sentences as by patterns."""
    texts = ["\u3000 Dr. No came.\x85 He left!\x1e\x1d \n", "St.Mr. x etc. y.", " \t\u2029", "Plain text. More \u200b text?  \r\n", "", None, "\x00a. b", "No abbreviation here.) Yes."]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    strip = lambda c: F.regexp_replace(c, f"^{tx.SPACE}+|{tx.SPACE}+$", "")
    t = F.translate("text", tx.SENTENCE_END + tx.KEPT_DOT, "  ")
    t = F.regexp_replace(t, f"(^|[^{tx.WORD_CHARS}])({'|'.join(lex.ABBREVIATIONS)})\\.", f"$1$2{tx.KEPT_DOT}")
    t = F.regexp_replace(t, f"([.!?][\"')\\]]*){tx.SPACE}+", f"$1{tx.SENTENCE_END}")
    plain = F.filter(F.transform(F.split(t, tx.SENTENCE_END), lambda s: strip(F.translate(s, tx.KEPT_DOT, "."))), lambda s: s != "")
    rows = df.select(tx.sentences("text").alias("a"), plain.alias("b"), tx.strip("text").alias("c"), strip("text").alias("d")).collect()
    assert all(r["a"] == r["b"] and r["c"] == r["d"] for r in rows) and max(len(r["a"] or []) for r in rows) == 2
    plan = df.select(tx.strip("text"), tx.is_blank("text"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan
