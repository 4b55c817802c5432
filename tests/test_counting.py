"""Terms counted in Arrow batches are those of the column expressions, for odd texts too."""

import pytest
from pyspark.sql import functions as F

from voxtable.functions import lexicons as lex, text as tx
from voxtable.operators import classifier, counting, postings, tfidf

TEXTS = ["Fast app and fast APP, fast_app x", "Über straße café naïve Ñandú café", "ΣΊΣΥΦΟΣ İstanbul ſharp", "日本 日本語 ٣٤ ⅷⅷ 😀grin😀grin", "", None, "the and",
         "áb e­f snake_case 12ab", "fast app fast app²³", "one,two;one two", "ẞX KK"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(f"R{i % 10}" if i else None, t) for i, t in enumerate(TEXTS * 3)]
    return spark.createDataFrame(rows, "review_id string, text string").repartition(3)


def test_totals_equal_those_of_the_expressions(docs, monkeypatch):
    monkeypatch.setattr(counting, "SLICE", 64)
    for stop in (None, [], ["fast"]):
        found = {tuple(r) for r in tfidf.frequent_term_totals(docs, 10_000, stop).collect()}
        assert found == {tuple(r) for r in tfidf.term_totals(docs, stop_words=stop).collect()}
        assert any(" " in t for t, _, _ in found)


def test_weights_equal_those_of_the_join(docs):
    model = tfidf.fit(docs, 25)
    large = model._replace(max_features=10**6)  # too many for the tasks: the terms are joined
    flat = lambda m: sorted((r[0] or "", r[1], round(r[2], 9)) for r in tfidf.transform(docs, m, packed=True).collect())
    plain = sorted((r[0] or "", r[1], round(r[2], 9)) for r in tfidf.transform(docs, model).collect())
    assert flat(model) == flat(large) == plain and plain
    held = lambda m: sorted((r[0] or "", sorted((e["term"], round(e["weight"], 9)) for e in r[1])) for r in postings.vectors(docs, m).collect())
    assert held(model) == held(large)
    best = lambda m: [(r[0], round(r[1], 9)) for r in tfidf.retrieve_one(docs, ["fast", "café"], m, 50).collect()]
    assert sorted(best(model), key=str) == sorted(best(large), key=str)


def test_class_scores_equal_those_of_the_join(docs):
    labeled = docs.withColumn("label", F.when(F.col("text").rlike("(?i)fast"), lex.TOPICS[0]).otherwise(lex.TOPICS[1]))
    model = classifier.fit(labeled, max_features=25)
    large = model._replace(tfidf=model.tfidf._replace(max_features=10**6))
    scores = lambda m: sorted((r[0] or "", [None if s is None else round(s, 9) for s in r[1]]) for r in classifier.class_scores(docs, m).collect())
    assert scores(model) == scores(large) and len(scores(model)) == 11


def test_the_text_is_not_matched_word_by_word(docs):
    """Counting takes no regular expression and no lambda a word: before, each pass over the text did."""
    model = tfidf.fit(docs, 25)
    for df in (tfidf.transform(docs, model, packed=True), postings.vectors(docs, model).select("review_id"), tfidf.retrieve_one(docs, ["fast"], model, 5)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "regexp_extract_all" not in plan


def test_weights_of_single_ids_are_not_shuffled(spark, docs):
    model = tfidf.fit(docs, 25)
    single = spark.createDataFrame([(f"R{i}", t) for i, t in enumerate(TEXTS)], "review_id string, text string").repartition(3)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    shown = lambda df: sorted((r[0], r[1], round(r[2], 9)) for r in df.collect())
    assert "ObjectHashAggregate" not in plan(tfidf.transform(single, model, packed=True)) and "ObjectHashAggregate" in plan(tfidf.transform(docs, model, packed=True))
    assert shown(tfidf.transform(single, model, packed=True)) == shown(tfidf.transform(single, model)) != []


def test_scores_of_numbered_terms_equal_those_of_named_ones():
    import numpy as np
    import pyarrow as pa

    matrix, terms = np.array([[1.0, 0.0], [0.5, 2.0]]), ["a", "b"]
    lists = [["a", "b"], [], ["b"]]
    batch = lambda xs, kind: pa.record_batch([pa.array(["x", "y", "z"]), pa.array(xs, pa.list_(kind)), pa.array([[0.1 * (i + 1) for i in range(len(l))] for l in lists])], ["r", "t", "w"])
    named = list(postings._best_scores(terms, matrix, 5)([batch(lists, pa.string())]))
    assert list(postings._best_scores(terms, matrix, 5)([batch([[terms.index(t) for t in l] for l in lists], pa.int32())])) == named and named[0].num_rows == 4


def test_corpus_words_are_counted_once(spark, folder):
    """Term cache and synonyms read one stored count, without a row a word of the texts."""
    from voxtable.plans.catalogue.base import Tables

    texts = ["Thon thing thonk thon, Thing_x über 12", "thonk thon and THE thingy", None, "", "the thing thonk"]
    spark.createDataFrame([(i, t, "en", "src1") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "thon things")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    d = Tables(spark, folder)
    plain = d.reviews.select(F.explode(F.array_distinct(tx.search_tokens("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    assert {tuple(r) for r in d.term_cache.collect()} == {(r["term"], r["df"] % 2 == 0) for r in plain.collect() if r["df"] > 1} != set()
    counts = {r[0]: r[1] for r in d.reviews.select(F.explode(tx.latin_words("text", 4)).alias("w")).groupBy("w").count().collect()}
    ranked = {f: sorted((w for w in counts if w[:4] == f), key=lambda w: (-counts[w], w))[:6] for f in {w[:4] for w in counts}}
    expected = {(w, s, i) for w in ("thon", "things") for i, s in enumerate(ranked[w[:4]], 1)}
    assert {tuple(r) for r in d.synonyms.collect()} == expected and len(expected) > 3
    assert "MapInArrow" not in d.synonyms._jdf.queryExecution().executedPlan().toString()
