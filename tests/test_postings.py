"""Pruned retrieval gives the rows of the full join, reads less, and counts without pairs."""

import random

import pytest
from pyspark.sql import functions as F

from voxtable.operators import postings, tfidf


def exchanges(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in text.splitlines() if "Exchange hashpartitioning" in line]


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(8)
    common = [f"word{k}" for k in range(300)]
    rows = []
    for k in range(3000):
        ws = [common[min(int(r.expovariate(0.02)), 299)] for _ in range(r.randrange(3, 40))]
        rows.append((f"R{k:06d}", " ".join([*ws, *(["rarest"] * (k % 700 == 0)), *(["everywhere"] * (k % 3 == 0))])))
    rows += [(f"R{k:06d}", rows[5][1]) for k in range(3000, 3040)] + [("R009999", "")]
    docs = spark.createDataFrame(rows, "review_id string, text string").repartition(4)
    model = tfidf.fit(docs, 400)
    return docs, model, postings.build(postings.vectors(docs, model), 64)


QUERIES = [(1, ["word3", "word77", "rarest"]), (2, ["everywhere"]), (3, ["everywhere", "word0", "word1", "word2", "word200"]), (4, ["absent"]), (5, []),
           (6, [f"word{k}" for k in range(40)]), (7, ["word250", "word299"])]


@pytest.mark.parametrize("k", [1, 10, 500, 5000])
def test_same_rows_as_the_full_join(spark, corpus, k):
    docs, model, index = corpus
    queries = spark.createDataFrame(QUERIES, "query_id int, terms array<string>")
    plain = tfidf.retrieve(tfidf.transform(docs, model), queries, model, k).collect()
    found = postings.search(index, tfidf.query_weights(queries, model), k)
    ranked = found.ranked.collect()
    shown = lambda rows: sorted((r["query_id"], r["rank"], r["review_id"], round(r["score"], 9)) for r in rows)
    assert shown(ranked) == shown(plain)
    report = {r["query_id"]: r for r in found.report.collect()}
    assert set(report) == {1, 2, 3, 6, 7} and all(r["n_scored"] >= min(k, sum(x["query_id"] == q for x in plain)) for q, r in report.items())
    if k <= 10:
        assert report[3]["n_read"] < 0.4 * report[3]["n_postings"] and report[6]["n_read"] == report[6]["n_postings"]
        assert report[3]["n_scored"] < 900 and (k > 1 or report[2]["n_read"] < 0.2 * report[2]["n_postings"])


def test_counts_of_matching_reviews(spark, corpus):
    docs, model, index = corpus
    queries = spark.createDataFrame(QUERIES, "query_id int, terms array<string>")
    weights = tfidf.query_weights(queries, model)
    plain = {r["query_id"]: r["n"] for r in tfidf.score(tfidf.transform(docs, model), weights).groupBy("query_id").agg(F.count("*").alias("n")).collect()}
    counts = postings.match_counts(index, weights)
    assert len(exchanges(counts)) == 1 and "review_id" not in exchanges(counts)[0]
    assert {r["query_id"]: r["n"] for r in counts.collect()} == plain


@pytest.mark.parametrize("union_bytes, most_bits", [(1, 1 << 28), (64, 1 << 28), (1 << 23, 0)])
def test_counts_by_bits_and_by_pairs(spark, corpus, monkeypatch, union_bytes, most_bits):
    docs, model, index = corpus
    monkeypatch.setattr(postings, "UNION_BYTES", union_bytes)
    monkeypatch.setattr(postings, "MOST_BITS", most_bits)
    rows = [(k, [f"word{(k * j) % 300}" for j in range(k % 9)]) for k in range(60)] + [(None, ["everywhere"]), (7, ["rarest"])]
    weights = tfidf.query_weights(spark.createDataFrame(rows, "query_id long, terms array<string>"), model)
    held = [set(r["terms"]) for r in index.vectors.select(F.col("entries.term").alias("terms")).collect()]
    terms = {}
    for r in weights.collect():
        terms.setdefault(r["query_id"], set()).add(r["term"])
    expected = {q: n for q, ts in terms.items() if (n := sum(bool(ts & h) for h in held))}
    assert {r["query_id"]: r["n"] for r in postings.match_counts(index, weights).collect()} == expected


def test_counts_carry_no_copy_of_a_review_per_term(spark, corpus):
    _, model, index = corpus
    plan = postings.match_counts(index, tfidf.query_weights(spark.createDataFrame(QUERIES, "query_id int, terms array<string>"), model))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in text and "array_intersect" not in text


def test_blocks_split_a_frequent_term(corpus):
    _, _, index = corpus
    sizes = [r["n"] for r in index.blocks.where("term = 'everywhere'").collect()]
    assert sum(sizes) == 1000 and len(sizes) > 10 and max(sizes) < 150


def test_empty_index(spark):
    docs = spark.createDataFrame([], "review_id string, text string")
    model = tfidf.fit(docs)
    index = postings.build(postings.vectors(docs, model))
    queries = spark.createDataFrame([(1, ["a1"])], "query_id int, terms array<string>")
    assert postings.retrieve(index, queries, model).collect() == []


@pytest.mark.parametrize("k, cells", [(1, 1 << 20), (10, 1), (500, 4000), (5000, 1 << 20)])
def test_scan_of_vectors_gives_the_rows_of_the_full_join(spark, corpus, monkeypatch, k, cells):
    docs, model, index = corpus
    monkeypatch.setattr(postings, "SCAN", -1)
    monkeypatch.setattr(postings, "DENSE", 0)
    monkeypatch.setattr(postings, "SLICE", cells)
    monkeypatch.setattr(postings, "_pruned", None)  # not reached
    queries = spark.createDataFrame([*QUERIES, (None, ["word9", "rarest"])], "query_id int, terms array<string>")
    plain = tfidf.transform(docs, model)
    shown = lambda df: sorted((str(r["query_id"]), r["rank"], r["review_id"], round(r["score"], 9)) for r in df.collect())
    expected = shown(tfidf.retrieve(plain, queries, model, k))
    assert shown(postings.retrieve(index, queries, model, k)) == expected
    assert shown(postings.retrieve_plain(plain, queries, model, k)) == expected


def test_scan_hands_on_few_pairs(spark, corpus, monkeypatch):
    """Of a common word's thousand reviews a task hands on about k, not all."""
    docs, model, index = corpus
    monkeypatch.setattr(postings, "SLICE", 1)
    queries = spark.createDataFrame(QUERIES, "query_id int, terms array<string>")
    weights = tfidf.query_weights(queries, model).cache()
    pairs = tfidf.score(tfidf.transform(docs, model), weights).count()
    assert 60 <= postings.scanned(index.vectors.coalesce(1), weights, 10).count() < 0.2 * pairs
    monkeypatch.setattr(postings, "MOST_CELLS", 10)
    assert postings.scanned(index.vectors, weights, 10) is None


def test_matched_texts_are_not_moved(spark, monkeypatch):
    """The texts of all reviews meet the ranked ids where they lie."""
    from voxtable.plans.catalogue import searching

    monkeypatch.setattr(searching, "ranked_of", lambda d: spark.createDataFrame([(1, "R000001", 1, 0.5), (2, "R000001", 1, 0.4), (2, "R000009", 2, 0.3)],
                                                                                "query_id long, review_id string, rank int, score double"))

    class Few:
        reviews = spark.createDataFrame([(f"R{k:06d}", f"Thon text{k} que") for k in range(20)], "review_id string, text string")
        query_terms = spark.createDataFrame([(1, ["thon", "text2"]), (2, ["text9", "que"])], "query_id long, terms array<string>")

    matched = searching.matched_of(Few)
    assert not [line for line in exchanges(matched) if "review_id" in line]
    assert {(r["query_id"], r["review_id"], tuple(r["matching_terms"])) for r in matched.collect()} == {
        (1, "R000001", ("thon",)), (2, "R000001", ("que",)), (2, "R000009", ("text9", "que"))}


@pytest.mark.parametrize("most_bits, twice", [(1 << 28, False), (1 << 28, True), (0, False), (0, True)])
def test_repeated_ids_count_by_their_first_term(spark, monkeypatch, most_bits, twice):
    monkeypatch.setattr(postings, "MOST_BITS", most_bits)
    docs = spark.createDataFrame([("a", "fox owl"), ("a", "fox cat"), ("b", "owl owl"), ("c", "cat fox"), ("c", "cat fox"), (None, "owl"), ("d", "elk")], "review_id string, text string")
    model = tfidf.fit(docs)
    index = postings.build(postings.vectors(docs, model))
    asked = [(1, ["fox", "owl"]), (2, ["cat"]), (3, ["owl", "cat"]), (4, ["yak"])]
    weights = tfidf.query_weights(spark.createDataFrame(asked + asked[:2] * twice, "query_id int, terms array<string>"), model)
    # 1: fox twice in a, owl in b, fox twice in c, owl without an id; 2: cat in a, twice in c; 3: cat in a, owl in b, cat twice in c, owl
    times = 2 if twice else 1
    assert {r["query_id"]: r["n"] for r in postings.match_counts(index, weights).collect()} == {1: 6 * times, 2: 3 * times, 3: 5}
