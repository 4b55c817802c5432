"""Retrieval, expansion and term filtering."""

import math
import random

import pytest
from pyspark.sql import functions as F

from voxtable.operators import evaluation, expansion, tfidf

DOCS = [("1", "kettle boils water quickly"), ("2", "the handle melted"), ("3", "lid leaks after weeks")]


def docs(spark, rows=DOCS):
    return spark.createDataFrame(rows, "review_id string, text string")


def search(spark, rows, terms, k):
    corpus = docs(spark, rows)
    model = tfidf.fit(corpus)
    queries = spark.createDataFrame([(1, terms)], "query_id int, terms array<string>")
    return tfidf.retrieve(tfidf.transform(corpus, model), queries, model, k).orderBy("rank").collect()


@pytest.mark.parametrize("rows,terms,k,expected", [
    (DOCS, ["kettle", "lid"], 2, {"1", "3"}),
    ([], ["kettle"], 5, set()),
    (DOCS, [], 5, set()),
    (DOCS, ["spoon"], 5, set()),
    (DOCS, ["kettle", "handle"], 100, {"1", "2"}),
    (DOCS, ["kettle"], 0, set()),
])
def test_retrieve(spark, rows, terms, k, expected):
    assert {r["review_id"] for r in search(spark, rows, terms, k)} == expected


def test_scores_fall_and_stay_in_range(spark):
    rows = [("1", "shipping"), ("2", "shipping shipping shipping"), ("3", "shipping fast")]
    scores = [r["score"] for r in search(spark, rows, ["shipping"], 10)]
    assert scores == sorted(scores, reverse=True) and all(0 < s <= 1 + 1e-9 for s in scores)


def brute_force(rows, terms, stop):
    import re

    def grams(text):
        ws = [w for w in re.findall(r"\w\w+", text.lower()) if w not in stop]
        return ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])]

    df = {}
    for _, text in rows:
        for g in set(grams(text)):
            df[g] = df.get(g, 0) + 1

    def vector(text):
        v = {}
        for g in grams(text):
            if g in df:
                v[g] = v.get(g, 0) + math.log((1 + len(rows)) / (1 + df[g])) + 1
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / norm for g, x in v.items()}

    q = vector(" ".join(terms))
    return {i: s for i, t in rows if (s := sum(w * q.get(g, 0) for g, w in vector(t).items())) > 0}


def test_cosine_equals_brute_force(spark):
    rng = random.Random(7)
    words = "slow fast app crash menu price café the and support update".split()
    rows = [(f"{i:03d}", " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(60)]
    terms = ["slow", "app", "café"]
    want = brute_force(rows, terms, {"the", "and"})
    got = {r["review_id"]: r["score"] for r in search(spark, rows, terms, 100)}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    corpus = docs(spark, rows)
    single = {r["review_id"]: r["score"] for r in tfidf.retrieve_one(corpus, terms, tfidf.fit(corpus), 100).collect()}
    assert single.keys() == want.keys() and all(abs(single[i] - want[i]) < 1e-9 for i in want)


@pytest.mark.parametrize("size", [3, 10, 40, 10_000])
def test_pruned_vocabulary_equals_full_one(spark, size):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    rows = [(str(i), " ".join(rng.choices(words, weights=range(1, 31), k=15))) for i in range(80)]
    corpus = docs(spark, rows)
    best = lambda t: [tuple(r) for r in t.orderBy(F.desc("total"), "term").limit(size).select("term", "total", "df").collect()]
    assert best(tfidf.frequent_term_totals(corpus, size)) == best(tfidf.term_totals(corpus))


def test_matching_terms(spark):
    rows = spark.createDataFrame([("shipping was fast and delivery reliable", ["shipping", "Delivery", "price"])], "text string, terms array<string>")
    assert tfidf.matching_terms(rows).first()["matching_terms"] == ["shipping", "Delivery"]


SYN = [("fast", "quick", 1), ("fast", "rapid", 2), ("fast", "high_speed", 1), ("shipping", "delivery", 1), ("good", "great", 1),
       ("good", "fine", 2), ("good", "nice", 3), ("good", "solid", 4), ("product", "item", 1)]


def expand(spark, query, width=3, depth=2):
    queries = spark.createDataFrame([(1, query)], "query_id int, query string")
    syn = spark.createDataFrame(SYN, "word string, syn string, rank int")
    return expansion.expand(queries, syn, width, depth).first()


def test_expansion_cases(spark):
    row = expand(spark, "fast shipping")
    assert row["expanded_terms"][:2] == ["fast", "shipping"] and len(row["expanded_terms"]) > 2
    assert not any("_" in t for t in row["expanded_terms"])
    assert expand(spark, "fast shipping", depth=0)["expanded_terms"] == ["fast", "shipping"]
    assert expand(spark, "fast shipping", depth=0)["beam_paths"] == []
    blank = expand(spark, "  ")
    assert blank["expanded_terms"] == [] and blank["beam_paths"] == []
    assert expand(spark, "xyzabc123")["expanded_terms"] == ["xyzabc123"]
    assert len(expand(spark, "good product", 1)["beam_paths"]) <= len(expand(spark, "good product", 3)["beam_paths"])


def test_beam_follows_the_plain_algorithm(spark):
    syn = {}
    for w, s, _ in sorted(SYN, key=lambda r: r[2]):
        if "_" not in s:
            syn.setdefault(w, []).append(s)
    query, width = "good fast product", 2
    o, beam, paths = set(query.split()), [(query, [query])], []
    for _ in range(2):
        cands = []
        for text, path in beam:
            words = text.split()
            for i, w in enumerate(words):
                for s in syn.get(w, []):
                    new = " ".join(words[:i] + [s] + words[i + 1:])
                    e = set(new.split())
                    cands.append((len(e - o) * 0.4 + len(o & e) / len(o) * 0.5 + 0.1, new, path + [new]))
        cands.sort(key=lambda c: -c[0])
        beam = [(c[1], c[2]) for c in cands[:width]]
        paths += [(c[2], round(c[0], 9)) for c in cands[:width]]
    row = expand(spark, query, width)
    assert [(p["path"], round(p["score"], 9)) for p in row["beam_paths"]] == paths
    assert set(row["expanded_terms"]) == o | {w for t, _ in beam for w in t.split()}


def test_expansion_scores(spark):
    score = lambda a, b: spark.range(1).select(expansion.expansion_score(
        F.split(F.lit(a), " "), F.split(F.lit(b), " ")).alias("s")).first()["s"]
    assert abs(score("fast", "quick") - 0.5) < 1e-12
    assert abs(score("fast shipping", "quick shipping") - 0.75) < 1e-12
    assert abs(score("fast", "fast") - 0.6) < 1e-12


def test_term_filter(spark):
    expanded = spark.createDataFrame([(1, "bug", ["glitch", "pester", "bug"]), (2, "", [])], "query_id int, original_query string, expanded_terms array<string>")
    full = spark.createDataFrame([("glitch", True), ("pester", False), ("bug", True)], "term string, is_relevant boolean")
    part = full.where(F.col("term") == "glitch")
    result = lambda cache, **kw: {r["query_id"]: r["filtered_terms"] for r in expansion.filter_terms(expanded, cache, **kw).collect()}
    assert result(full) == {1: ["glitch", "bug"], 2: []}
    assert result(part) == {1: ["glitch", "bug"], 2: []}
    assert result(part, undecided="keep")[1] == ["glitch", "pester", "bug"]
    assert [r["term"] for r in expansion.undecided_terms(expanded, part).collect()] == ["pester"]


@pytest.mark.parametrize("query,expected", [
    ("How many guests wrote about leaks?", True), ("What did buyers say of the lid?", True), ("buyers content?", True),
    ("lid leak rust", False), ("weak handle", False), ("", False), ("i feel it is the best", True)])
def test_question_detector(spark, query, expected):
    assert spark.createDataFrame([(query,)], "q string").select(expansion.looks_like_question("q").alias("x")).first()["x"] is expected


def test_keywords(spark):
    queries = spark.createDataFrame([(1, "How many guests wrote about leaks?"), (2, "lid Leak")], "query_id int, query string")
    plain = {r["query_id"]: r for r in expansion.query_keywords(queries).collect()}
    assert "leaks?" in plain[1]["extracted_keywords"] and plain[2]["extracted_keywords"] == ["lid", "leak"]
    given = spark.createDataFrame([(1, ["Leak", "rust"]), (2, ["never"])], "query_id int, keywords array<string>")
    over = {r["query_id"]: r for r in expansion.query_keywords(queries, given).collect()}
    assert over[1]["extracted_keywords"] == ["leak", "rust"] and over[1]["was_preprocessed"]
    assert over[2]["extracted_keywords"] == ["lid", "leak"] and not over[2]["was_preprocessed"]


def test_score_order_check(spark):
    rows = [(1, 1, 0.9), (1, 2, 0.9), (1, 3, 0.4), (2, 1, 0.4), (2, 2, 0.9)]
    out = evaluation.score_ordering(spark.createDataFrame(rows, "query_id int, rank int, score double"))
    assert {r["query_id"]: r["passed"] for r in out.collect()} == {1: True, 2: False}


def test_salted_scores_equal_broadcast_ones(spark, monkeypatch):
    corpus = docs(spark)
    model = tfidf.fit(corpus)
    queries = spark.createDataFrame([(1, ["kettle", "handle"]), (2, ["lid", "quickly"])], "query_id int, terms array<string>")
    run = lambda: sorted(map(tuple, tfidf.retrieve(tfidf.transform(corpus, model), queries, model, 10).collect()))
    plain = run()
    monkeypatch.setattr(tfidf, "BROADCAST_ROWS", 0)
    assert run() == plain and plain
