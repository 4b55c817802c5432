"""Classifier, probability tables, sequences, stored models, stages."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtable.functions import lexicons as lex, text as tx
from voxtable.operators import classifier, hmm, probability, sentiment, tfidf
from voxtable.plans import analyze, prepare
from voxtable.sources import models, sinks, stage

TRAIN = [("1", "The scanner stalls daily and shows glitches", 1, "performance"),
         ("2", "Setup took a minute, menus feel natural", 5, "usability"),
         ("3", "The yearly fee climbed far above its value", 2, "pricing"),
         ("4", "Sync hangs and screens load late", 1, "performance"),
         ("5", "Clean menus that guests grasp at once", 4, "usability"),
         ("6", "Renewal fee is money down the drain", 2, "pricing")]


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame(TRAIN, "review_id string, text string, rating int, label string")


@pytest.fixture(scope="module")
def nb(train):
    return classifier.fit(train)


def test_predicts_performance(spark, nb):
    rows = spark.createDataFrame([("x", "My sync hangs for hours")], "review_id string, text string")
    row = classifier.predict(rows, nb).first()
    assert row["predicted_topic"] == "performance" and row["confidence"] > 0.3 and row["top_features"] == []


def test_text_without_known_terms_gets_the_prior(spark, nb):
    rows = spark.createDataFrame([("x", "zzz qqq"), ("y", "")], "review_id string, text string")
    out = classifier.predict(rows, nb).collect()
    assert len(out) == 2 and all(abs(r["confidence"] - 1 / 3) < 1e-9 and r["predicted_topic"] == "performance" for r in out)


def test_empty_inputs(spark, nb, train):
    assert classifier.predict(train.limit(0), nb).count() == 0
    with pytest.raises(ValueError):
        classifier.fit(train.limit(0))


def test_fallback_when_no_review_has_the_topic(spark, nb, train):
    scored = classifier.predict(train, nb).withColumn("query_id", F.lit(1)).withColumn("target_topic", F.lit("compatibility"))
    out = classifier.topic_filter(scored)
    assert out.where("kept").count() == 0 and out.where("fallback_used").count() == 6
    dist = {r["predicted_topic"]: r["n"] for r in classifier.topic_distribution(scored).collect()}
    assert dist["performance"] > 0


def test_unknown_labels_become_other(spark, train):
    model = classifier.fit(train.withColumn("label", F.when(F.col("review_id") == "1", "weird").otherwise(F.col("label"))))
    assert "other" in classifier.fit_summary(model).first()["classes"]


def test_probability_tables(spark):
    rows = [("1", 1, "performance", "negative"), ("2", 5, "performance", "positive"), ("3", 2, "performance", "negative"),
            ("4", 5, "usability", "positive")]
    model = probability.fit(spark.createDataFrame(rows, "review_id string, rating int, topic string, sentiment string"))
    got = {r["topic"]: r for r in probability.insights(model).collect()}
    p = got["performance"]
    assert abs(p["p_positive_given_topic"] - 1 / 3) < 1e-12 and abs(p["p_negative_given_topic"] - 2 / 3) < 1e-12
    assert got["usability"]["p_positive_given_topic"] == 1 and got["usability"]["p_negative_given_topic"] == 0
    assert p["p_high_rating_given_positive"] == 1 and p["p_low_rating_given_negative"] == 1
    assert got["pricing"]["p_positive_given_topic"] == 0.5
    for table, parent in ((probability.sentiment_given_topic(model), "topic"), (probability.rating_given_sentiment(model), "sentiment"),
                          (probability.topic_given_rating(model), "rating_category")):
        assert all(abs(r["s"] - 1) < 1e-9 for r in table.groupBy(parent).agg(F.sum("p").alias("s")).collect())


def test_empty_probability_model_answers_one_half(spark):
    empty = spark.createDataFrame([], "review_id string, rating int, topic string, sentiment string")
    rows = probability.insights(probability.fit(empty)).collect()
    assert len(rows) == 7 and all(v == 0.5 for r in rows for v in list(r)[1:])


def test_symbols_and_fallback_borders(spark):
    df = spark.createDataFrame([(x,) for x in (-0.61, -0.6, -0.2, 0.19, 0.2, 0.6)], "s double")
    assert [r["x"] for r in df.select(sentiment.symbol("s").alias("x")).collect()] == [0, 1, 2, 2, 3, 4]
    df = spark.createDataFrame([(x,) for x in (0.2, -0.2, 0.0)], "s double")
    assert [r["x"] for r in df.select(sentiment.fallback_state("s").alias("x")).collect()] == ["positive", "negative", "neutral"]


def test_transitions(spark):
    df = spark.createDataFrame([(["positive", "negative", "positive", "positive"],), (["neutral"],)], "s array<string>")
    a, b = [r["t"] for r in df.select(sentiment.transitions("s").alias("t")).collect()]
    assert len(a) == 9 and a["pos_to_neg"] == 0.5 and a["pos_to_pos"] == 0.5 and a["neg_to_pos"] == 1
    assert sum(a.values()) == 2 and sum(b.values()) == 0


def test_polarity_rules(spark):
    rows = [("1", ["It is good.", "It is not good.", "Very good!", "Nothing here."])]
    df = spark.createDataFrame(rows, "review_id string, sentences array<string>")
    good, negated, loud, none = sentiment.observations(df).first()["scores"]
    norm = lambda s: s / math.sqrt(s * s + 15)
    assert abs(good - norm(1.9)) < 1e-9 and abs(negated - norm(1.9 * -0.74)) < 1e-9
    assert abs(loud - norm(1.9 + 0.293 + 0.292)) < 1e-9 and none == 0


def observed(spark, n=40, seed=5):
    rng = random.Random(seed)
    rows = [(str(i), [float(rng.randint(-1, 1)) for _ in range(k)], [rng.randint(0, 4) for _ in range(k)])
            for i, k in enumerate(rng.choices(range(1, 9), k=n))]
    return rows, spark.createDataFrame(rows, "review_id string, scores array<double>, symbols array<int>")


def reference_viterbi(symbols, m):
    lg = lambda p: math.log(p) if p > 0 else -math.inf
    score, back = [lg(m.start[j]) + lg(m.emit[j][symbols[0]]) for j in range(3)], []
    for o in symbols[1:]:
        step, row = [], []
        for j in range(3):
            opts = [score[i] + lg(m.trans[i][j]) for i in range(3)]
            i = opts.index(max(opts))
            row.append(i)
            step.append(opts[i] + lg(m.emit[j][o]))
        back.append(row)
        score = step
    path = [score.index(max(score))]
    for row in reversed(back):
        path.append(row[path[-1]])
    return [lex.SENTIMENTS[i] for i in reversed(path)]


def test_viterbi_equals_plain_python(spark):
    rows, df = observed(spark, 120)
    got = {r["review_id"]: r["s"] for r in df.select("review_id", hmm.viterbi("symbols", hmm.START).alias("s")).collect()}
    assert all(got[i] == reference_viterbi(sym, hmm.START) for i, _, sym in rows)


@pytest.mark.parametrize("steps", [hmm.POINTERS, hmm.POINTERS + 1, hmm.POINTERS + 2, 2 * hmm.POINTERS + 1, 100_000])
def test_viterbi_of_long_sequences(spark, steps):
    """Borders of the blocks, ties of the start model, and a review of 100 000 sentences."""
    rng = random.Random(steps)
    symbols = [rng.randint(0, 4) for _ in range(steps)]
    df = spark.createDataFrame([(symbols,), ([],)], "symbols array<int>").repartition(1)
    got = [r["s"] for r in df.select(hmm.viterbi("symbols", hmm.START).alias("s")).collect()]
    assert sorted(got, key=len) == [[], reference_viterbi(symbols, hmm.START)]


def test_short_sequences_use_polarity(spark):
    df = spark.createDataFrame([("1", [0.9], [4])], "review_id string, scores array<double>, symbols array<int>")
    assert hmm.analyze(df, hmm.START).first()["sentiment_states"] == ["positive"]


def test_expected_counts_equal_plain_forward_backward(spark):
    rows, df = observed(spark)
    pi, a, b = (np.array(x) for x in hmm.START[:3])
    start, trans, emit, ll = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5)), 0.0
    for _, _, sym in rows:
        if len(sym) < 2:
            continue
        alpha = [pi * b[:, sym[0]]]
        for o in sym[1:]:
            alpha.append(alpha[-1] @ a * b[:, o])
        beta = [np.ones(3)]
        for o in reversed(sym[1:]):
            beta.insert(0, a @ (b[:, o] * beta[0]))
        total = alpha[-1].sum()
        ll += math.log(total)
        for t, o in enumerate(sym):
            gamma = alpha[t] * beta[t] / total
            emit[:, o] += gamma
            if t == 0:
                start += gamma
            if t + 1 < len(sym):
                trans += alpha[t][:, None] * a * b[:, sym[t + 1]][None, :] * beta[t + 1][None, :] / total
    for parts in (1, 5):
        row = hmm.expected_counts(hmm.eligible(df.repartition(parts)), hmm.START).first()
        assert np.allclose(list(row)[:27], np.concatenate([start, trans.ravel(), emit.ravel()]))
        assert abs(row["k27"] - ll) < 1e-6


def plain_sums(sequences, m):
    """The 29 sums by a scaled forward-backward pass, position by position."""
    pi, a, b = (np.array(x) for x in m[:3])
    out = np.zeros(29)
    for sym in sequences:
        alpha, scale = [], []
        for t, o in enumerate(sym):
            raw = (alpha[-1] @ a if t else pi) * b[:, o]
            scale.append(raw.sum())
            alpha.append(raw / raw.sum())
        beta = np.ones(3)
        for t in range(len(sym) - 1, -1, -1):
            out[12 + sym[t]:27:5] += alpha[t] * beta
            if t == 0:
                out[0:3] += alpha[0] * beta
            else:
                nxt = beta * b[:, sym[t]] / scale[t]
                out[3:12] += (alpha[t - 1][:, None] * a * nxt[None, :]).ravel()
                beta = a @ nxt
        out[27] += np.log(scale).sum()
        out[28] += 1
    return out


def test_long_sequences_are_cut_into_segments(spark, monkeypatch):
    """Segments give the sums of whole sequences, with equal and unequal last segments and weights."""
    rng = random.Random(3)
    n = hmm.SEGMENT
    rows = [[rng.choice([0, 0, 1, 2, 3, 4, 4]) for _ in range(k)] for k in (2, n - 1, n, n + 1, 2 * n, 3 * n + 17, 5)]
    df = spark.createDataFrame([(s, 2) for s in rows], "symbols array<int>, n long").repartition(2)
    got = np.array(list(hmm.expected_counts(df, hmm.START).first()))
    want = 2 * plain_sums(rows, hmm.START)
    assert np.allclose(got, want, rtol=1e-9, atol=1e-9)
    monkeypatch.setattr(hmm, "POSITIONS", 3 * n)  # groups of few segments
    small = sum(f.to_numpy()[0] for f in hmm._expected_counts(*hmm.START[:3])([df.toPandas()]))
    assert np.allclose(small, want, rtol=1e-9, atol=1e-9)


def test_a_million_symbols_in_bounded_memory():
    import tracemalloc

    import pandas as pd

    symbols = np.random.default_rng(1).integers(0, 5, 1_000_000).astype(np.int32)
    batch = pd.DataFrame({"symbols": [symbols], "n": [1]})
    tracemalloc.start()
    sums = next(hmm._expected_counts(*hmm.START[:3])([batch])).to_numpy()[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6
    assert abs(sums[12:27].sum() - 1e6) < 1e-3 and abs(sums[3:12].sum() - (1e6 - 1)) < 1e-3 and abs(sums[:3].sum() - 1) < 1e-9


def test_training_never_loses_likelihood(spark):
    _, df = observed(spark)
    model = hmm.fit(df, max_iter=8)
    assert all(y >= x - 1e-9 for x, y in zip(model.history, model.history[1:]))
    assert all(abs(sum(r) - 1) < 1e-9 for r in [model.start, *model.trans, *model.emit])
    mean = [sum(k * p for k, p in enumerate(r)) for r in model.emit]
    assert mean[0] >= mean[2] >= mean[1]
    assert hmm.fit(df.where(F.size("symbols") < 2)) is None


def test_stored_models_round_trip(spark, nb, folder):
    models.save_classifier(nb, f"{folder}/nb", models.metadata_row(spark, "Naive Bayes", "test", 6, {"alpha": 1.0}, {}))
    back = models.load_classifier(spark, f"{folder}/nb")
    rows = spark.createDataFrame([("x", "My sync hangs for hours")], "review_id string, text string")
    a, b = classifier.predict(rows, nb).first(), classifier.predict(rows, back).first()
    assert a["predicted_topic"] == b["predicted_topic"] and abs(a["confidence"] - b["confidence"]) < 1e-6
    assert models.load_metadata(spark, f"{folder}/nb").first()["corpus_size"] == 6
    models.save_hmm(spark, hmm.START, f"{folder}/hmm")
    loaded = models.load_hmm(spark, f"{folder}/hmm")
    assert np.allclose(loaded.trans, hmm.START.trans) and np.allclose(loaded.emit, hmm.START.emit)
    assert models.load_metadata(spark, f"{folder}/hmm").count() == 0


def test_wrong_or_missing_model(spark, folder):
    with pytest.raises(RuntimeError):
        models.save_classifier(None, folder)
    with pytest.raises(FileNotFoundError):
        models.load_hmm(spark, f"{folder}/none")
    spark.range(3).write.parquet(f"{folder}/odd/parameters")
    with pytest.raises(TypeError):
        models.load_hmm(spark, f"{folder}/odd")


def test_stage_runs_once_and_repeats_after_a_crash(spark, folder):
    out = f"{folder}/stage"
    spark.range(2).write.parquet(out)
    assert not stage.run_stage(spark, out, lambda: spark.range(5), sinks.write_parquet)
    half = f"{folder}/half"
    spark._jvm.java.io.File(half).mkdirs()
    assert stage.run_stage(spark, half, lambda: spark.range(5), sinks.write_parquet)
    assert spark.read.parquet(half).count() == 5


def test_bucketed_corpus_needs_no_shuffle(spark, folder, train):
    sinks.write_bucketed(train, "bucketed_reviews", f"{folder}/bucketed", 4)
    table = spark.table("bucketed_reviews")
    model = tfidf.fit(table)
    plan = tfidf.transform(table, model)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    assert tfidf.transform(table, model).count() == tfidf.transform(train, model).count()
    spark.sql("DROP TABLE bucketed_reviews")


def test_whole_analysis(spark):
    rows = [("1", "Sync hangs whenever the phone wakes", 1, "performance"), ("2", "Guests grasp the clean menus at once", 5, "usability"),
            ("3", "The renewal fee doubled overnight", 2, "pricing"), ("4", "Screens load late since spring", 1, "performance")]
    reviews = spark.createDataFrame(rows, "review_id string, text string, rating int, label string")
    index = tfidf.fit(reviews)
    kit = analyze.Models(index, tfidf.transform(reviews, index), classifier.fit(reviews),
                         probability.fit(reviews.withColumnRenamed("label", "topic")), None)
    queries = spark.createDataFrame([(1, "sync hangs", "performance"), (2, "", None)], "query_id int, query string, topic_filter string")
    out = analyze.analyze(queries, reviews, kit, top_k=10, min_confidence=0.2)
    assert out.candidates.where("query_id = 1").count() > 0 and out.candidates.where("query_id = 2").count() == 0
    assert out.sequences.count() == out.analysed.count()
    texts = {r["query_id"]: r["summary"] for r in out.summary.collect()}
    assert texts[1].startswith("Analyzed 1 reviews for topic 'performance'.") and texts[2] == analyze.NO_MATCH
    assert out.expansion.where("query_id = 2").first()["expanded_terms"] == []


def test_summary_text(spark):
    row = spark.range(1).select(analyze.summary_text(F.lit(2), F.lit("performance"), F.lit(0.25), F.lit(0.75), F.lit(3.0), F.lit(0.0)).alias("s")).first()
    assert row["s"] == ("Analyzed 2 reviews for topic 'performance'. P(positive|topic)=0.25, P(negative|topic)=0.75. "
                        "Average rating is 3.00/5. Average sentiment-sequence length is 0.0 sentences.")


def test_prepare_runs_each_stage_once(spark, folder):
    rows = [(f"Great software number {i}. Works well and is fast and slow.", i % 5 + 1, "Good", "P1") for i in range(30)]
    spark.createDataFrame(rows, "text string, rating int, title string, parent_asin string").coalesce(1).write.json(f"{folder}/raw")
    first = prepare.prepare(spark, f"{folder}/raw", f"{folder}/out")
    again = prepare.prepare(spark, f"{folder}/raw", f"{folder}/out")
    assert all(first.values()) and not any(again.values())
    main = spark.read.parquet(f"{folder}/out/main.parquet")
    assert main.count() == 30 and main.where(F.col("sentence_count") == 2).count() == 30
    ids = sorted(r["review_id"] for r in main.collect())
    assert ids[0] == "R000000" and ids[-1] == "R000029"
    report = {r["name"]: r for r in prepare.validate(spark, f"{folder}/out", min_corpus=10).collect()}
    assert report["corpus_size"]["passed"] and not report["curated_size"]["passed"] and report["sample_balance"]["is_warning"]


def test_folds_by_subtraction_equal_models_fitted_anew(spark):
    r = random.Random(5)
    rows = [(k, r.choice(["pricing", "support", "usability"]), r.choice(["positive", "negative", "neutral"]), r.randrange(1, 6), k % 4) for k in range(200)]
    rows.append((200, "features", "positive", 5, 1))  # a topic that only fold 1 has
    reviews = spark.createDataFrame(rows, "review_id int, topic string, sentiment string, rating int, k int")
    found = {x["fold"]: x for x in probability.cross_validated(probability.fold_counts(reviews, F.col("k"))).collect()}
    for fold in range(4):
        anew = probability.log_likelihood(probability.fit(reviews.where(F.col("k") != fold)), reviews.where(F.col("k") == fold)).first()
        assert found[fold]["log_likelihood"] == pytest.approx(anew["log_likelihood"]) and found[fold]["n_rows"] == anew["n_rows"]
        assert found[fold]["n_impossible"] == anew["n_impossible"] == (fold == 1)

def test_training_reads_symbols_in_many_tasks(spark, monkeypatch):
    """Few bytes of symbols are dealt over the cores, not read by one task in every pass."""
    rows = [(f"R{i}", [(i // 5 ** j) % 5 for j in range(6)]) for i in range(2000)]
    seen = []
    plain = hmm.expected_counts
    monkeypatch.setattr(hmm, "expected_counts", lambda observed, model: (seen.append(observed.rdd.getNumPartitions()), plain(observed, model))[1])
    hmm.fit(spark.createDataFrame(rows, "review_id string, symbols array<int>").coalesce(1), max_iter=1)
    assert seen == [spark.sparkContext.defaultParallelism]


def test_long_sequences_advance_together(monkeypatch):
    """Segments of many sequences share the steps: their number is that of a segment, not of all long sequences."""
    import pandas as pd

    calls, plain = [], hmm._segment_sums
    monkeypatch.setattr(hmm, "_segment_sums", lambda *args: (calls.append(len(args[2])), plain(*args))[1])
    rng = np.random.default_rng(2)
    rows = [rng.integers(0, 5, k).astype(np.int32) for k in (1500, 2, 2048, 1100, 4000, 30) * 3]
    got = next(hmm._expected_counts(*hmm.START[:3])([pd.DataFrame({"symbols": rows, "n": [3] * len(rows)})])).to_numpy()[0]
    assert len(calls) == 1 and np.allclose(got, 3 * plain_sums(rows, hmm.START), rtol=1e-9, atol=1e-9)


def test_packed_sequences_give_the_sums_of_plain_ones(spark, monkeypatch):
    """A pass over stored groups steps over blocks of symbols, each kind of block once; borders of blocks, segments and groups, weights."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    rows = [rng.integers(0, 5, k).astype(np.int32) for k in (2, 7, 8, 9, 16, 127, 128, 129, 700, 3, 8, 8)]
    batch = pa.record_batch([pa.array([r.tolist() for r in rows], pa.list_(pa.int32())), pa.array([3] * len(rows))], ["symbols", "n"])
    want = 3 * plain_sums(rows, hmm.START)
    df = spark.createDataFrame([(r.tolist(), 3) for r in rows], "symbols array<int>, n long").repartition(2)
    assert np.allclose(list(hmm.expected_counts(hmm.packed(df), hmm.START).first()), want, rtol=1e-9, atol=1e-9)
    for size, groups in ((1 << 20, 1), (130, 5)):
        monkeypatch.setattr(hmm, "GROUP", size)
        stored = list(hmm._pack([batch.slice(0, 5), batch.slice(5)]))
        got = next(hmm._packed_counts(*hmm.START[:3])(stored)).to_pandas().to_numpy()[0]
        assert len(stored) == groups and np.allclose(got, want, rtol=1e-9, atol=1e-9)
    same = hmm._packed(np.zeros(8 * 1000, np.int32), np.full(500, 16))
    assert len(same[0]) == 2 and len(same[1]) == 1000


def test_training_stores_packed_sequences(spark, monkeypatch):
    """What a pass reads is a row a group, not an array a sequence."""
    rows = [(f"R{i}", [(i // 5 ** j) % 5 for j in range(6)]) for i in range(2000)]
    seen, plain = [], hmm.expected_counts
    monkeypatch.setattr(hmm, "expected_counts", lambda observed, model: (seen.append(observed.count()), plain(observed, model))[1])
    hmm.fit(spark.createDataFrame(rows, "review_id string, symbols array<int>"), max_iter=1)
    assert seen == [spark.sparkContext.defaultParallelism]


def test_sentence_sums_equal_those_of_the_join(spark, monkeypatch):
    """Words are valued in Arrow batches without a row a word; null, empty and repeated rows, odd characters, many polarity rows a word."""
    rng = random.Random(6)
    bits = ["good", "Bad", "not", "never", "very", "slightly", "don't", "'", "!", "!!", "ΣΑΣ", "x\u0301good", "awful!", "isn't", "good,bad", "the"]
    sentence = lambda: None if rng.random() < 0.05 else " ".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
    rows = [(rng.choice([None, *map(str, range(150))]), None if rng.random() < 0.05 else [sentence() for _ in range(rng.randint(0, 5))]) for _ in range(200)]
    df = spark.createDataFrame(rows, "review_id string, sentences array<string>").repartition(3)
    words = spark.createDataFrame([("good", 1.9), ("bad", -2.5), ("good", 0.5), (None, 1.0), ("awful", None), ("don't", -0.3), ("σας", 1.0)], "word string, valence double")
    arrays = lambda: sorted((str(r[0]), [round(x, 9) for x in r[1]], r[2]) for r in sentiment.observations(df, words).collect())
    each = lambda: sorted((str(r[0]), r[1], round(r[2], 9)) for r in sentiment.sentence_polarity(df, words).collect())
    plan = sentiment.observations(df, words)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "regexp_extract_all" not in plan and "Join" not in plan
    monkeypatch.setattr(sentiment.counting, "SLICE", 16)
    got = arrays(), each()
    monkeypatch.setattr(sentiment, "BROADCAST_ROWS", 2)  # too many words for a task: joined
    assert got == (arrays(), each()) and len(got[0]) > 50 and any(x for _, xs, _ in got[0] for x in xs)


def test_only_candidates_are_split_and_stored_once(spark, monkeypatch):
    """A computed ``sentences`` column is worked out for the reviews that a query found, and two queries share a review's text."""
    rows = [(str(i), f"Sync hangs for the {i} time. It is bad." if i < 3 else f"Menus {i} are clean.", 1 + i % 5, "performance" if i < 3 else "usability") for i in range(20)]
    reviews = spark.createDataFrame(rows, "review_id string, text string, rating int, label string")
    index = tfidf.fit(reviews)
    kit = analyze.Models(index, tfidf.transform(reviews, index), classifier.fit(reviews), None, None)
    queries = spark.createDataFrame([(1, "sync hangs"), (2, "hangs time")], "query_id int, query string")
    stored, plain = {}, analyze.materialize
    monkeypatch.setattr(analyze, "materialize", lambda df, name: (stored.setdefault(name, df), plain(df, name))[1])
    lazy = spark.createDataFrame(rows, "review_id string, text string, rating int, label string").withColumn("sentences", tx.sentences("text"))
    out = analyze.analyze(queries, lazy, kit, top_k=10)
    assert stored["candidates"].count() == 3 and out.candidates.count() == 6 and out.sequences.count() == out.analysed.count()
    assert {tuple(r["sentences"]) for r in out.sequences.where("review_id = '0'").collect()} == {("Sync hangs for the 0 time.", "It is bad.")}
    plan = stored["candidates"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("split(") < plan.index("LeftSemi")  # the join lies below


def test_training_counts_the_index_in_batches(spark, folder, monkeypatch):
    rows = [(f"R{i}", "Sync hangs. It is bad." if i % 2 else "Menus are clean. They are good.", 3, "performance" if i % 2 else "usability") for i in range(8)]
    corpus = spark.createDataFrame(rows, "review_id string, text string, rating int, topic_label string").withColumn("sentences", tx.sentences("text"))
    seen, plain = [], tfidf.transform
    monkeypatch.setattr(tfidf, "transform", lambda *a, **b: (seen.append(b.get("packed")), plain(*a, **b))[1])
    from voxtable.plans import train

    assert train.train_all(spark, corpus, corpus, folder, hmm_iterations=2).count() == 4
    assert seen and all(seen) and models.load_postings(spark, f"{folder}/tfidf").count() == plain(corpus, models.load_tfidf(spark, f"{folder}/tfidf")).count()


def test_labels_are_worked_out_once_for_a_fit(spark, monkeypatch):
    from voxtable.operators import counting

    docs = spark.createDataFrame([("a", "app crashes slow"), ("b", "easy interface simple")], "review_id string, text string")
    labeled = docs.withColumn("label", F.when(F.contains("text", F.lit("slow")), "performance").otherwise("usability"))
    plans, plain = [], counting.word_totals
    monkeypatch.setattr(counting, "word_totals", lambda df, *a: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), plain(df, *a))[1])
    model = classifier.fit(labeled)
    assert len(plans) == 1 and "CASE WHEN" not in plans[0] and model.tfidf.n_docs == 2
