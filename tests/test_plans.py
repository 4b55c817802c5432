"""Physical plans: pushdown, shuffles, top-k, broadcast sides."""

import pytest

from voxtable.operators import classifier, cleaning, labeling, sampling, tfidf
from voxtable.plans.catalogue import QUERIES
from voxtable.plans.catalogue.base import CORPUS_LEXICON, Tables

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return plan(df).count("Exchange hashpartitioning") - plan(df).count("REPARTITION_BY_NUM")


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, SF)


@pytest.fixture(scope="module")
def index(tables):
    return tfidf.fit(tables.reviews)


@pytest.fixture(scope="module")
def nb(tables):
    return classifier.fit(tables.labeled.select("review_id", "text", "topic_label"), label="topic_label")


def test_language_filter_and_columns_reach_the_scan(spark, tables):
    text = plan(QUERIES["p15_language"](spark, SF))
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in text and "Exchange" not in text
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in text
    text = plan(QUERIES["p14_prefilter"](spark, SF))
    assert "EqualTo(lang,en)" in text.split("PushedFilters")[1].split("]")[0]
    assert text.index("REPARTITION_BY_NUM") < text.index("EqualTo(lang,en)")  # rows are filtered before they are spread


def test_a_page_sorts_its_own_rows_alone(spark):
    text = plan(QUERIES["w08_page"](spark, SF))
    assert "Filter (" in text
    assert "rangepartitioning" not in text


def test_labelling_needs_no_shuffle(tables):
    assert shuffles(labeling.auto_label(tables.reviews, CORPUS_LEXICON)) == 0


def test_top_k_cuts_before_the_shuffle(tables, index):
    text = plan(tfidf.retrieve(tfidf.transform(tables.reviews, index), tables.query_terms, index, 10))
    assert "WindowGroupLimit" in text


def test_samples_cut_before_the_shuffle(tables):
    assert "WindowGroupLimit" in plan(sampling.rating_sample(tables.reviews))


def test_vectors_shuffle_once_and_join_by_broadcast(tables, index):
    df = tfidf.transform(tables.reviews, index)
    assert shuffles(df) == 1 and "BroadcastHashJoin" in plan(df) and "SortMergeJoin" not in plan(df)


def test_prediction_shuffles_one_narrow_row_per_review(tables, nb):
    df = classifier.predict(tables.reviews, nb)
    text = plan(df)
    assert shuffles(df) == 1 and "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert "partial_sum" in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_single_query_uses_a_distributed_top_k(tables, index):
    text = plan(tfidf.retrieve_one(tables.reviews, ["thon"], index, 10))
    assert "TakeOrderedAndProject" in text and "SortMergeJoin" not in text


def test_copies_are_combined_before_the_shuffle(tables):
    text = plan(cleaning.copied_texts(tables.reviews))
    assert "partial_min" in text and "Window" not in text
    text = plan(cleaning.keep_first_copy(tables.reviews))  # texts are neither aggregated nor sorted
    assert "Aggregate" not in text and "Window" not in text
