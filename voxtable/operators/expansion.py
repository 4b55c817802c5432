"""Query words, synonym beam expansion and term filtering for whole tables of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxtable.functions import lexicons as lex, text as tx
from voxtable.operators.rows import exploded
from voxtable.sources.scratch import literal_table


def looks_like_question(query) -> Column:
    """First word is a question word, or a question mark, or a long query with a marker word."""
    q = F.col(query) if isinstance(query, str) else query

    def rule(ws: Column) -> Column:
        opens = F.coalesce(F.get(ws, F.lit(0)).isin(lex.QUESTION_WORDS), F.lit(False))
        marked = (F.size(ws) > 4) & F.arrays_overlap(ws, tx.string_array(lex.SENTENCE_MARKERS))
        return opens | F.contains(q, F.lit("?")) | marked

    return tx.let(tx.whitespace_words(F.lower(q)), rule)


def query_keywords(queries: DataFrame, extracted: DataFrame | None = None) -> DataFrame:
    """(query_id, original_query, extracted_keywords, was_preprocessed).

    ``extracted`` (query_id, keywords) replaces the words of question-like queries where it
    has any; everything else passes through lowercased, punctuation kept.
    """
    base = queries.select("query_id", F.col("query").alias("original_query"),
                          tx.whitespace_words(F.lower("query")).alias("words"))
    if extracted is None:
        return base.select("query_id", "original_query", F.col("words").alias("extracted_keywords"),
                           F.lit(False).alias("was_preprocessed"))
    joined = base.join(extracted, "query_id", "left")
    use = looks_like_question("original_query") & (F.coalesce(F.size("keywords"), F.lit(0)) > 0)
    return joined.select(
        "query_id", "original_query",
        F.when(use, F.transform("keywords", F.lower)).otherwise(F.col("words")).alias("extracted_keywords"),
        use.alias("was_preprocessed"))


def default_synonyms(spark) -> DataFrame:
    """Every word of a group is a synonym of the others, in list order."""
    rows = []
    for head, rest in lex.SYNONYM_GROUPS.items():
        group = [head, *rest]
        for w in group:
            rows += [(w, s, i) for i, s in enumerate((x for x in group if x != w), 1)]
    return literal_table(spark, {c: [r[i] for r in rows] for i, c in enumerate(["word", "syn", "rank"])})


def usable_synonyms(synonyms: DataFrame, most: int = 5) -> DataFrame:
    """Lowercased synonyms other than the word itself and without underscores, the best
    ``most`` per word by rank, then alphabetically."""
    from pyspark.sql import Window as W

    usable = synonyms.select(F.lower("word").alias("word"), F.lower("syn").alias("syn"), "rank").where(
        (F.col("syn") != F.col("word")) & ~F.contains("syn", F.lit("_")))
    single = usable.groupBy("word", "syn").agg(F.min("rank").alias("rank"))
    w = W.partitionBy("word").orderBy("rank", "syn")
    return single.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def expansion_score(original: Column, expanded: Column) -> Column:
    """0.4 per new word + 0.5 x retained share + 0.1, on word sets."""
    o, e = F.array_distinct(original), F.array_distinct(expanded)
    new = F.size(F.array_except(e, o)) * 0.4
    retained = F.size(F.array_intersect(o, e)) / F.greatest(F.size(o), F.lit(1)) * 0.5
    return new + retained + 0.1


_STEP = "struct<score:double,parent:int,pos:int,syn_rank:int,words:array<string>,path:array<string>>"


def _beam_round(state: DataFrame, synonyms: DataFrame, width: int) -> DataFrame:
    """Replace one word by a synonym in every way and keep the best ``width`` per query.

    A query is one row before and after. Its candidates are bounded by its own length, so
    gathering them per query cannot grow with the number of queries.
    """
    members = state.select("query_id", "query", "words", "paths", F.posexplode_outer("beam").alias("parent", "m"))
    spots = members.select("query_id", "query", "words", "paths", "parent", "m",
                           F.posexplode_outer("m.words").alias("pos", "word"))
    cands = spots.join(synonyms.select("word", "syn", F.col("rank").alias("syn_rank")), "word", "left")
    new_words = F.transform("m.words", lambda w, i: F.when(i == F.col("pos"), F.col("syn")).otherwise(w))
    staged = cands.withColumn("new_words", F.when(F.col("syn").isNotNull(), new_words))
    cand = F.when(F.col("syn").isNotNull(), F.struct(
        (-expansion_score(F.col("words"), F.col("new_words"))).alias("score"), "parent", "pos",
        F.col("syn_rank").cast("int").alias("syn_rank"), F.col("new_words").alias("words"),
        F.concat(F.col("m.path"), F.array(F.array_join("new_words", " "))).alias("path")))
    best = staged.groupBy("query_id").agg(
        F.any_value("query").alias("query"), F.any_value("words").alias("words"), F.any_value("paths").alias("paths"),
        F.slice(F.array_sort(F.collect_list(cand)), 1, width).alias("kept"))
    beam = F.transform("kept", lambda c: F.struct(c["words"].alias("words"), (-c["score"]).alias("score"), c["path"].alias("path")))
    staged = best.withColumn("beam", beam)
    step = F.transform("beam", lambda c: F.struct(c["path"].alias("path"), c["score"].alias("score")))
    return staged.select("query_id", "query", "words", "beam", F.concat("paths", step).alias("paths"))


def expand(queries: DataFrame, synonyms: DataFrame | None = None, beam_width: int = 3, max_depth: int = 2,
           max_paths: int = 10) -> DataFrame:
    """(query_id, original_query, expanded_terms, beam_paths).

    Terms are the query words followed by the new words of the last beam in alphabetical
    order. When no word has a synonym the beam empties and the query words remain.
    """
    synonyms = usable_synonyms(default_synonyms(queries.sparkSession) if synonyms is None else synonyms)
    lowered = F.lower("query")
    no_paths = F.array().cast("array<struct<path:array<string>,score:double>>")
    words = tx.whitespace_words(lowered)
    start = queries.select("query_id", "query", words.alias("words"))
    seed = F.struct(F.col("words"), F.lit(1.0).alias("score"), F.array(lowered).alias("path"))
    state = start.select("query_id", "query", "words", F.array(seed).alias("beam"), no_paths.alias("paths"))
    for _ in range(max_depth):
        state = _beam_round(state, synonyms, beam_width)
    own = F.array_distinct("words")
    found = F.flatten(F.transform("beam", lambda c: c["words"]))
    extra = F.array_sort(F.array_except(found, F.col("words")))
    return state.select("query_id", F.col("query").alias("original_query"), F.concat(own, extra).alias("expanded_terms"),
                        F.slice("paths", 1, max_paths).alias("beam_paths"))


def filter_terms(expanded: DataFrame, cache: DataFrame, undecided: str = "drop", terms: str = "expanded_terms") -> DataFrame:
    """Adds filtered_terms: query words stay, cached terms follow their verdict, the rest are
    dropped (or kept with ``undecided='keep'``). Order is preserved."""
    verdict = _with_verdicts(expanded, cache, terms)
    keep = F.coalesce(F.when(F.col("is_query_word"), True), F.col("is_relevant"), F.lit(undecided == "keep"))
    kept = verdict.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.when(keep & F.col("term").isNotNull(), F.struct("pos", "term")))).alias("k"))
    return kept.select("query_id", F.transform("k", lambda x: x["term"]).alias("filtered_terms"))


def _with_verdicts(expanded: DataFrame, cache: DataFrame, terms: str) -> DataFrame:
    words = tx.whitespace_words(F.lower("original_query"))
    rows = expanded.select("query_id", words.alias("query_words"), F.posexplode_outer(terms).alias("pos", "raw"))
    flat = rows.select("query_id", "pos", F.lower("raw").alias("term"),
                       F.array_contains("query_words", F.lower("raw")).alias("is_query_word"))
    return flat.join(cache.select("term", "is_relevant"), "term", "left")


def undecided_terms(expanded: DataFrame, cache: DataFrame, terms: str = "expanded_terms") -> DataFrame:
    """Work list: distinct terms that are neither query words nor in the cache."""
    words = tx.whitespace_words(F.lower("original_query"))
    rows = exploded(expanded, ["query_id", words.alias("query_words")], terms, "raw")
    open_terms = rows.where(~F.array_contains("query_words", F.lower("raw"))).select("query_id", F.lower("raw").alias("term"))
    return open_terms.join(cache, "term", "left_anti").distinct()


def removed_terms(expanded: DataFrame, filtered: DataFrame) -> DataFrame:
    both = expanded.join(filtered, "query_id")
    return both.select("query_id", F.array_sort(F.array_except("expanded_terms", "filtered_terms")).alias("removed_terms"))


def extended_cache(cache: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Old and new verdicts together; the new one wins."""
    both = cache.select("term", "is_relevant", F.lit(0).alias("v")).unionByName(
        verdicts.select("term", "is_relevant", F.lit(1).alias("v")))
    return both.groupBy("term").agg(F.max_by("is_relevant", "v").alias("is_relevant"))
