"""Retrieval from impact-ordered blocks of postings, with blocks left unread that cannot change the first k.

A term's postings are cut by weight into LEVELS levels, a level into parts of about BLOCK reviews, so a term that is in a
third of all reviews is many rows. A level's greatest weight times the query's weight is its impact.

A query with few postings is scored from all its blocks. Where the others have very many in all, one pass over the reviews'
vectors scores them all (``scanned``). Else the first k of them are found in three steps. The levels of most
impact give reviews that are scored from their own vectors, and so a bound: the k-th best of these scores. Each term gets a cap, the largest common tau with which all caps together stay under the bound; a review
that occurs only in levels under their term's cap cannot reach it, so these are not read. Of the reviews in
the others, those whose partial score and the caps of the terms not seen reach the bound are scored too. What is shuffled by (query, review) is the postings of the levels read, not all.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from voxtable.operators import tfidf
from voxtable.operators.rows import exploded, unpacked
from voxtable.sources.scratch import BROADCAST_ROWS, materialize, small

#: Levels halve the weight every two, so their number times the vocabulary bounds the table of levels.
LEVELS = 20
BLOCK = 512
#: A query of no more than that many times k postings is scored from all of them.
DENSE = 100
#: First levels are read until they hold that many times k postings.
HEAD = 4
#: Where more than that share of a query's postings would be read, all are: their sums are the scores.
MOST = 0.5
#: Scores are ordered to nine decimals; a review has to miss the bound by more.
SLACK = 2e-9
#: Match counts keep a bit a term and query in each task, up to that many, and take unions of that many bytes at a time.
MOST_BITS = 1 << 28
UNION_BYTES = 1 << 23
#: Queries with more postings than that in all are scored review by review, in tasks that hold up to that many query weights
#: and best scores; that many cells of a few reviews' vectors at a time.
SCAN = 2_000_000
MOST_CELLS = 1 << 24
SLICE = 1 << 20


class BlockIndex(NamedTuple):
    vectors: DataFrame  # review_id, entries ARRAY<STRUCT<term, weight>>
    blocks: DataFrame   # term, level, part, n, entries ARRAY<STRUCT<review_id, weight>>
    levels: DataFrame   # term, level, parts, n, top
    n_levels: int


class Retrieved(NamedTuple):
    ranked: DataFrame  # query_id, review_id, score, rank
    report: DataFrame  # query_id, n_postings (of its terms), n_read, n_scored (reviews)


def vectors(docs: DataFrame, model: tfidf.TfidfModel) -> DataFrame:
    """One row a review: its unit vector as an array."""
    own = tfidf.weight_lists(docs, model, "review_id")
    entries = F.transform(F.flatten("lists"), lambda t: F.struct(t["term"].alias("term"), (t["w"] / F.col("norm")).alias("weight")))
    return own.select("review_id", entries.alias("entries"))


def build(rows: DataFrame, block: int = BLOCK) -> BlockIndex:
    """Levels and blocks of review vectors; each posting is shuffled once, by term, level and part."""
    rows = materialize(rows, "vectors")
    level = F.least(F.lit(LEVELS - 1), F.greatest(F.lit(0), F.floor(-2 * F.log2("weight")))).cast("int")
    postings = unpacked(rows, ["review_id"], "entries", "term").withColumn("level", level)
    levels = postings.groupBy("term", "level").agg(F.count("*").alias("n"), F.max("weight").alias("top"))
    levels = materialize(levels.withColumn("parts", F.ceil(F.col("n") / block).cast("int")), "levels")
    n_levels = levels.count()
    sized = postings.join(small(levels.select("term", "level", "parts"), n_levels), ["term", "level"])
    part = F.pmod(F.xxhash64("review_id"), F.col("parts")).cast("int")
    blocks = sized.groupBy("term", "level", part.alias("part")).agg(F.count("*").alias("n"), F.collect_list(F.struct("review_id", "weight")).alias("entries"))
    return BlockIndex(rows, materialize(blocks.sortWithinPartitions("term", "level"), "blocks"), levels, n_levels)


def _read(index: BlockIndex, wanted: DataFrame, n_wanted: int) -> DataFrame:
    """(query_id, review_id, gain, cap) of the postings in the wanted levels, parts below ``upto``."""
    met = index.blocks.join(small(wanted, n_wanted), ["term", "level"]).where(F.col("part") < F.col("upto"))
    flat = unpacked(met, ["query_id", "query_weight", "cap"], "entries", "review_id")
    return flat.select("query_id", "review_id", (F.col("weight") * F.col("query_weight")).alias("gain"), "cap")


def _exact(index: BlockIndex, pairs: DataFrame, n_pairs: int, weights: DataFrame, n_weights: int) -> DataFrame:
    """(query_id, review_id, score) of some pairs, from the reviews' own vectors."""
    own = index.vectors.join(small(pairs, n_pairs), "review_id")
    terms = unpacked(own, ["query_id", "review_id"], "entries", "term").join(small(weights, n_weights), ["query_id", "term"])
    return terms.groupBy("query_id", "review_id").agg(F.sum(F.col("weight") * F.col("query_weight")).alias("score"))


def _pruned(index: BlockIndex, groups: DataFrame, weights: DataFrame, n_weights: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Scores of all reviews that can be among the first k, and the levels read, for queries with many postings."""
    of_query, n_groups = W.partitionBy("query_id"), n_weights * LEVELS

    # a bound: the k-th best score of the reviews with the highest impacts
    before = F.sum("n").over(of_query.orderBy(F.desc("impact"), "term", "level")) - F.col("n")
    head = groups.withColumn("before", before).where(F.col("before") < HEAD * k)
    head = head.withColumn("upto", F.least("parts", F.ceil((HEAD * k - F.col("before")) / F.col("n") * F.col("parts")).cast("int")))
    first = materialize(_read(index, head.withColumn("cap", F.lit(0.0)), n_groups).select("query_id", "review_id").distinct(), "first-pairs")
    known = materialize(_exact(index, first, first.count(), weights, n_weights), "first-scores")
    nth = known.withColumn("place", F.row_number().over(of_query.orderBy(F.desc("score")))).where(F.col("place") == k)
    bounds = nth.select("query_id", (F.col("score") - SLACK).alias("bound"))

    # tau: the caps min(tau, most) of all terms add up to the bound; levels with more impact than that are read
    mosts = groups.select("query_id", "term", "most").distinct().groupBy("query_id").agg(F.sort_array(F.collect_list("most")).alias("mosts"))
    fold = F.aggregate("mosts", F.struct(F.col("bound").alias("left"), F.size("mosts").alias("terms")),
                       lambda acc, m: F.when(m * acc["terms"] <= acc["left"], F.struct((acc["left"] - m).alias("left"), (acc["terms"] - 1).alias("terms"))).otherwise(acc),
                       lambda acc: acc["left"] / F.greatest(acc["terms"], F.lit(1)))
    cuts = mosts.join(bounds, "query_id", "left").withColumn("tau", F.greatest(F.lit(0.0), F.coalesce(fold, F.lit(0.0))))
    cuts = cuts.select("query_id", "bound", "tau", F.aggregate("mosts", F.lit(0.0), lambda s, m: s + F.least(m, F.col("tau"))).alias("caps"))
    cuts = small(materialize(cuts, "cuts"), n_weights)  # a row a query
    read = groups.join(cuts.select("query_id", "tau"), "query_id").where(F.col("impact") > F.col("tau"))
    read = read.withColumns({"upto": F.col("parts"), "cap": F.least("most", "tau")})
    read = materialize(read.withColumn("n_read", F.sum("n").over(of_query)).select(*groups.columns, "upto", "cap", "n_read"), "levels-read")
    wide = F.col("n_read") > MOST * F.col("n_all")
    broad = groups.join(read.where(wide).select("query_id").distinct(), "query_id", "left_semi").withColumns({"upto": F.col("parts"), "cap": F.lit(0.0)})
    whole = _read(index, broad, n_groups).groupBy("query_id", "review_id").agg(F.sum("gain").alias("score"))
    known = known.join(broad.select("query_id").distinct(), "query_id", "left_anti")
    read = read.where(~wide)

    seen = _read(index, read, n_groups).groupBy("query_id", "review_id").agg(F.sum("gain").alias("gain"), F.sum("cap").alias("seen"))
    reach = F.col("gain") + F.col("caps") - F.col("seen") >= F.coalesce("bound", F.lit(float("-inf")))
    more = seen.join(cuts, "query_id").where(reach).select("query_id", "review_id").join(known, ["query_id", "review_id"], "left_anti")
    more = materialize(more, "survivors")
    scored = known.unionByName(_exact(index, more, more.count(), weights, n_weights)).unionByName(whole)
    return scored, read.select("query_id", "n").unionByName(broad.select("query_id", "n"))


class _Asked(NamedTuple):
    numbers: dict       # query_id -> its column of the matrix
    places: dict        # term -> its row
    matrix: np.ndarray  # query weights


def _asked(weights: DataFrame, k: int) -> _Asked | None:
    """The weights of all queries as a matrix; None if it does not fit in a task. ``weights`` is stored."""
    n_weights, n_queries, n_terms = weights.count(), weights.select("query_id").distinct().count(), weights.select("term").distinct().count()
    if n_weights > BROADCAST_ROWS or max(n_terms, k) * n_queries > MOST_CELLS:
        return None
    asked = weights.select("query_id", "term", "query_weight").collect()
    numbers = {q: i for i, q in enumerate({r["query_id"]: None for r in asked})}
    places = {t: i for i, t in enumerate({r["term"]: None for r in asked})}
    matrix = np.zeros((len(places), len(numbers)))
    for r in asked:
        matrix[places[r["term"]], numbers[r["query_id"]]] += r["query_weight"]
    return _Asked(numbers, places, matrix)


def scanned(rows: DataFrame, weights: DataFrame, k: int) -> DataFrame | None:
    """(query_id, review_id, score) with the first k reviews of each query and few others, from vectors (review_id, entries).

    All queries' scores of some reviews are a product of matrices. A task hands on what reaches its own k-th best score so far,
    so pairs of query and review are never rows. ``weights`` is stored; None if the queries do not fit in a task.
    """
    asked = _asked(weights, k)
    return asked and _scored(rows.select("review_id", F.col("entries.term").alias("terms"), F.col("entries.weight").alias("weights")), weights, asked, k)


def _scored(parts: DataFrame, weights: DataFrame, asked: _Asked, k: int) -> DataFrame:
    """``scanned`` of (review_id, terms, weights); the terms are strings or their places in the matrix."""
    kind = lambda df, name: df.schema[name].dataType.simpleString()
    found = parts.mapInArrow(_best_scores(list(asked.places), asked.matrix, k), f"number int, review_id {kind(parts, 'review_id')}, score double")
    named = weights.sparkSession.createDataFrame([(q, i) for q, i in asked.numbers.items()], f"query_id {kind(weights, 'query_id')}, number int")
    return found.join(small(named, len(asked.numbers)), "number").select("query_id", "review_id", "score")


def _best_scores(terms: list[str], matrix: np.ndarray, k: int):
    """Arrow batches of (review_id, terms, weights) to (number, review_id, score) of all reviews that can be among a query's first k."""
    def found(batches):
        known, n_terms = pa.array(terms, pa.string()), len(terms)
        step, best = max(1, SLICE // max(n_terms, 1)), np.zeros((matrix.shape[1], 0))
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            flat = lists.flatten()
            place = flat if pa.types.is_integer(flat.type) else pc.index_in(flat.cast(pa.string()), value_set=known)
            place = pc.fill_null(place, -1).to_numpy()
            review = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            weight = batch.column(2).flatten().to_numpy(zero_copy_only=False)[place >= 0]
            review, place = review[place >= 0], place[place >= 0]
            for low in range(0, len(ids), step):
                n = min(step, len(ids) - low)
                a, b = np.searchsorted(review, [low, low + n])
                cells = np.bincount((review[a:b] - low) * n_terms + place[a:b], weight[a:b], n * n_terms)
                scores = (cells.reshape(n, n_terms) @ matrix).T
                best, floor = np.concatenate([best, scores], axis=1), 0.0
                if best.shape[1] >= k:
                    best = -np.partition(-best, k - 1, axis=1)[:, :k]
                    floor = best[:, -1:] - SLACK
                number, row = np.nonzero((scores > 0) & (scores >= floor))
                yield pa.record_batch({"number": pa.array(number, pa.int32()), "review_id": ids.take(pa.array(low + row)),
                                       "score": pa.array(scores[number, row], pa.float64())})

    return found


def search(index: BlockIndex, weights: DataFrame, k: int = 500) -> Retrieved:
    """The first k reviews of each query (query_id, term, query_weight), as ``tfidf.top_k`` of all scores gives them."""
    weights = materialize(weights, "query-weights")
    n_weights = weights.count()
    impact = F.col("top") * F.col("query_weight")
    groups = (weights.join(small(index.levels, index.n_levels), "term").withColumn("impact", impact)
              .withColumn("most", F.max("impact").over(W.partitionBy("query_id", "term"))).withColumn("n_all", F.sum("n").over(W.partitionBy("query_id"))))
    few, many = groups.where(F.col("n_all") <= DENSE * k), groups.where(F.col("n_all") > DENSE * k)
    read = few.withColumns({"upto": F.col("parts"), "cap": F.lit(0.0)})
    scored = _read(index, read, n_weights * LEVELS).groupBy("query_id", "review_id").agg(F.sum("gain").alias("score"))
    n_many = many.agg(F.sum("n")).first()[0] or 0
    if k > 0 and n_many:
        ids = many.select(F.col("query_id").alias("_asked")).distinct()
        rest, also = None, many.select("query_id", "n")
        if n_many > SCAN:
            asked = weights.join(small(ids, n_weights), F.col("query_id").eqNullSafe(F.col("_asked")), "left_semi")
            rest = scanned(index.vectors, materialize(asked, "many-weights"), k)
        if rest is None:
            rest, also = _pruned(index, many, weights, n_weights, k)
        scored, read = scored.unionByName(rest), read.select("query_id", "n").unionByName(also)
    total = lambda df, name: df.groupBy("query_id").agg(F.sum("n").alias(name))
    report = (total(groups, "n_postings").join(total(read, "n_read"), "query_id", "left")
              .join(scored.groupBy("query_id").agg(F.count("*").alias("n_scored")), "query_id", "left").fillna(0, ["n_read", "n_scored"]))
    return Retrieved(tfidf.top_k(scored, k), report)


def retrieve(index: BlockIndex, queries: DataFrame, model: tfidf.TfidfModel, k: int = 500) -> DataFrame:
    """(query_id, review_id, score, rank) for a whole table of term lists."""
    return search(index, tfidf.query_weights(queries, model), k).ranked


def retrieve_plain(plain: DataFrame, queries: DataFrame, model: tfidf.TfidfModel, k: int = 500) -> DataFrame:
    """``tfidf.retrieve`` on plain postings (review_id, term, weight). Where the queries meet many of them, the postings of
    their terms are gathered by review once, as numbers, and scored there, so what is shuffled does not grow with the queries."""
    weights = materialize(tfidf.query_weights(queries, model), "query-weights")
    met = weights.join(small(model.vocabulary.select("term", "df"), model.max_features), "term").agg(F.sum("df")).first()[0] or 0
    if k > 0 and met > SCAN:
        asked = _asked(weights, k)
        if asked is not None:
            places = weights.sparkSession.createDataFrame(list(asked.places.items()), "term string, place int")
            rows = plain.join(small(places, model.max_features), "term").groupBy("review_id").agg(F.collect_list(F.struct("place", "weight")).alias("entries"))
            parts = rows.select("review_id", F.col("entries.place").alias("terms"), F.col("entries.weight").alias("weights"))
            return tfidf.top_k(_scored(parts, weights, asked, k), k)
    return tfidf.top_k(tfidf.score(plain, weights), k)


def match_counts(index: BlockIndex, weights: DataFrame) -> DataFrame:
    """(query_id, n): reviews with any of the query's terms; where rows repeat an id, as often as the first of these terms has rows.

    The queries of a term are a row of bits. A review's own row of the index gives the union of its terms' bits, so a pair of
    query and review is a bit, each task adds up its reviews and only counts are shuffled. Queries whose bits would not fit
    in a task are counted from the pairs themselves.
    """
    asked = materialize(weights.groupBy("query_id", "term").agg(F.count("*").alias("times")), "query-terms")
    ids = asked.select("query_id").distinct()
    size = asked.agg(F.count("*").alias("rows"), F.max("times").alias("times")).first()
    n_queries, n_terms = ids.count(), asked.select("term").distinct().count()
    held = index.vectors.select("review_id", F.col("entries.term").alias("held"))
    cells, single = n_terms * n_queries, (size["times"] or 1) == 1
    if size["rows"] > BROADCAST_ROWS or cells > (MOST_BITS if single else min(MOST_BITS, MOST_CELLS)):
        hits = exploded(held, ["review_id"], "held", "term").join(asked, "term").groupBy("query_id", "review_id", "term")
        firsts = hits.agg(F.sum("times").alias("n")).groupBy("query_id", "review_id").agg(F.min(F.struct("term", "n"))["n"].alias("n"))
        return firsts.groupBy("query_id").agg(F.sum("n").alias("n"))
    rows = asked.collect()
    numbers = {q: i for i, q in enumerate({r["query_id"]: None for r in rows})}
    places = {t: i for i, t in enumerate(sorted({r["term"] for r in rows}))}
    bits = np.zeros((len(places), -(-len(numbers) // 8)), "uint8")
    times = None if single else np.ones((len(places), len(numbers)), "int32")
    for r in rows:
        place, number = places[r["term"]], numbers[r["query_id"]]
        bits[place, number >> 3] |= 128 >> (number & 7)
        if not single:
            times[place, number] = r["times"]
    counts = held.select("held").mapInArrow(_bit_counts(list(places), bits, len(numbers), times), "number int, n bigint")
    named = asked.sparkSession.createDataFrame([(q, i) for q, i in numbers.items()], f"query_id {ids.schema['query_id'].dataType.simpleString()}, number int")
    counts = counts.groupBy("number").agg(F.sum("n").alias("n")).where(F.col("n") > 0)
    return counts.join(small(named, n_queries), "number").select("query_id", "n")


def _bit_counts(terms: list[str], bits: np.ndarray, n_queries: int, times: np.ndarray | None = None):
    """Arrow batches of term lists to (number, n): the lists that hold any term of query ``number``.

    A list that names a term again (rows of one id) counts as often as its first term of the query is there, times that
    term's rows in the query; only such lists are looked at one by one.
    """
    def repeated(place):
        place, n = np.unique(place, return_counts=True)
        asked = np.unpackbits(bits[place], axis=1, count=n_queries)
        first = asked.argmax(axis=0)
        found = n[first] * asked.any(axis=0)
        return found if times is None else found * times[place[first], np.arange(n_queries)]

    def count(batches):
        total, known = np.zeros(n_queries, "int64"), pa.array(terms, pa.string())
        for batch in batches:
            lists = batch.column(0)
            place = pc.fill_null(pc.index_in(lists.flatten().cast(pa.string()), value_set=known), -1).to_numpy()
            review = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            review, place = review[place >= 0], place[place >= 0]
            again = np.zeros(len(lists), bool) if times is None else np.ones(len(lists), bool)
            if times is None:
                keys = np.sort(review * len(terms) + place)
                again[keys[1:][keys[1:] == keys[:-1]] // max(len(terms), 1)] = True
            odd = again[review]
            for own in np.split(place[odd], np.flatnonzero(np.diff(review[odd])) + 1) if odd.any() else []:
                total += repeated(own)
            review, place = review[~odd], place[~odd]
            starts = np.flatnonzero(np.diff(review, prepend=-1))
            ends = np.append(starts[1:], len(review))
            first = 0
            while first < len(starts):  # some reviews at a time, one at least, so the unions stay small
                last = max(first + 1, int(np.searchsorted(ends, starts[first] + UNION_BYTES // bits.shape[1], "right")))
                union = np.bitwise_or.reduceat(bits[place[starts[first]:ends[last - 1]]], starts[first:last] - starts[first], axis=0)
                total += np.unpackbits(union, axis=1, count=n_queries).sum(axis=0, dtype="int64")
                first = last
        yield pa.record_batch({"number": pa.array(np.arange(n_queries), pa.int32()), "n": pa.array(total, pa.int64())})

    return count
