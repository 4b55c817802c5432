"""Sentence polarity from a word table, symbols, states and transitions."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from voxtable.functions import lexicons as lex, text as tx
from voxtable.operators import counting
from voxtable.operators.rows import numbered
from voxtable.sources.scratch import BROADCAST_ROWS, literal_table

# The functions below go to the tasks as they are: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE_PREFIX = ["pos", "neg", "neu"]
TRANSITION_KEYS = [f"{a}_to_{b}" for a in STATE_PREFIX for b in STATE_PREFIX]


def default_polarity(spark) -> DataFrame:
    return literal_table(spark, {"word": list(lex.POLARITY), "valence": list(lex.POLARITY.values())})


def _adjusted(valence: Column) -> Column:
    """Boosters and negations among the three words before."""
    v, sign = valence, F.signum(valence)
    for k, damping in ((1, 1.0), (2, 0.95), (3, 0.9)):
        before = F.col(f"before{k}")
        step = F.when(before.isin(lex.BOOSTERS_UP), lex.BOOST * damping).when(
            before.isin(lex.BOOSTERS_DOWN), -lex.BOOST * damping).otherwise(0.0)
        v = v + F.when(F.col(f"before{k}").isNotNull(), sign * step).otherwise(0.0)
    negated = F.lit(False)
    for k in (1, 2, 3):
        negated = negated | F.coalesce(F.col(f"before{k}").isin(lex.NEGATIONS), F.lit(False))
    return F.when(negated, v * lex.NEGATION_FACTOR).otherwise(v)


def compound(total: Column) -> Column:
    return total / F.sqrt(total * total + lex.POLARITY_ALPHA)


def _known_valences(polarity: DataFrame) -> dict | None:
    """For each word the sum of its valences and that of their signs; None where the words are too many for a task."""
    named = polarity.where(F.col("word").isNotNull()).groupBy("word").agg(
        F.coalesce(F.sum("valence"), F.lit(0.0)).cast("double").alias("v"), F.coalesce(F.sum(F.signum("valence")), F.lit(0.0)).cast("double").alias("sign"))
    rows = named.limit(BROADCAST_ROWS + 1).collect()
    return {r["word"]: (r["v"], r["sign"]) for r in rows} if len(rows) <= BROADCAST_ROWS else None


def _summer(valences: dict, is_word: bytes):
    """Arrow batches of (key, sentences in lower case) to (key, rows ARRAY<STRUCT<s, marks>>): the sum of a sentence's adjusted valences and its
    exclamation marks, 4 at most. Words are numbers of a batch's dictionary; the three before a word are three shifts of them."""
    def boost(words):
        up, down = (pc.is_in(words, value_set=pa.array(list(x), pa.string())).to_numpy(zero_copy_only=False) for x in (lex.BOOSTERS_UP, lex.BOOSTERS_DOWN))
        return lex.BOOST * (up.astype(float) - (down & ~up))

    def summed(batches):
        flags = np.unpackbits(np.frombuffer(is_word, "uint8")).astype(bool)
        known = pa.array(list(valences), pa.string())
        values = np.array([*valences.values(), (0.0, 0.0)], "float64").reshape(-1, 2)
        for whole in batches:
            for batch in counting.slices(whole, _bytes(whole.column(1))):
                lists = batch.column(1)
                sentences = lists.flatten().cast(pa.large_string())
                tokens = pc.ascii_split_whitespace(counting.spaced(sentences, flags))
                n = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
                flat = tokens.flatten().cast(pa.string()).dictionary_encode()
                words, code = flat.dictionary, flat.indices.to_numpy(zero_copy_only=False).astype("int64")
                place = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False)
                at = np.flatnonzero(place[code] >= 0)
                sentence = np.repeat(np.arange(len(n)), n)
                step = boost(words)
                negation = pc.is_in(words, value_set=pa.array(list(lex.NEGATIONS), pa.string())).to_numpy(zero_copy_only=False)
                v, sign = values[place[code[at]]].T
                v, negated = v.copy(), np.zeros(len(at), bool)
                for k, damping in ((1, 1.0), (2, 0.95), (3, 0.9)):
                    near = np.maximum(at - k, 0)
                    there = (at >= k) & (sentence[near] == sentence[at])
                    before = code[near]
                    v += np.where(there, sign * step[before] * damping, 0.0)
                    negated |= there & negation[before]
                total = np.bincount(sentence[at], np.where(negated, v * lex.NEGATION_FACTOR, v), len(n))
                marks = np.where(pc.is_null(sentences).to_numpy(zero_copy_only=False), 4, np.minimum(_exclamations(sentences), 4))
                entries = pa.StructArray.from_arrays([pa.array(total, pa.float64()), pa.array(marks, pa.int32())], ["s", "marks"])
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(offsets, entries)], [batch.schema.names[0], "rows"])

    return summed


def _bytes(lists: pa.Array) -> pa.Array:
    """The length of all texts of each list."""
    size = pc.fill_null(pc.binary_length(lists.flatten()), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    return pa.array(np.diff(np.concatenate([[0], np.cumsum(size, dtype="int64")])[ends], prepend=0))


def _exclamations(texts: pa.Array) -> np.ndarray:
    """How many exclamation marks each text has."""
    texts = pa.concat_arrays([texts, pa.array([], pa.large_string())])  # starts at its buffer's start
    offsets = np.frombuffer(texts.buffers()[1], "int64", len(texts) + 1)
    places = np.flatnonzero(np.frombuffer(texts.buffers()[2] or b"", "uint8")[:offsets[-1]] == ord("!"))
    return np.diff(np.searchsorted(places, offsets))


def _sentence_sums(reviews: DataFrame, polarity: DataFrame | None, key: str, sentences: str) -> DataFrame | None:
    """(key, rows): a row an input row; None where the polarity words do not fit in a task."""
    valences = _known_valences(default_polarity(reviews.sparkSession) if polarity is None else polarity)
    if valences is None:
        return None
    lowered = reviews.select(key, F.transform(sentences, F.lower).alias("_lowered"))
    fields = f"`{key}` {reviews.schema[key].dataType.simpleString()}, rows array<struct<s:double,marks:int>>"
    return lowered.mapInArrow(_summer(valences, counting.word_bits(reviews.sparkSession, "'")), fields)


def _loud(s: Column, marks: Column) -> Column:
    return compound(s + F.signum(s) * marks * lex.EXCLAMATION_BOOST)


def sentence_polarity(reviews: DataFrame, polarity: DataFrame | None = None, key: str = "review_id",
                      sentences: str = "sentences") -> DataFrame:
    """(key, sentence_no, polarity in [-1, 1]) for every sentence; sentences of one key and number count as one.

    Words meet the polarity table in Arrow batches, in a join where it is too large for a task; the sums per sentence combine on
    the map side, so what is shuffled is one narrow row per sentence.
    """
    polarity = default_polarity(reviews.sparkSession) if polarity is None else polarity
    rows = _sentence_sums(reviews, polarity, key, sentences)
    if rows is not None:
        own = numbered(rows, [key], "rows", "sentence_no", "row")
        sums = own.groupBy(key, "sentence_no").agg(F.sum("row.s").alias("s"), F.max("row.marks").alias("marks"))
    else:
        sums = _joined_sums(reviews, polarity, key, sentences)
    return sums.select(key, "sentence_no", _loud(F.col("s"), F.col("marks")).alias("polarity"))


def _joined_sums(reviews: DataFrame, polarity: DataFrame, key: str, sentences: str) -> DataFrame:
    """(key, sentence_no, s, marks) by a join of the words."""
    per_sentence = numbered(reviews, [key], sentences, "sentence_no", "sentence")
    tokens = F.regexp_extract_all(F.lower("sentence"), F.lit(f"[{tx.WORD_CHARS}']+"), F.lit(0))
    marks = F.least(F.length("sentence") - F.length(F.replace("sentence", F.lit("!"), F.lit(""))), F.lit(4))
    rows = tx.let(tokens, lambda ts: F.transform(ts, lambda w, i: F.struct(
        w.alias("word"), *[F.when(i >= k, F.get(ts, i - k)).alias(f"before{k}") for k in (1, 2, 3)])))
    staged = per_sentence.select(key, "sentence_no", marks.alias("marks"), rows.alias("rows"))
    words = staged.select(key, "sentence_no", "marks", F.inline_outer("rows"))
    valued = words.join(polarity.select("word", "valence"), "word", "left")
    total = F.coalesce(F.sum(_adjusted(F.col("valence"))), F.lit(0.0))
    return valued.groupBy(key, "sentence_no").agg(total.alias("s"), F.max("marks").alias("marks"))


def symbol(score) -> Column:
    """Polarity -> 0..4, borders half open."""
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s < -0.6, 0).when(s < -0.2, 1).when(s < 0.2, 2).when(s < 0.6, 3).otherwise(4)


def fallback_state(score) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s >= 0.2, "positive").when(s <= -0.2, "negative").otherwise("neutral")


def observations(reviews: DataFrame, polarity: DataFrame | None = None, key: str = "review_id",
                 sentences: str = "sentences") -> DataFrame:
    """(key, scores, symbols): one array entry per sentence; rows of one key are added up sentence by sentence.

    A review is one row of arrays from the words on; only rows of one key are brought together.
    """
    polarity = default_polarity(reviews.sparkSession) if polarity is None else polarity
    rows = _sentence_sums(reviews, polarity, key, sentences)
    if rows is None:
        scored = _joined_sums(reviews, polarity, key, sentences).select(key, "sentence_no", _loud(F.col("s"), F.col("marks")).alias("polarity"))
        ordered = scored.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("sentence_no", "polarity"))).alias("s"))
        scores = ordered.select(key, F.transform("s", lambda x: x["polarity"]).alias("scores"))
    else:
        def at(lists: Column, i: Column) -> Column:
            own = F.transform(lists, lambda l: F.get(l, i))
            total = F.aggregate(own, F.lit(0.0), lambda acc, x: acc + F.coalesce(x["s"], F.lit(0.0)))
            return _loud(total, F.array_max(F.transform(own, lambda x: x["marks"])))

        longest = F.array_max(F.transform("lists", F.size))
        several = tx.let(F.col("lists"), lambda ls: F.transform(F.sequence(F.lit(0), longest - 1), lambda i: at(ls, i)))
        alone = F.transform(F.get("lists", F.lit(0)), lambda x: _loud(x["s"], x["marks"]))
        lists = rows.where(F.size("rows") > 0).groupBy(key).agg(F.collect_list("rows").alias("lists"))
        scores = lists.select(key, F.when(F.size("lists") == 1, alone).otherwise(several).alias("scores"))
    return scores.select(key, "scores", F.transform("scores", symbol).alias("symbols"))


def transition_counts(states) -> Column:
    """ARRAY<BIGINT> of the 9 state pairs in key order, counted inside the row."""
    st = F.col(states) if isinstance(states, str) else states
    code = lambda s: F.when(s == "positive", 0).when(s == "negative", 1).otherwise(2)

    def pairs(ss: Column) -> Column:
        return F.transform(F.slice(ss, 1, F.greatest(F.size(ss) - 1, F.lit(0))),
                           lambda s, i: code(s) * 3 + code(F.get(ss, i + 1)))

    return tx.let(pairs_of(st, pairs), lambda ps: F.transform(
        F.sequence(F.lit(0), F.lit(8)), lambda k: F.size(F.filter(ps, lambda p: p == k)).cast("bigint")))


def pairs_of(states: Column, body) -> Column:
    return tx.let(states, body)


def transitions(states) -> Column:
    """MAP of the 9 transition shares; 0 for a state that is never left."""
    def shares(cs: Column) -> Column:
        def share(k: int) -> Column:
            first = k // 3 * 3
            total = F.get(cs, F.lit(first)) + F.get(cs, F.lit(first + 1)) + F.get(cs, F.lit(first + 2))
            return F.when(total > 0, F.get(cs, F.lit(k)) / total).otherwise(0.0)

        return F.array(*[share(k) for k in range(9)])

    return F.map_from_arrays(tx.string_array(TRANSITION_KEYS), tx.let(transition_counts(states), shares))


def mean_transitions(sequences: DataFrame, pooled: bool = False) -> DataFrame:
    """9 rows (from_state, to_state, probability).

    The plain mean counts a review that never leaves a state as 0; ``pooled`` divides summed
    counts instead. Nine sums over the sequences, nothing is exploded.
    """
    names = ["Positive", "Negative", "Neutral"]
    if pooled:
        counted = sequences.select(transition_counts("sentiment_states").alias("c"))
        sums = counted.agg(*[F.sum(F.get("c", F.lit(k))).alias(f"k{k}") for k in range(9)])
        total = lambda k: sum((F.col(f"k{k // 3 * 3 + j}") for j in range(3)), F.lit(0))
        value = lambda k: F.coalesce(F.col(f"k{k}") / F.nullif(total(k), F.lit(0)), F.lit(0.0))
    else:
        sums = sequences.agg(*[F.avg(F.col("transitions")[key]).alias(f"k{k}") for k, key in enumerate(TRANSITION_KEYS)])
        value = lambda k: F.col(f"k{k}")
    rows = [F.struct(F.lit(names[k // 3]).alias("from_state"), F.lit(names[k % 3]).alias("to_state"),
                     value(k).alias("probability")) for k in range(9)]
    return sums.select(F.inline(F.array(*rows)))


def common_patterns(sequences: DataFrame, top: int = 5) -> DataFrame:
    """Most frequent identical state sequences."""
    named = sequences.select(F.array_join("sentiment_states", ">").alias("pattern"))
    return named.groupBy("pattern").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pattern").limit(top)
