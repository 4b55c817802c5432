"""Search terms of many texts counted at once, in Arrow batches inside the tasks.

A batch's words become numbers (one dictionary a slice), bigrams are pairs of neighbouring numbers, and sorting
(row, number) gives the counts of each text. The terms are those of ``tx.search_terms``: Spark lowers the texts, and Spark says
which characters belong to words, so nothing depends on Python's Unicode version.
"""

from __future__ import annotations

import sys
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from voxtable.functions import lexicons as lex, text as tx

# The functions below go to the tasks as they are: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of text that are counted at once, one text at least.
SLICE = 1 << 23


@cache
def word_bits(spark: SparkSession, also: str = "") -> bytes:
    """A bit for each code point: whether ``tx.WORD_CHARS`` or ``also`` has it."""
    points = spark.range(0x110000).where(~F.col("id").between(0xD800, 0xDFFF))  # no surrogates
    char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    flags = np.zeros(0x110000, bool)
    flags[points.where(char.rlike(f"[{tx.WORD_CHARS}{also}]")).agg(F.collect_list("id")).first()[0]] = True
    return np.packbits(flags).tobytes()


def _lowered(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    return docs.select(*keys, F.lower(text).alias("_lowered"))


def slices(batch: pa.RecordBatch, size: pa.Array):
    """Parts of a batch with a size of SLICE in all, one row at least."""
    ends, low = np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False), dtype="int64"), 0
    while low < len(ends):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + SLICE, "right")))
        yield batch.slice(low, high - low)
        low = high


def spaced(texts: pa.Array, is_word: np.ndarray) -> pa.Array:
    """The texts with a space for every byte of a character that belongs to no word."""
    texts = pa.concat_arrays([texts.cast(pa.large_string()), pa.array([], pa.large_string())])  # starts at its buffer's start
    data = np.frombuffer(texts.buffers()[2] or b"", "uint8")
    own = np.arange(256, dtype="uint8")
    own[:128][~is_word[:128]] = 32
    out = own[data]  # ASCII is done; longer characters are looked at one by one
    at = np.flatnonzero(data >= 0xC0)
    if len(at):
        more = (data[at] >= 0xE0).astype("int64") + (data[at] >= 0xF0) + 1  # bytes after the first
        point = data[at].astype("int64") & (0x3F >> more)
        for k in (1, 2, 3):
            longer = more >= k
            point[longer] = point[longer] << 6 | data[np.minimum(at[longer] + k, len(data) - 1)] & 0x3F
        other = ~is_word[np.minimum(point, len(is_word) - 1)]
        for k in range(4):
            out[(at + k)[other & (more >= k)]] = 32
    return pa.LargeStringArray.from_buffers(len(texts), texts.buffers()[1], pa.py_buffer(out), texts.buffers()[0], texts.null_count)


def _kept(batch: pa.RecordBatch, stop: pa.Array, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and number of each token that is no stop word, in text order, and the words by number."""
    lists = pc.ascii_split_whitespace(spaced(batch.column("_lowered"), is_word))
    row = np.repeat(np.arange(len(batch)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    flat = lists.flatten().cast(pa.string()).dictionary_encode()
    words, code = flat.dictionary, flat.indices.to_numpy(zero_copy_only=False).astype("int64")
    wanted = pc.and_(pc.greater_equal(pc.utf8_length(words), 2), pc.invert(pc.is_in(words, value_set=stop)))
    keep = wanted.to_numpy(zero_copy_only=False).astype(bool)[code]
    return row[keep], code[keep], words


def _cutter(docs: DataFrame, stop_words):
    """``_kept`` with the stop words and the characters of words; only their bits go to the tasks."""
    stop = pa.array(lex.SEARCH_STOP_WORDS if stop_words is None else list(stop_words), pa.string())
    bits = word_bits(docs.sparkSession)

    def cut(batches):
        is_word = np.unpackbits(np.frombuffer(bits, "uint8")).astype(bool)
        for batch in batches:
            for part in slices(batch, pc.binary_length(batch.column("_lowered"))):
                yield part, *_kept(part, stop, is_word)

    return cut


def _places(words: pa.Array, known: pa.Array) -> np.ndarray:
    """Position of each word in ``known``, -1 where it is not there."""
    return pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False).astype("int64")


def _pairs(row: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and pair (first * n + second) of neighbours that are both known."""
    near = (row[1:] == row[:-1]) & (place[1:] >= 0) & (place[:-1] >= 0)
    return row[1:][near], place[:-1][near] * n + place[1:][near]


def _tallied(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct cells in order, and how often each is there."""
    cells = np.sort(cells)
    starts = np.flatnonzero(np.diff(cells, prepend=-1))
    return cells[starts], np.diff(starts, append=len(cells))


def _totals(row: np.ndarray, code: np.ndarray, names: pa.Array, name: str) -> pa.RecordBatch:
    n = max(len(names), 1)
    total, df = np.bincount(code, minlength=n), np.bincount(_tallied(row * n + code)[0] % n, minlength=n)
    some = np.flatnonzero(total)
    return pa.record_batch({name: names.take(pa.array(some)), "total": pa.array(total[some], pa.int64()), "df": pa.array(df[some], pa.int64())})


def _summed(parts: DataFrame, name: str) -> DataFrame:
    return parts.groupBy(name).agg(F.sum("total").alias("total"), F.sum("df").alias("df"))


def word_totals(docs: DataFrame, stop_words=None) -> DataFrame:
    """(term, total, df) of every word that is no stop word."""
    cut = _cutter(docs, stop_words)

    def counted(batches):
        for _, row, code, words in cut(batches):
            yield _totals(row, code, words, "term")

    return _summed(_lowered(docs).mapInArrow(counted, "term string, total bigint, df bigint"), "term")


def pair_totals(docs: DataFrame, words: list[str], stop_words=None) -> DataFrame:
    """(pair, total, df) of the bigrams of two of the words; a pair is first * len(words) + second."""
    cut, known = _cutter(docs, stop_words), pa.array(words, pa.string())

    def counted(batches):
        for _, row, code, own in cut(batches):
            row, pair = _pairs(row, _places(own, known)[code], len(known))
            pairs = pa.array(pair, pa.int64()).dictionary_encode()
            yield _totals(row, pairs.indices.to_numpy(zero_copy_only=False).astype("int64"), pairs.dictionary, "pair")

    return _summed(_lowered(docs).mapInArrow(counted, "pair bigint, total bigint, df bigint"), "pair")


def _term_counter(docs: DataFrame, terms: list[str], stop_words):
    """Function from batches to (batch, row, position in ``terms``, tf) of their slices, in row order."""
    cut, n = _cutter(docs, stop_words), max(len(terms), 1)
    parts = [t.split(" ") for t in terms]
    words = sorted({w for p in parts for w in p})
    number = {w: i for i, w in enumerate(words)}
    single = np.full(len(words) + 1, -1, "int64")  # the last is that of unknown words
    for i, p in enumerate(parts):
        if len(p) == 1:
            single[number[p[0]]] = i
    double = {number[p[0]] * len(words) + number[p[1]]: i for i, p in enumerate(parts) if len(p) == 2}
    known, keys = pa.array(words, pa.string()), pa.array(list(double), pa.int64())
    of_pair = np.array([*double.values(), -1], "int64")

    def counted(batches):
        for part, row, code, own in cut(batches):
            place = _places(own, known)[code]
            pair_row, pair = _pairs(row, place, len(words))
            term = np.concatenate([single[place], of_pair[_places(pa.array(pair, pa.int64()), keys)]])
            cells, tf = _tallied((np.concatenate([row, pair_row]) * n + term)[term >= 0])
            yield part, cells // n, cells % n, tf

    return counted


def _fields(docs: DataFrame, *keys: str) -> str:
    return ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)


def weights(docs: DataFrame, terms: list[str], idf: list[float], *keys: str, text: str = "text", stop_words=None) -> DataFrame:
    """(keys, ws ARRAY<STRUCT<term, w = tf * idf>>, square): a row for each document with a known term; square is the sum of w * w."""
    counter, names, factor = _term_counter(docs, terms, stop_words), pa.array(terms, pa.string()), np.array(idf, "float64")

    def weighed(batches):
        for part, row, term, tf in counter(batches):
            w = tf * factor[term]
            rows, n = _tallied(row)
            entries = pa.StructArray.from_arrays([names.take(pa.array(term)), pa.array(w)], ["term", "w"])
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            own = [part.column(i).take(pa.array(rows)) for i in range(len(keys))]
            square = np.bincount(row, w * w, len(part))[rows]
            yield pa.record_batch([*own, pa.ListArray.from_arrays(offsets, entries), pa.array(square)], [*keys, "ws", "square"])

    return _lowered(docs, *keys, text=text).mapInArrow(weighed, f"{_fields(docs, *keys)}, ws array<struct<term:string,w:double>>, square double")


def counts(docs: DataFrame, terms: list[str], key: str, text: str = "text", stop_words=None) -> DataFrame:
    """(key, terms ARRAY<STRUCT<number, tf>>): a row a document, empty without a known term; the number is the place in ``terms``."""
    counter = _term_counter(docs, terms, stop_words)

    def counted(batches):
        for part, row, term, tf in counter(batches):
            entries = pa.StructArray.from_arrays([pa.array(term, pa.int32()), pa.array(tf, pa.int64())], ["number", "tf"])
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(part)))]), pa.int32())
            yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(offsets, entries)], [key, "terms"])

    return _lowered(docs, key, text=text).mapInArrow(counted, f"{_fields(docs, key)}, terms array<struct<number:int,tf:bigint>>")


def sums(docs: DataFrame, terms: list[str], idf: list[float], factors: np.ndarray, key: str, text: str = "text", stop_words=None) -> DataFrame:
    """(key, square, s_0 .. s_n): a row a document, the sums of w * w and of w times each column of ``factors``; null without a known term."""
    counter, factor, width = _term_counter(docs, terms, stop_words), np.array(idf, "float64"), factors.shape[1]

    def summed(batches):
        for part, row, term, tf in counter(batches):
            w = tf * factor[term]
            none = np.bincount(row, minlength=len(part)) == 0
            columns = [np.bincount(row, w * x, len(part)) for x in [w, *factors[term].T]]
            yield pa.record_batch([part.column(0), *[pa.array(c, pa.float64(), mask=none) for c in columns]],
                                  [key, "square", *[f"s_{i}" for i in range(width)]])

    fields = ", ".join(f"s_{i} double" for i in range(width))
    return _lowered(docs, key, text=text).mapInArrow(summed, f"{_fields(docs, key)}, square double, {fields}")
