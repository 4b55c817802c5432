"""Toxicity scores from a factorization machine over hashed terms.

A text's terms are its lower-cased words without outer punctuation and their PREFIXES, each once, hashed to BUCKETS. The score is the
logistic of bias + sum of term weights + sum over term pairs of the dot product of their factors, so that a pair such
as an insult with a group mention can weigh more than its parts. Terms of fewer than MIN_DOCS training texts have no
weight. A term is learnt if it is related with the label alone, or together with another of the PAIR_TERMS commonest terms
more than either is alone, so a term that says nothing by itself is learnt with the one that makes it matter; all others are
noise to so small a sample. Only learned buckets are stored, so the model's size is bounded by the training sample.

The sample is at most MAX_TRAIN labelled rows, taken by a hash order of the id. Everything else covers all rows.

Defined cases: null or empty text has no terms and gets the bias alone; rows with a null label or id do not train;
repeated rows are scored each; without a label of either kind the score is the share of positive labels (0 without
labels); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from voxtable.llm.arrow import coded, hash64, slices, text_of, words_of
from voxtable.llm.stored import stored

BUCKETS = 1 << 26
FACTORS = 4
MAX_TRAIN = 12_000
#: Learnt terms at most, those with most evidence.
MAX_TERMS = 50_000
MIN_DOCS = 5
#: Terms whose relation with the label is weaker than that (log-likelihood ratio) are learnt only as part of a pair; equal
#: texts count once.
MIN_EVIDENCE = 15.0
#: The commonest terms, of which all pairs are tried, and how much more evidence a pair has than either of its terms.
PAIR_TERMS = 2048
PAIR_EVIDENCE = 40.0
PAIR_ROWS = 2000
EPOCHS = 10
BATCH = 128
RATE = 0.08
DECAY = 0.02
#: Where Adagrad's sums of squares begin: large enough that rare terms take small steps and are not learnt by heart.
CALM = 0.001
THRESHOLD = 0.3
#: Words longer than that also give their first so many characters as a term, for inflected and compound forms.
PREFIXES = (4, 5, 6)
OUTER = ".,;:!?\"'()[]{}<>*_-"


@dataclass
class Machine:
    """bias, and for each learned bucket (ascending) its weight and factors."""

    bias: float
    buckets: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, docs: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Scores of n texts from their distinct (text, place of the bucket) pairs."""
        total = self.bias + np.bincount(docs, self.weights[at], n)
        for k in range(self.factors.shape[1]):
            v = self.factors[at, k]
            total += 0.5 * (np.bincount(docs, v, n) ** 2 - np.bincount(docs, v * v, n))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def placed(known: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Place of each bucket among the known ones, which ascend; -1 if it is none of them."""
    at = np.searchsorted(known, buckets)
    at[at == len(known)] = 0
    return np.where(known[at] == buckets, at, -1) if len(known) else np.full(len(buckets), -1)


def terms(texts: pa.Array, buckets: int = BUCKETS, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, bucket) pairs of a batch of texts, ascending; with ``known``, places of known buckets."""
    words, starts = words_of(texts)
    index, distinct = coded(words)
    if not len(index):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    plain = pc.utf8_trim(pc.utf8_lower(distinct), characters=OUTER)
    letters = np.asarray(pc.utf8_length(plain))
    docs = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    size, keys = buckets if known is None else max(len(known), 1), []
    for length in (0, *PREFIXES):
        bucket = (hash64(pc.utf8_slice_codeunits(plain, 0, length) if length else plain, length) % np.uint64(buckets)).astype(np.int64)
        if known is not None:
            bucket = placed(known, bucket)
        bucket[letters <= length] = -1
        at = np.flatnonzero(bucket[index] >= 0)
        keys.append(docs[at] * size + bucket[index[at]])
    key = np.unique(np.concatenate(keys))
    return key // size, key % size


def evidence(toxic: Column, count: Column, all_toxic: float, n: int) -> Column:
    """Log-likelihood ratio of term and label being related, from their counts over n texts."""
    cells = [(toxic, all_toxic * count), (count - toxic, (n - all_toxic) * count),
             (all_toxic - toxic, all_toxic * (n - count)), (n - count - all_toxic + toxic, (n - all_toxic) * (n - count))]
    return 2 * sum(F.when(seen > 0, seen * F.log(seen * n / expected)).otherwise(0.0) for seen, expected in cells)


def related(toxic: np.ndarray, count: np.ndarray, all_toxic: float, n: int) -> np.ndarray:
    """``evidence`` of arrays."""
    total = np.zeros(np.shape(count))
    for seen, expected in ((toxic, all_toxic * count), (count - toxic, (n - all_toxic) * count), (all_toxic - toxic, all_toxic * (n - count)),
                           (n - count - all_toxic + toxic, (n - all_toxic) * (n - count))):
        some = seen > 0
        total[some] += 2 * seen[some] * np.log(seen[some] * n / expected[some])
    return total


def paired(docs: np.ndarray, cols: np.ndarray, labels: np.ndarray, terms: int) -> np.ndarray:
    """Which terms are related with the label together with another one, by PAIR_EVIDENCE more than either is alone.

    docs, cols: distinct (row of labels, term) pairs by row. Texts with both terms are counted by products of 0/1 matrices.
    """
    n, all_toxic = len(labels), float(labels.sum())
    both, bad = np.zeros((terms, terms), np.float32), np.zeros((terms, terms), np.float32)
    for a in range(0, n, PAIR_ROWS):
        lo, hi = np.searchsorted(docs, [a, a + PAIR_ROWS])
        x = np.zeros((min(PAIR_ROWS, n - a), terms), np.float32)
        x[docs[lo:hi] - a, cols[lo:hi]] = 1
        both += x.T @ x
        x = x[labels[a:a + PAIR_ROWS] > 0]
        bad += x.T @ x
    own = related(bad.diagonal().astype(float), both.diagonal().astype(float), all_toxic, n)
    found = np.zeros(terms, bool)
    for a in range(0, terms, 256):
        part = slice(a, a + 256)
        strong = related(bad[part].astype(float), both[part].astype(float), all_toxic, n) - np.maximum(own[part, None], own) >= PAIR_EVIDENCE
        found[part] |= strong.any(1)
        found |= strong.any(0)
    return found


def fit_machine(docs: np.ndarray, cols: np.ndarray, labels: np.ndarray, known: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS,
                seed: int = 7) -> Machine:
    """Logistic loss, Adagrad steps over shuffled small batches. docs: rows of labels, ascending; cols: places in known."""
    n, rate = len(labels), float(labels.mean()) if len(labels) else 0.0
    none = Machine(float(np.log(max(rate, 1e-9) / max(1 - rate, 1e-9))), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, factors)))
    if rate in (0.0, 1.0) or not len(known):
        return none
    starts = np.searchsorted(docs, np.arange(n + 1))
    random = np.random.default_rng(seed)
    w, v, b = np.zeros(len(known)), random.normal(0, 0.01, (len(known), factors)), none.bias
    gw, gv, gb = np.full(len(known), CALM), np.full((len(known), factors), CALM), CALM
    for _ in range(epochs):
        order = random.permutation(n)
        for rows in np.array_split(order, max(1, n // BATCH)):
            lengths = starts[rows + 1] - starts[rows]
            row = np.repeat(np.arange(len(rows)), lengths)
            first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            idx = cols[np.arange(lengths.sum()) - first[row] + starts[rows][row]]
            vi = v[idx]
            s = np.stack([np.bincount(row, vi[:, k], len(rows)) for k in range(factors)], 1)
            q = np.bincount(row, (vi * vi).sum(1), len(rows))
            z = b + np.bincount(row, w[idx], len(rows)) + 0.5 * ((s * s).sum(1) - q)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[rows]) / len(rows)
            touched, slot = np.unique(idx, return_inverse=True)
            dw = np.bincount(slot, g[row], len(touched)) + DECAY * w[touched] / len(rows)
            dv = np.stack([np.bincount(slot, g[row] * (s[row, k] - vi[:, k]), len(touched)) for k in range(factors)], 1)
            dv += DECAY * v[touched] / len(rows)
            gw[touched] += dw * dw
            gv[touched] += dv * dv
            w[touched] -= RATE * dw / np.sqrt(gw[touched])
            v[touched] -= 0.02 * dv / np.sqrt(gv[touched])
            gb += g.sum() ** 2
            b -= RATE * g.sum() / np.sqrt(gb)
    return Machine(float(b), known, w, v)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_train: int) -> DataFrame:
    """(label, buckets) of at most max_train labelled documents; the ids are bounded, so they are broadcast."""
    chosen = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
              .select(F.col(id_col).alias("label_id"), F.col(label_col).cast("double").alias("label"))
              .withColumn("place", F.xxhash64("label_id")).orderBy("place", "label_id", "label").limit(max_train))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            row, bucket = terms(text_of(batch))
            at = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["place"], batch["label"], pa.ListArray.from_arrays(at, bucket)], ["place", "label", "buckets"])

    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .join(F.broadcast(chosen), F.col("id") == F.col("label_id")).select("place", "label", "text")
            .mapInArrow(found, "place long, label double, buckets array<long>"))


def learnable(rows: DataFrame, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the training rows: (row, place of the known term) pairs, and the rows' labels."""

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.asarray(pc.list_value_length(batch["buckets"]), dtype=np.int64)
            at = placed(known, batch["buckets"].flatten().to_numpy(zero_copy_only=False))
            ends = np.concatenate([[0], np.cumsum(at >= 0)])[np.concatenate([[0], np.cumsum(size)])].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["place"], batch["label"], pa.ListArray.from_arrays(pa.array(ends), pa.array(at[at >= 0].astype(np.int32)))], ["place", "label", "cols"])

    sample = rows.mapInArrow(narrowed, "place long, label double, cols array<int>").toArrow().sort_by("place")
    sizes = np.asarray(pc.list_value_length(sample["cols"]), dtype=np.int64)
    return np.repeat(np.arange(len(sizes)), sizes), pc.list_flatten(sample["cols"]).to_numpy().astype(np.int64), np.asarray(sample["label"], dtype=float)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_train: int = MAX_TRAIN, max_terms: int = MAX_TERMS) -> Machine:
    """Train on a bounded sample of labelled rows. Spark counts the terms; only those with evidence, alone or in pairs, come to the driver."""
    rows = stored(training_rows(docs, labels, id_col, text_col, label_col, max_train).groupBy(F.xxhash64("buckets").alias("text_key"))
                  .agg(F.min_by(F.struct("place", "label", "buckets"), "place").alias("r")).select("r.*"), "training")
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    terms_of = rows.select("label", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("label").alias("toxic"))
    counted = stored(terms_of.where(F.col("n") >= MIN_DOCS), "terms")
    own = (counted.withColumn("evidence", evidence(F.col("toxic"), F.col("n"), toxic, n)).where(F.col("evidence") >= MIN_EVIDENCE)
           .orderBy(F.desc("evidence"), "bucket").limit(max_terms).select("bucket").toArrow()["bucket"].to_numpy())
    common = np.sort(counted.orderBy(F.desc("n"), "bucket").limit(PAIR_TERMS).select("bucket").toArrow()["bucket"].to_numpy())
    known = np.union1d(own, common[paired(*learnable(rows, common), len(common))]) if len(common) else own
    docs_of, cols, truth = learnable(rows, known)
    return fit_machine(docs_of, cols, truth, known)


def _scored(docs: DataFrame, machine: Machine, columns: list[str], text_col: str, threshold: float) -> DataFrame:
    """The columns as c0, c1, ..., then toxicity and toxic, row by row and without a shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(machine)
    names = [f"c{k}" for k in range(len(columns))]

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            row, at = terms(text_of(batch), known=model.value.buckets)
            s = model.value.scores(row, at, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*names, "toxicity", "toxic"])

    carried = [F.col(c).alias(n) for c, n in zip(columns, names, strict=True)]
    schema = docs.select(*carried).schema.add("toxicity", "double").add("toxic", "integer")
    return docs.select(*carried, F.col(text_col).alias("text")).mapInArrow(fn, schema)


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: the id, toxicity (0 to 1) and toxic (1 from the threshold on, else 0)."""
    return _scored(docs, machine, [id_col], text_col, threshold).withColumnRenamed("c0", id_col)


def clean(docs: DataFrame, machine: Machine, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that are not scored toxic."""
    kept = _scored(docs, machine, docs.columns, text_col, threshold).where("toxic = 0")
    return kept.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)))
