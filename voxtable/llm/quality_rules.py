"""Quality rules judged per document and per host.

Each document is measured and held against fixed rules. Failures are summed per host, each host's failure rate is
shrunk towards the rate of all hosts by a beta prior fitted to the hosts themselves (method of moments), and the host
verdict is joined back to the documents.

Defined cases: null or empty text has no words and fails; a null host is no host, such documents are judged by the
document rules alone; repeated rows are judged and counted each; an empty table gives no rows; other columns are not
read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from voxtable.llm.arrow import coded, raw, slices, text_of, words_of
from voxtable.sources.scratch import materialize

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: A host is rejected when its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[at])


def _repeats(index: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Words of each text that lie in a 3-word window found at least twice in that text."""
    n, docs = len(index), np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    if n < 3:
        return np.zeros(len(starts) - 1, np.int64)
    _, pair = np.unique(index[:-1] * (index.max() + 1) + index[1:], return_inverse=True)
    at = np.flatnonzero(docs[:-2] == docs[2:])
    _, triple = np.unique(pair[at] * (index.max() + 1) + index[at + 2], return_inverse=True)
    _, which, times = np.unique(docs[at] * (len(at) + 1) + triple, return_inverse=True, return_counts=True)
    again = at[times[which] >= 2]
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[again + k] = True
    return _sums(covered, starts)


def _repeated_lines(texts: pa.Array) -> np.ndarray:
    lists = pc.split_pattern(texts, "\n")
    lines, at = lists.flatten(), lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    docs = np.repeat(np.arange(len(texts)), np.diff(at))
    full = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0).to_numpy(zero_copy_only=False)
    index, distinct = coded(lines)
    docs, key = docs[full], docs[full] * (len(distinct) + 1) + index[full]
    _, first = np.unique(key, return_index=True)
    return np.bincount(docs, minlength=len(texts)) - np.bincount(docs[first], minlength=len(texts))


def measures(texts: pa.Array) -> list[np.ndarray]:
    """MEASURES of each text, all texts of a batch at once."""
    data, at = raw(texts)
    kind = np.zeros(256, np.uint8)
    kind[0x80:0xC0] = 1
    kind[list(SPACES)] = 1
    kind[list(SYMBOLS)] = 2
    kinds = kind[data]
    words, starts = words_of(texts)
    index, _ = coded(words)
    return [np.diff(starts), _sums(kinds != 1, at), _sums(kinds == 2, at), _repeated_lines(texts), _repeats(index, starts)]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        values, passed = measures(text_of(batch)), [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch[c] for c in passed), *(pa.array(v.astype(np.int64)) for v in values)], [*passed, *MEASURES])


def fails(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEATED_PERCENT * n_words)


def host_rates(judged: DataFrame) -> DataFrame:
    """host, n, failed and shrunk_rate of (host, base_failed) rows.

    The prior's mean is the failure rate of all documents with a host. Its strength comes from the spread of the
    hosts' rates beyond what chance alone gives, so hosts with few documents move most. Two sums reach the driver.
    """
    hosts = materialize(judged.where(F.col("host").isNotNull()).groupBy("host").agg(
        F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")), "hosts")
    total = hosts.agg(F.count("*").alias("hosts"), F.sum("n").alias("n"), F.sum("failed").alias("failed"),
                      F.sum(F.col("n") * F.col("n")).cast("double").alias("squares"),
                      F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("between")).first()
    a, b = beta_prior(total["hosts"], total["n"] or 0, total["failed"] or 0, total["squares"] or 0.0, total["between"] or 0.0)
    return hosts.withColumn("shrunk_rate", (F.col("failed") + F.lit(a)) / (F.col("n") + F.lit(a + b)))


def beta_prior(hosts: int, n: int, failed: int, squares: float, between: float) -> tuple[float, float]:
    """Parameters of the beta prior by weighted moments.

    between: sum over hosts of failed^2 / n. With rates that vary no more than chance the prior is as strong as all
    documents together; with one host, or rates of 0 or 1 throughout, it is (mean, 1 - mean).
    """
    if not n:
        return 1.0, 1.0
    mean = failed / n
    free = n - squares / n
    if hosts < 2 or mean <= 0 or mean >= 1 or free <= 0:
        return mean, 1 - mean
    chance = mean * (1 - mean)
    spread = (between - n * mean * mean - (hosts - 1) * chance) / free
    share = min(1.0, max(spread / chance, 0.0))
    strength = min(float(n), max(1.0, (1 - share) / share)) if share > 0 else float(n)
    return mean * strength, (1 - mean) * strength


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
           max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per row of docs: the id, MEASURES, base_failed, host_rate, host_rejected, kept."""
    return _assessed(docs, id_col, text_col, host_col, max_host_rate).select(F.col("id").alias(id_col), *MEASURES, "base_failed", "host_rate", "host_rejected", "kept")


def _assessed(docs: DataFrame, id_col: str, text_col: str, host_col: str, max_host_rate: float, **keys: Column) -> DataFrame:
    """As assess, with id for the id, and long columns keys of docs."""
    measured = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text"), *(c.alias(k) for k, c in keys.items())).mapInArrow(
        _measured, f"id {docs.schema[id_col].dataType.simpleString()}, host string, " + ", ".join(f"{m} long" for m in [*keys, *MEASURES]))
    judged = materialize(measured.withColumn("base_failed", fails(F.col("n_words"), F.col("n_repeat_words"))), "judged")
    hosts = host_rates(judged).select("host", F.col("shrunk_rate").alias("host_rate"))
    rejected = F.coalesce(F.col("host_rate") > max_host_rate, F.lit(False))
    return judged.join(hosts, "host", "left").select(
        "id", *keys, *MEASURES, "base_failed", "host_rate", rejected.alias("host_rejected"),
        (~F.col("base_failed") & ~rejected).alias("kept"))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of docs, all columns, that are kept; a row is found again by its id and the digests of its text and host."""
    keys = {"text_key": F.xxhash64(text_col), "host_key": F.xxhash64(F.col(host_col).cast("string"))}
    kept = _assessed(docs, id_col, text_col, host_col, max_host_rate, **keys).where("kept").select(
        F.col("id").alias("kept_id"), F.col("text_key").alias("kept_text"), F.col("host_key").alias("kept_host")).distinct()
    same = (F.xxhash64(docs[text_col]) == kept["kept_text"]) & (F.xxhash64(docs[host_col].cast("string")) == kept["kept_host"])
    return docs.join(kept, docs[id_col].eqNullSafe(kept["kept_id"]) & same, "left_semi")
