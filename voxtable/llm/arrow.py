"""Helpers for operators that work on Arrow batches inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 4_000_000


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text column of each holds about ``most`` bytes, or one row if that is longer."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cut = np.cumsum(size) // most
        starts = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def text_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The text column, null read as empty, with 64-bit offsets that begin at 0: some kernels misread those of slices."""
    texts = pc.fill_null(batch[column].cast(pa.large_string()), "")
    data, at = raw(texts)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(at), pa.py_buffer(data))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end, and the offsets of the texts in them."""
    texts = pa.concat_arrays([texts])
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if data is None or len(at) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The maximal runs of characters other than space and \\t to \\r, end to end, and where each text's words begin."""
    lists = pc.ascii_split_whitespace(texts)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if full.all():
        return flat, offsets
    return flat.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[offsets]


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """An index for each word and the distinct words."""
    if len(words) == 0:
        return np.zeros(0, np.int64), words
    d = words.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def hash64(values: pa.Array, seed: int = 0) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(v, seed) for v in values.to_pylist()), np.uint64, len(values))


def word_hashes(texts: pa.Array, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word, end to end, and where each text's words begin."""
    words, starts = words_of(texts)
    index, distinct = coded(words)
    return hash64(distinct, seed)[index] if len(index) else np.zeros(0, np.uint64), starts


def mixed(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that each bit depends on all."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BASE = np.uint64(0x9E3779B97F4A7C15)


def powers(base: int | np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def prefix_sums(items: np.ndarray) -> np.ndarray:
    """P[i] = sum over j < i of items[j] * BASE^-j, modulo 2^64: the rolling sums of a Rabin-Karp hash."""
    out = np.zeros(len(items) + 1, np.uint64)
    np.cumsum(items * powers(INVERSE, len(items)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Rabin-Karp hashes of the spans [lo, hi): equal for equal spans wherever they lie. scale: powers of BASE."""
    return mixed((prefix[hi] - prefix[lo]) * scale[lo])




def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    n, whole = len(values), -(-len(values) // width) * width
    x = np.full(whole, np.iinfo(values.dtype).max, values.dtype)
    x[:n] = values
    x = x.reshape(-1, width)
    ahead = np.minimum.accumulate(x, 1).ravel()
    behind = np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])
