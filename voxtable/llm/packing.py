"""Harmonic packing of tokenized documents into sequences of CAPACITY tokens.

Whole sequences are cut off a document first; what is left goes whole into its reciprocal-capacity class: class k takes
lengths in (CAPACITY / (k + 1), CAPACITY / k], and a bin of the class holds k of them. Each task fills the bins of every
class on its own, always with the fixed number, so there is no shuffle and no shared state. A full bin's gap is filled
with the task's shortest documents, end to end; only these are cut, at most once a gap. What is open when a batch ends is
held for the next one (under one bin a class); what is open when the task ends is laid end to end and cut into whole
sequences and the powers of two of the rest, so nothing is padded.

Defined cases: null or empty text is one end token; a very long text gives many whole sequences; equal documents are
packed each; null ids are passed on; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from voxtable.llm.arrow import coded, slices, text_of, words_of

CAPACITY = 4096
END = 2
#: Words whose ids a Python worker keeps; when full, only those of the batch at hand stay.
CACHED_WORDS = 200_000
#: Words that the tokenizer takes at once.
GROUP = 20_000
BATCH_BYTES = 8_000_000
#: Tokens of a batch that a task gives out.
OUT_TOKENS = 16_000_000
#: Sequence numbers that one task may use.
PER_TASK = 1 << 33


class WordIds:
    """Token ids of white-space separated words, as the tokenizers library gives them.

    Right for tokenizers that split at white space and drop it, so that a text's ids are its words' ids end to end.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, int] = {}
        self.first, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def slots(self, words: list[str]) -> np.ndarray:
        """Where the ids of distinct words lie; words not yet known are encoded, in groups."""
        known = self.known
        missing = [w for w in words if w not in known]
        if len(known) + len(missing) > CACHED_WORDS:
            kept = [w for w in words if w in known]
            old = np.fromiter(map(known.__getitem__, kept), np.int64, len(kept))
            self._hold(self.size[old], gather(self.ids, self.first[old], self.size[old]), fresh=True)
            self.known = known = {w: k for k, w in enumerate(kept)}
        for a in range(0, len(missing), GROUP):
            group = missing[a:a + GROUP]
            if any(mark in w for mark in self.special for w in group):  # their tokens name no word
                ids = [e.ids for e in self.tokenizer.encode_batch_fast(group, add_special_tokens=False)]
                size, ids = np.fromiter(map(len, ids), np.int64, len(ids)), np.array([i for x in ids for i in x], np.uint32)
            else:
                encoded = self.tokenizer.encode(group, is_pretokenized=True, add_special_tokens=False)
                size, ids = np.bincount(np.array(encoded.word_ids, np.int64), minlength=len(group)), np.array(encoded.ids, np.uint32)
            known.update(zip(group, range(len(self.size), len(self.size) + len(group)), strict=True))
            self._hold(size, ids)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def _hold(self, size: np.ndarray, ids: np.ndarray, fresh: bool = False) -> None:
        if fresh:
            self.first, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
        self.size, self.ids = np.concatenate([self.size, size]), np.concatenate([self.ids, ids])

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, each text's closed by END, and where each text begins."""
        words, starts = words_of(texts)
        index, distinct = coded(words)
        slot = self.slots(distinct.to_pylist())
        ids = np.concatenate([self.ids, np.array([END], np.uint32)])
        first, size = np.concatenate([self.first[slot], [len(ids) - 1]]), np.concatenate([self.size[slot], [1]])
        index = np.insert(index, starts[1:], len(slot))
        lengths = size[index]
        return gather(ids, first[index], lengths), np.concatenate([[0], np.cumsum(lengths)])[starts + np.arange(len(starts))]


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One table of words for all tasks of a Python worker."""
    return WordIds(path)


def gather(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[first[0]:first[0] + size[0]], values[first[1]:...], ... end to end."""
    ends = np.cumsum(size)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)]


@dataclass
class Pieces:
    """Pieces of documents: row of the document, start in it, length, and where the ids lie in the task's flat array."""

    row: np.ndarray
    start: np.ndarray
    length: np.ndarray
    first: np.ndarray

    def take(self, at: np.ndarray) -> Pieces:
        return Pieces(self.row[at], self.start[at], self.length[at], self.first[at])

    def part(self, of: np.ndarray, skip: np.ndarray, length: np.ndarray) -> Pieces:
        """Parts of the pieces ``of``: what follows their first ``skip`` tokens."""
        return Pieces(self.row[of], self.start[of] + skip, length, self.first[of] + skip)


def joined(parts: list[Pieces]) -> Pieces:
    return Pieces(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("row", "start", "length", "first")))


def whole(n: np.ndarray, at: np.ndarray, capacity: int) -> tuple[Pieces, Pieces]:
    """Whole sequences of documents of n tokens that begin at ``at``, and what is left of each document."""
    count, row = n // capacity, np.arange(len(n))
    full = np.repeat(row, count)
    skip = (np.arange(len(full)) - np.repeat(np.cumsum(count) - count, count)) * capacity
    every = Pieces(row, np.zeros(len(n), np.int64), n, at)
    rest = n - count * capacity
    some = np.flatnonzero(rest)
    return every.part(full, skip, np.full(len(full), capacity)), every.part(some, (count * capacity)[some], rest[some])


def laid(stream: Pieces, room: np.ndarray) -> tuple[Pieces, np.ndarray, np.ndarray, Pieces]:
    """Lay pieces end to end into rooms, cut at their ends: the parts, the room of each, the offset in it, and what is left over."""
    ends, rooms = np.cumsum(stream.length), np.cumsum(room)
    total = int(rooms[-1]) if len(rooms) else 0
    cuts = np.unique(np.concatenate([ends[ends < total], rooms]))
    begin = np.concatenate([[0], cuts[:-1]])[:len(cuts)]
    of, into = np.searchsorted(ends, begin, "right"), np.searchsorted(rooms, begin, "right")
    parts = stream.part(of, begin - (ends - stream.length)[of], cuts - begin)
    left = np.flatnonzero(ends > total)
    skip = np.maximum(total - (ends - stream.length)[left], 0)
    return parts, into, begin - (rooms - room)[into], stream.part(left, skip, stream.length[left] - skip)


def full_bins(length: np.ndarray, sums: np.ndarray, begins: np.ndarray, fillers: int, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For pieces by rising length, without the first ``fillers``: each class's first piece, k, number of full bins, and all gaps."""
    at = np.maximum(begins[:-1], fillers)
    k = capacity // length[begins[:-1]]
    bins = np.maximum(begins[1:] - at, 0) // k
    return at, k, bins, int((bins * capacity).sum() - (sums[at + bins * k] - sums[at]).sum())


def harmonic(pieces: Pieces, capacity: int = CAPACITY) -> tuple[Pieces, np.ndarray, np.ndarray, Pieces]:
    """Fill all bins that get their number: pieces, bin and offset of each, and what is left over."""
    p = pieces.take(np.argsort(pieces.length, kind="stable"))
    classes = capacity // p.length
    begins = np.concatenate([[0], np.flatnonzero(np.diff(classes)) + 1, [len(classes)]]) if len(classes) else np.zeros(1, np.int64)
    sums = np.concatenate([[0], np.cumsum(p.length)])
    # the fewest of the shortest pieces that fill the gaps of the others' bins
    low, high = 0, len(p.length)
    while low < high:
        mid = (low + high) // 2
        if sums[mid] >= full_bins(p.length, sums, begins, mid, capacity)[3]:
            high = mid
        else:
            low = mid + 1
    at, k, bins, _ = full_bins(p.length, sums, begins, low, capacity)
    taken = np.repeat(at, bins * k) + np.arange((bins * k).sum()) - np.repeat(np.cumsum(bins * k) - bins * k, bins * k)
    into = np.repeat(np.arange(bins.sum()), np.repeat(k, bins))
    first = np.flatnonzero(np.diff(into, prepend=-1))
    used = np.add.reduceat(p.length[taken], first) if len(first) else np.zeros(0, np.int64)
    offset = sums[taken] - sums[taken[first]][into] if len(first) else taken
    parts, gap, inside, left = laid(p.take(np.arange(low)), capacity - used)
    rest = np.ones(len(p.length), bool)
    rest[:low] = False
    rest[taken] = False
    return joined([p.take(taken), parts]), np.concatenate([into, gap]), np.concatenate([offset, used[gap] + inside]), joined([p.take(np.flatnonzero(rest)), left])


OUT = ["start", "length", "doc_tokens", "sequence_id", "offset", "ids"]


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: the id, start, length, doc_tokens, sequence_id, offset, ids (little-endian 32-bit).

    tokenizer: path of a tokenizers file that every executor can read; capacity: a power of two.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, number = word_ids(tokenizer), TaskContext.get().partitionId() * PER_TASK
        none = np.zeros(0, np.int64)
        open_ids, open_n, open_flat, held = None, none, np.zeros(0, np.uint32), Pieces(none, none, none, none)

        def out(p: Pieces, ids: pa.Array, n: np.ndarray, flat: np.ndarray, sequence: np.ndarray, offset: np.ndarray) -> Iterator[pa.RecordBatch]:
            for some in np.split(np.arange(len(p.row)), np.flatnonzero(np.diff(np.cumsum(p.length) // OUT_TOKENS)) + 1):
                if len(some):
                    own = p.take(some)
                    ends = np.concatenate([[0], np.cumsum(4 * own.length)]).astype(np.int32)
                    data = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(ends), pa.py_buffer(gather(flat, own.first, own.length).astype("<u4"))])
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(own.row)), *(pa.array(x.astype(np.int64)) for x in (own.start, own.length, n[own.row], sequence[some], offset[some])), data], ["id", *OUT])

        for batch in slices(batches, "text", BATCH_BYTES):
            flat, at = words.batch(text_of(batch))
            long, rest = whole(np.diff(at), at[:-1], capacity)
            # what was open comes first: its rows and ids are put before those of the batch
            ids = batch["id"] if open_ids is None else pa.concat_arrays([open_ids, batch["id"]])
            n, flat = np.concatenate([open_n, np.diff(at)]), np.concatenate([open_flat, flat])
            for p in (long, rest):
                p.row, p.first = p.row + len(open_n), p.first + len(open_flat)
            yield from out(long, ids, n, flat, number + np.arange(len(long.row)), np.zeros(len(long.row), np.int64))
            number += len(long.row)
            placed, into, offset, held = harmonic(joined([held, rest]), capacity)
            yield from out(placed, ids, n, flat, number + into, offset)
            number += int(into.max(initial=-1)) + 1
            rows, held.row = np.unique(held.row, return_inverse=True)
            open_ids, open_n, open_flat = ids.take(pa.array(rows)), n[rows], gather(flat, held.first, held.length)
            held.first = np.cumsum(held.length) - held.length
        left = int(held.length.sum())
        if left:
            room = np.array([capacity] * (left // capacity) + [1 << b for b in reversed(range(capacity.bit_length())) if (left % capacity) >> b & 1])
            placed, into, offset, _ = laid(held.take(np.argsort(-held.length, kind="stable")), room)
            yield from out(placed, open_ids, open_n, open_flat, number + into, offset)

    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(packed, f"id {kind}, " + ", ".join(f"{c} long" for c in OUT[:-1]) + ", ids binary").withColumnRenamed("id", id_col))
