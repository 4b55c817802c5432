"""Helpers on slices of batches."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tests.llm import brute
from voxtable.llm import arrow, minhash

TEXTS = ["Ab cd", None, "", "É ß  x\ty\n", "one two three four five six", "x" * 50, "ab ab ab"] * 20


def test_slices_hold_every_row_once():
    batch = pa.RecordBatch.from_arrays([pa.array(TEXTS)], ["text"])
    parts = list(arrow.slices([batch.slice(0, 0), batch], "text", 40))
    assert len(parts) > 20 and [t for p in parts for t in p["text"].to_pylist()] == TEXTS


def test_texts_of_slices_can_be_lowered_and_split():
    batch = pa.RecordBatch.from_arrays([pa.array(TEXTS)], ["text"])
    for part in arrow.slices([batch], "text", 60):
        texts, plain = arrow.text_of(part), [t or "" for t in part["text"].to_pylist()]
        lower = pc.ascii_lower(texts)
        lower.validate(full=True)
        assert texts.to_pylist() == plain
        words, starts = arrow.words_of(texts)
        assert [words.to_pylist()[a:b] for a, b in zip(starts, starts[1:], strict=False)] == [brute.words(t) for t in plain]
        hashes, at = minhash.shingle_sets(texts)
        assert np.diff(at).tolist() == [len(brute.shingles(t)) for t in plain] and len(hashes) == at[-1]


def test_sliding_least():
    r = np.random.default_rng(1).integers(0, 99, 57).astype(np.uint64)
    for width in (1, 2, 9, 57):
        assert arrow.sliding_least(r, width).tolist() == [min(r[i:i + width]) for i in range(57 - width + 1)]


def test_span_hashes_depend_on_content_only():
    x = np.array([5, 6, 7, 1, 5, 6, 7, 6], np.uint64)
    p, s = arrow.prefix_sums(x), arrow.powers(arrow.BASE, 9)
    a, b, c = arrow.span_hashes(p, np.array([0, 4, 5]), np.array([3, 7, 8]), s)
    assert a == b != c
