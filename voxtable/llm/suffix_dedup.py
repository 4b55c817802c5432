"""Removal of byte strings of LENGTH that occur more than once, by a radix sort of suffixes no deeper than LENGTH.

Suffixes are sorted by most significant digits, and only while they tie. The first digit is read where it is the same
for all copies of a string: every LENGTH-byte string holds STEP consecutive places at which a digit of LENGTH - STEP + 1
bytes starts, and the place whose digit has the least hash stands for the string. About two places in STEP are taken.
A place stands for a range of strings that all hold its digit:

* digit unique: none of these strings occurs elsewhere; the place leaves the sort;
* the range's whole span is found again: all its strings are repeated; settled;
* otherwise the range is cut into smaller ones with deeper digits, down to single strings of LENGTH bytes, whose equal
  groups are the repeated strings.

A pass counts equal digits and equal spans. Map tasks hand each on once per batch, so a passage in a third of all
documents costs one entry per batch. Replies name only the places that repeat; a document's replies meet its text in
the next pass. Equality is that of 64-bit Rabin-Karp hashes.

Defined cases: null or empty text has no bytes; texts shorter than LENGTH stay whole; equal rows remove each other's
bytes and give equal results; null ids are as good as others; an empty table gives no rows; other columns are not read.
Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from voxtable.llm.arrow import BASE, mixed, powers, prefix_sums, raw, slices, sliding_least, span_hashes, text_of
from voxtable.llm.stored import stored
from voxtable.llm.substring_dedup import NO_ID, runs_of_equal, text_bytes

LENGTH = 400
#: Strings behind one place after each pass.
STEPS = (200, 25, 1)
#: Bytes of text behind one bucket of a pass.
BUCKET_BYTES = 25_000_000
#: Texts are cut there, with LENGTH - 1 bytes of overlap, to find their places.
SEGMENT = 8_000_000
#: Replies: found again (not the first holder), found again (the first), digit shared by different spans.
AGAIN, FIRST, SHARED = 1, 2, 4

PACKED = "bucket int, ids array<long>, keys array<long>, counts array<int>, codes array<int>, places binary, hashes binary, others binary, flags binary"
REPLY = "id long, text_key long, code int, places array<long>"


class Bytes:
    """The bytes of some texts end to end, ready for span hashes."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at, self.size = data, at, np.diff(at)
        self.prefix = prefix_sums(mixed(data.astype(np.uint64) + np.uint64(1)))
        self.scale = powers(BASE, len(data) + 1)

    def hashes(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return span_hashes(self.prefix, lo, hi, self.scale)

    def places(self, length: int, step: int, segment: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Standing places, each once: text, place in it, first and last start of the strings that they stand for."""
        segment = segment or SEGMENT
        out = []
        for d in np.flatnonzero(self.size >= length) if len(self.data) > 2 * segment else [None]:
            if d is None:
                out.append(self._places(0, len(self.data), length, step, self.at))
            else:
                for a in range(int(self.at[d]), int(self.at[d + 1]) - length + 1, segment):
                    b = min(a + segment + length - 1, int(self.at[d + 1]))
                    doc, place, lo, hi = self._places(a, b, length, step, np.array([a, b]))
                    out.append((doc + d, place + a - self.at[d], lo + a - self.at[d], hi + a - self.at[d]))
        if not out:
            return (np.zeros(0, np.int64),) * 4
        doc, place, lo, hi = map(np.concatenate, zip(*out, strict=True))
        # the last strings of a segment and the first of the next one mostly have the same place
        first = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 0) | (np.diff(doc) != 0)]))[:len(place)]
        last = np.concatenate([first[1:], [len(place)]])[:len(first)] - 1
        return doc[first], place[first], lo[first], hi[last]

    def _places(self, a: int, b: int, length: int, step: int, at: np.ndarray):
        digit = length - step + 1
        if b - a < length:
            return (np.zeros(0, np.int64),) * 4
        j = np.arange(a, b - digit + 1)
        # 40 bits of hash, then the place: ties go to the leftmost
        least = sliding_least((self.hashes(j, j + digit) & ~np.uint64(0xFFFFFF)) | (j - a).astype(np.uint64), step)
        count = np.maximum(np.diff(at) - length + 1, 0)
        doc = np.repeat(np.arange(len(count)), count)
        start = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        place = (least[at[doc] + start - a] & np.uint64(0xFFFFFF)).astype(np.int64) + a - at[doc]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 0) | (np.diff(doc) != 0)]))[:len(place)]
        last = np.concatenate([first[1:], [len(place)]])[:len(first)] - 1
        return doc[first], place[first], start[first], start[last]

    def digits(self, doc: np.ndarray, place: np.ndarray, length: int, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the digits and of the whole spans of places; a span cut by its text's border is told from others."""
        p = self.at[doc] + place
        lo, hi = np.maximum(p - step + 1, self.at[doc]), np.minimum(p + length, self.at[doc + 1])
        span = self.hashes(lo, hi)
        # mixed once more: standing digits have the least hashes, which would all fall into the first buckets
        return mixed(self.hashes(p, p + length - step + 1)), mixed(span ^ ((p - lo) << 32 | (hi - p)).astype(np.uint64))


def _packed(ids: np.ndarray, keys: np.ndarray, doc: np.ndarray, place: np.ndarray, digit: np.ndarray, span: np.ndarray, buckets: int, leaf: bool):
    """Rows of one batch: spans and digits handed on once each, replies that the batch settles itself."""
    names = ["bucket", "ids", "keys", "counts", "codes", "places", "hashes", "others", "flags"]
    kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.binary()] * 4]
    out = []

    def hand_on(at: np.ndarray, hashes: np.ndarray, flags: np.ndarray, others: np.ndarray | None, base: int) -> None:
        bucket = (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)
        by = np.lexsort([at, bucket])
        at, hashes, flags, bucket = at[by], hashes[by], flags[by], bucket[by]
        cut = np.flatnonzero(np.concatenate([[True], np.diff(bucket) != 0, [True]])) if len(bucket) else np.zeros(1, int)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            texts, sizes = runs_of_equal(doc[at[a:b]])
            out.append((base + int(bucket[a]), ids[texts], keys[texts], sizes, None, place[at[a:b]].tobytes(), hashes[a:b].tobytes(),
                        None if others is None else others[by][a:b].tobytes(), flags[a:b].tobytes()))

    def settle(at: np.ndarray, code: int) -> None:
        at = np.sort(at)
        texts, sizes = runs_of_equal(doc[at])
        for a in range(0, len(texts), 500):
            b, begin, end = min(a + 500, len(texts)), sizes[:a].sum(), sizes[:a + 500].sum()
            out.append(((int(keys[texts[a]]) + int(ids[texts[a]])) % buckets, ids[texts[a:b]], keys[texts[a:b]], sizes[a:b], [code] * (b - a), place[at[begin:end]].tobytes(), None, None, None))

    by = np.lexsort([np.arange(len(span)), span])
    new = np.concatenate([[True], np.diff(span[by]) != 0])[:len(by)]
    first = by[new]
    times = np.diff(np.concatenate([np.flatnonzero(new), [len(by)]]))
    settle(by[~new], AGAIN)
    hand_on(first, span[first], (times > 1).astype(np.uint8), None, 0)
    if not leaf:
        d = digit[first]
        by = np.argsort(d, kind="stable")
        new = np.concatenate([[True], np.diff(d[by]) != 0])[:len(by)]
        times = np.diff(np.concatenate([np.flatnonzero(new), [len(by)]]))
        settle(first[by[np.repeat(times > 1, times)]], SHARED)
        one = first[by[new]]
        hand_on(one, digit[one], (times > 1).astype(np.uint8), span[one], buckets)
    for a in range(0, len(out), 2000):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[a:a + 2000], strict=True), kinds, strict=True)], names)


def _reply(ids, keys, counts, codes, places) -> pa.Table:
    at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.table([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(codes, pa.int32()), pa.ListArray.from_arrays(pa.array(at), pa.array(places, pa.int64()))],
                    names=["id", "text_key", "code", "places"])


def _counted(buckets: int):
    """One bucket: replies to the entries whose hash occurs again."""

    def fn(rows: pa.Table) -> pa.Table:
        flat = lambda t, c: pc.list_flatten(t[c]).to_numpy()
        joined = lambda t, c, kind: np.frombuffer(b"".join(t[c].to_pylist()), kind)
        settled = rows.filter(pc.is_null(rows["hashes"]))
        parts = []
        if settled.num_rows:
            parts.append(_reply(flat(settled, "ids"), flat(settled, "keys"), flat(settled, "counts"), flat(settled, "codes"), joined(settled, "places", np.int64)))
        rows = rows.filter(pc.is_valid(rows["hashes"]))
        if rows.num_rows:
            spans = rows["bucket"][0].as_py() < buckets
            ids, keys, counts = flat(rows, "ids"), flat(rows, "keys"), flat(rows, "counts")
            hashes, flags = joined(rows, "hashes", np.uint64), joined(rows, "flags", np.uint8)
            by = np.argsort(hashes, kind="stable")
            head = np.flatnonzero(np.concatenate([[True], np.diff(hashes[by]) != 0]))
            size = np.diff(np.concatenate([head, [len(by)]]))
            told = np.maximum.reduceat(flags[by], head) > 0
            code = np.zeros(len(hashes), np.int32)
            if spans:
                group = np.repeat((size > 1) | told, size)
                code[by[group]] = AGAIN
                code[by[head[(size > 1) | told]]] = FIRST
            else:
                others = joined(rows, "others", np.uint64)[by]
                differ = np.maximum.reduceat(others, head) != np.minimum.reduceat(others, head)
                code[by[np.repeat(told | differ, size)]] = SHARED
                code[flags > 0] = 0  # settled where it came from
            at = np.flatnonzero(code)
            if len(at):
                run = np.repeat(np.arange(len(ids)), counts)[at]
                texts, sizes = runs_of_equal(run * 8 + code[at])
                parts.append(_reply(ids[texts // 8], keys[texts // 8], sizes, texts % 8, joined(rows, "places", np.int64)[at]))
        return pa.concat_tables(parts) if parts else _reply([], [], [], [], [])

    return fn


def _by_code(replies: list[dict] | None) -> dict[int, np.ndarray]:
    found: dict[int, list] = {}
    for r in replies or []:
        found.setdefault(r["code"], []).append(r["places"])
    return {k: np.unique(np.concatenate(v)) for k, v in found.items()}


def open_places(replies: list[dict] | None) -> np.ndarray:
    """Places to cut further: their digit is shared by different spans, and no other holder of their span is cut.

    Equal rows get each other's replies, so a place may be the first holder and another one at once.
    """
    codes = _by_code(replies)
    none = np.zeros(0, np.int64)
    return np.setdiff1d(codes.get(SHARED, none), np.setdiff1d(codes.get(AGAIN, none), codes.get(FIRST, none)))


def cut(place: np.ndarray, step: int, smaller: int) -> np.ndarray:
    """The places, ascending and distinct, that stand for the same strings in ranges of ``smaller``."""
    return np.unique((place[:, None] - np.arange(0, step, smaller)).ravel())


def _first_pass(length: int, step: int, buckets: int, segment: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            b = Bytes(*raw(text_of(batch)))
            doc, place, _, _ = b.places(length, step, segment)
            if len(doc):
                yield from _packed(batch["id"].to_numpy(zero_copy_only=False), batch["text_key"].to_numpy(zero_copy_only=False), doc, place,
                                   *b.digits(doc, place, length, step), buckets, step == 1)

    return fn


def _next_pass(length: int, step: int, smaller: int, buckets: int, first: bool, segment: int):
    """Cuts the open places of each text; after the first pass into what each place stands for only."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            b = Bytes(*raw(text_of(batch)))
            docs, places = [], []
            if first:
                doc, place, lo, hi = b.places(length, step, segment)
                begin = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            for k, replies in enumerate(batch["replies"].to_pylist()):
                found = open_places(replies)
                if not len(found):
                    continue
                new = cut(found, step, smaller)
                if first:
                    own = slice(begin[k], begin[k + 1])
                    at = np.searchsorted(place[own], found)
                    pairs = found[:, None] - np.arange(0, step, smaller)
                    inside = (pairs >= lo[own][at][:, None]) & (pairs - smaller + 1 <= hi[own][at][:, None])
                    new = np.unique(pairs[inside])
                new = new[(new >= 0) & (new + length - smaller + 1 <= b.size[k])]
                docs.append(np.full(len(new), k))
                places.append(new)
            if docs and sum(map(len, docs)):
                doc, place = np.concatenate(docs), np.concatenate(places)
                yield from _packed(batch["id"].to_numpy(zero_copy_only=False), batch["text_key"].to_numpy(zero_copy_only=False), doc, place,
                                   *b.digits(doc, place, length, smaller), buckets, smaller == 1)

    return fn


def _applied(length: int, steps: tuple[int, ...], as_text: bool):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, at = raw(text_of(batch))
            size, edge = np.diff(at), np.zeros(len(data) + 1, np.int32)
            for k, replies in enumerate(batch["replies"].to_pylist()):
                for r in replies or []:
                    if r["code"] != SHARED:
                        p = np.array(r["places"])
                        np.add.at(edge, at[k] + np.maximum(p - steps[r["level"]] + 1, 0), 1)
                        np.add.at(edge, at[k] + np.minimum(p + length, size[k]), -1)
            gone = np.cumsum(edge[:-1]) > 0
            kept = np.concatenate([[0], np.cumsum(~gone)])[at]
            rest = data[~gone].tobytes()
            border = np.zeros(len(data) + 1, bool)
            border[at] = True
            before = np.concatenate([[False], gone[:-1]]) if len(gone) else gone
            opens = np.flatnonzero(gone & (~before | border[:-1]))
            after = np.concatenate([gone[1:], [False]]) if len(gone) else gone
            closes = np.flatnonzero(gone & (~after | border[1:])) + 1
            owner = np.searchsorted(at, opens, side="right") - 1
            spans = pa.StructArray.from_arrays([pa.array(opens - at[owner]), pa.array(closes - at[owner])], ["first", "after"])
            mine = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
            left = [rest[a:b] for a, b in zip(kept[:-1].tolist(), kept[1:].tolist(), strict=True)]
            left = pa.array([x.decode("utf-8", "ignore") for x in left], pa.string()) if as_text else pa.array(left, pa.binary())
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(size), pa.array(size - np.diff(kept)), pa.ListArray.from_arrays(pa.array(mine), spans), left],
                                             ["id", "n_bytes", "n_removed", "removed", "kept"]).append_column("rest", batch["rest"])

    return fn


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, steps: tuple[int, ...] = STEPS,
          keep: list[str] = (), as_text: bool = False, segment: int = SEGMENT) -> DataFrame:
    """One row per row of docs: the id, n_bytes, n_removed, removed (byte intervals), kept_bytes, and the columns of keep.

    The columns of keep are returned as keep_0, keep_1, ... With as_text there is kept_text in place of kept_bytes:
    without what is left of characters that were cut.
    steps: strings behind a place after each pass, falling to 1, each a divisor of the one before, the first <= length.
    segment: bytes of a text in which places are found at once; it does not change the result.
    """
    spark = docs.sparkSession
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes(docs, text_col) // BUCKET_BYTES))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"),
                       F.col(id_col).isNull().alias("no_id"), *(F.col(c).alias(f"keep_{k}") for k, c in enumerate(keep)))

    def counted(packed: DataFrame, level: int) -> DataFrame:
        return stored(packed.groupBy("bucket").applyInArrow(_counted(buckets), REPLY).withColumn("level", F.lit(level)), "replies")

    def met(replies: DataFrame, how: str, *columns: str) -> DataFrame:
        """Texts with their replies."""
        own = replies.groupBy(F.col("id").alias("reply_id"), F.col("text_key").alias("reply_key")).agg(F.collect_list(F.struct("level", "code", "places")).alias("replies"))
        return rows.join(own, (F.col("id") == F.col("reply_id")) & (F.col("text_key") == F.col("reply_key")), how).select("id", "text_key", "text", "replies", *columns)

    found = [counted(rows.select("id", "text_key", "text").mapInArrow(_first_pass(length, steps[0], buckets, segment), PACKED), 0)]
    for level, (step, smaller) in enumerate(zip(steps, steps[1:], strict=False), 1):
        found.append(counted(met(found[-1], "inner").mapInArrow(_next_pass(length, step, smaller, buckets, level == 1, segment), PACKED), level))
    replies = found[0]
    for more in found[1:]:
        replies = replies.unionByName(more)
    extra = [f"keep_{k}" for k in range(len(keep))]
    done = met(replies, "left", "no_id", *extra).select("id", "text", "replies", F.struct("no_id", *extra).alias("rest"))
    applied = done.mapInArrow(_applied(length, steps, as_text), "id long, n_bytes long, n_removed long, removed array<struct<first:long,after:long>>, "
                              f"kept {'string' if as_text else 'binary'}, rest {done.schema['rest'].dataType.simpleString()}")
    return applied.select(F.when(~F.col("rest.no_id"), F.col("id")).cast(docs.schema[id_col].dataType).alias(id_col), "n_bytes", "n_removed", "removed", F.col("kept").alias("kept_text" if as_text else "kept_bytes"),
                          *(F.col(f"rest.keep_{k}").alias(f"keep_{k}") for k in range(len(keep))))



def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, each text without the strings that occur more than once. A null text becomes empty."""
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    found = dedup(docs, id_col, text_col, keep=others, as_text=True, **options)
    named = {id_col: F.col(id_col), text_col: F.col("kept_text")} | {c: F.col(f"keep_{k}") for k, c in enumerate(others)}
    return found.select(*(named[c].alias(c) for c in docs.columns))
