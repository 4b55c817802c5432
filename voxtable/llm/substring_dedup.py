"""Removal of word windows that an earlier document already holds.

Every window of WINDOW consecutive words gets a 64-bit Rabin-Karp hash. Map tasks hand each distinct hash of a batch on
once, packed into one row per hash bucket; windows that repeat inside the batch are settled there, so a window of a
third of all documents costs one entry per batch. In a bucket the hashes are counted: all that start in a document
with a smaller id as well are repeated. Only the places of repeated windows go back to their documents, where they are
merged into maximal removal intervals. Texts are shuffled once, for that join.

Two different windows share a hash with a probability of 2^-64 a pair.

Defined cases: null, empty or short texts have no window and stay whole; a null id counts as smaller than all others;
documents of equal id never remove each other's windows; repeated rows give repeated results; an empty table gives no
rows; other columns are not read. Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from voxtable.llm.arrow import BASE, coded, hash64, mixed, powers, prefix_sums, slices, sliding_least, span_hashes, text_of, words_of

WINDOW = 50
#: Words of the runs that place a window in a bucket.
GRAM = 8
#: Bytes of text behind one bucket: about a million windows.
BUCKET_BYTES = 6_000_000
BATCH_BYTES = 5_000_000
#: How a missing id is ordered.
NO_ID = -(1 << 63)

REPLY = "id long, text_key long, bucket int, firsts array<int>, lengths array<int>"


def runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and length of the runs of consecutive numbers in an array."""
    if not len(at):
        return at, at
    cut = np.flatnonzero(np.diff(at) != 1) + 1
    first = np.concatenate([[0], cut])
    return at[first], np.diff(np.concatenate([first, [len(at)]]))


def spread_runs(firsts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers that runs stand for."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(firsts - (ends - lengths), lengths)


def windows(texts: pa.Array, window: int, buckets: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, where each text's words begin, hashes and buckets of all windows, each window's text and first word in it.

    The bucket follows from the least hash of the window's GRAM-word runs, so that neighbours mostly share a bucket and
    a text's replies come from few of them.
    """
    words, starts = words_of(texts)
    index, distinct = coded(words)
    count = np.maximum(np.diff(starts) - window + 1, 0)
    doc = np.repeat(np.arange(len(count)), count)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    lo = starts[doc] + first
    if not len(lo):
        return words, starts, np.zeros(0, np.uint64), np.zeros(0, np.int32), doc, first
    prefix, scale = prefix_sums(hash64(distinct)[index]), powers(BASE, len(words) + 1)
    gram = min(GRAM, window)
    at = np.arange(len(words) - gram + 1)
    least = sliding_least(span_hashes(prefix, at, at + gram, scale), window - gram + 1)[lo]
    return words, starts, span_hashes(prefix, lo, lo + window, scale), bucket_of(mixed(least), buckets), doc, first


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)


def _lists(values: np.ndarray, at: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values, kind))


def _forward(window: int, buckets: int):
    """Map side: rows of bucket, texts (ids and keys) with their number of hashes, hashes, places; or settled windows of a text.

    Places count all windows of the text in the bucket, also the settled ones, which are others in other batches.
    """
    names = ["bucket", "ids", "keys", "counts", "hashes", "firsts", "lengths"]

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            ids = pc.fill_null(batch["id"], NO_ID).to_numpy(zero_copy_only=False)
            keys = batch["text_key"].to_numpy(zero_copy_only=False)
            _, _, hashes, bucket_of_all, doc, first = windows(text_of(batch), window, buckets)
            if not len(hashes):
                continue
            order = np.argsort(hashes, kind="stable")
            head = np.concatenate([[True], np.diff(hashes[order]) != 0])
            group = np.cumsum(head) - 1
            least = np.minimum.reduceat(ids[doc[order]], np.flatnonzero(head))
            settled = np.zeros(len(hashes), bool)
            settled[order] = ids[doc[order]] > least[group]
            # of the rest, which all lie in texts of the least id, one row of each id and text is handed on
            row = np.lexsort([np.arange(len(ids)), keys, ids])
            again = np.zeros(len(ids), bool)
            again[row[1:]] = (np.diff(ids[row]) == 0) & (np.diff(keys[row]) == 0)
            out = []
            own = np.flatnonzero(~again[doc])
            own = own[np.argsort(bucket_of_all[own], kind="stable")]
            bucket = bucket_of_all[own]
            new = np.flatnonzero(np.concatenate([[True], (np.diff(bucket) != 0) | (np.diff(doc[own]) != 0)]))
            place = np.arange(len(own)) - np.repeat(new, np.diff(np.concatenate([new, [len(own)]])))
            left = ~settled[own]
            live, bucket, place = own[left], bucket[left], place[left]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                texts, sizes = runs_of_equal(doc[live[a:b]])
                out.append((int(bucket[a]), ids[texts], keys[texts], sizes, hashes[live[a:b]].tobytes(), *runs(place[a:b])))
            local = np.flatnonzero(settled & ~again[doc])
            texts, sizes = runs_of_equal(doc[local])
            ends = np.cumsum(sizes)
            for t, a, b in zip(texts.tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
                f, n = runs(first[local[a:b]])
                out.append(((int(keys[t]) + int(ids[t])) % buckets, ids[t:t + 1], keys[t:t + 1], None, None, f, n))
            for at in range(0, len(out), 4000):
                cols = list(zip(*out[at:at + 4000], strict=True))
                kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return fn


def runs_of_equal(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value and length of the runs of equal neighbours."""
    if not len(values):
        return values, np.zeros(0, np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(values)) + 1])
    return values[first], np.diff(np.concatenate([first, [len(values)]]))


def _counted(rows: pa.Table) -> pa.Table:
    """One bucket: which hashes start in a text of smaller id too; their places among the text's windows in the bucket."""
    kind = pa.schema([("id", pa.int64()), ("text_key", pa.int64()), ("bucket", pa.int32()), ("firsts", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32()))])
    settled = rows.filter(pc.is_null(rows["hashes"]))
    done = pa.table([pc.list_flatten(settled["ids"]), pc.list_flatten(settled["keys"]), pa.nulls(settled.num_rows, pa.int32()), settled["firsts"], settled["lengths"]], schema=kind)
    rows = rows.filter(pc.is_valid(rows["hashes"]))
    if not rows.num_rows:
        return done
    ids, keys, counts = (pc.list_flatten(rows[c]).to_numpy() for c in ("ids", "keys", "counts"))
    hashes = np.frombuffer(b"".join(rows["hashes"].to_pylist()), np.uint64)
    places = spread_runs(*(pc.list_flatten(rows[c]).to_numpy() for c in ("firsts", "lengths")))
    run = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
    order = np.argsort(hashes)
    head = np.flatnonzero(np.concatenate([[True], np.diff(hashes[order]) != 0]))
    owner = ids[run[order]]
    least = np.repeat(np.minimum.reduceat(owner, head), np.diff(np.concatenate([head, [len(order)]])))
    hit = np.sort(order[owner > least])
    if not len(hit):
        return done
    which, place = run[hit], places[hit]
    # runs of places, broken where the text changes
    cut = np.flatnonzero((np.diff(place) != 1) | (np.diff(which) != 0)) + 1
    at = np.concatenate([[0], cut])
    length = np.diff(np.concatenate([at, [len(hit)]]))
    texts, sizes = runs_of_equal(which[at])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    found = pa.table([pa.array(ids[texts]), pa.array(keys[texts]), pa.array(np.full(len(texts), rows["bucket"][0].as_py(), np.int32)),
                      _lists(place[at].astype(np.int32), offsets, pa.int32()), _lists(length.astype(np.int32), offsets, pa.int32())], schema=kind)
    return pa.concat_tables([done, found])


def _marked(buckets: np.ndarray, replies: list[dict]) -> np.ndarray:
    """Flags of the repeated windows of one text, given each window's bucket."""
    flags = np.zeros(len(buckets), bool)
    by = np.argsort(buckets, kind="stable")
    ordered = buckets[by]
    for r in replies:
        at = spread_runs(np.array(r["firsts"]), np.array(r["lengths"]))
        flags[at if r["bucket"] is None else by[np.searchsorted(ordered, r["bucket"]) + at]] = True
    return flags


def _applied(window: int, buckets: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            words, starts, _, bucket, doc, _ = windows(text_of(batch), window, buckets)
            first = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            replies = batch["replies"]
            edge = np.zeros(len(words) + 1, np.int64)
            for k in np.flatnonzero(np.asarray(pc.is_valid(replies))).tolist():
                flags = _marked(bucket[first[k]:first[k + 1]], replies[k].as_py())
                f, n = runs(np.flatnonzero(flags))
                np.add.at(edge, starts[k] + f, 1)
                np.add.at(edge, starts[k] + f + n + window - 1, -1)
            gone = np.cumsum(edge)[:-1] > 0
            kept = np.concatenate([[0], np.cumsum(~gone)])[starts]
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), words.filter(pa.array(~gone)).cast(pa.string())), " ")
            # maximal intervals, cut at text borders
            step = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
            opens, closes = step == 1, step == -1
            inner = starts[(starts > 0) & (starts < len(words))]
            inner = np.unique(inner[gone[inner - 1] & gone[inner]]) if len(inner) else inner
            a = np.sort(np.concatenate([np.flatnonzero(opens), inner]))
            b = np.sort(np.concatenate([np.flatnonzero(closes), inner]))
            owner = np.searchsorted(starts, a, side="right") - 1
            spans = pa.StructArray.from_arrays([pa.array(a - starts[owner]), pa.array(b - starts[owner])], ["first", "after"])
            at = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
            n = np.diff(starts)
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(n), pa.array(n - np.diff(kept)), pa.ListArray.from_arrays(pa.array(at), spans), text],
                ["id", "n_words", "n_removed", "removed", "kept_text"])

    return fn


def text_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of docs: the id, n_words, n_removed, removed (word intervals), kept_text (words, one space between)."""
    spark = docs.sparkSession
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes(docs, text_col) // BUCKET_BYTES))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    packed = rows.mapInArrow(_forward(window, buckets), "bucket int, ids array<long>, keys array<long>, counts array<int>, hashes binary, firsts array<int>, lengths array<int>")
    replies = (packed.groupBy("bucket").applyInArrow(_counted, REPLY)
               .groupBy(F.col("id").alias("reply_id"), F.col("text_key").alias("reply_key"))
               .agg(F.collect_list(F.struct("bucket", "firsts", "lengths")).alias("replies")))
    joined = rows.join(replies, (F.coalesce("id", F.lit(NO_ID)) == F.col("reply_id")) & (F.col("text_key") == F.col("reply_key")), "left")
    kind = docs.schema[id_col].dataType.simpleString()
    return joined.select("id", "text", "replies").mapInArrow(
        _applied(window, buckets), "id long, n_words long, n_removed long, removed array<struct<first:long,after:long>>, kept_text string"
    ).withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
