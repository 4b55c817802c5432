"""Hard negatives of anchors by exact integer scores, several candidates multiplied at once.

Components become integers, floor(SCALE * x). A block of candidates is biased to non-negative numbers and packed: the same
component of several candidates lies in separate fields of one wide integer, wide enough for the largest sum, so one
multiplication by an anchor's (biased) component serves all of them, and fields never carry into each other. The sums are
unpacked and the biases taken off, which gives the exact inner products. Two fields that fit 53 bits are kept in doubles,
whose products are then exact too; anything larger in Python integers of WIDE fields.

The anchors are stored and go round in groups of at most GROUP_BYTES; each group is broadcast and met with all rows, block
by block inside the tasks, twice: for the positives, then for the negatives below each positive. A task keeps the first
rows an anchor and positive, so what is shuffled does not grow with the rows of a task.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component, take no part; vectors of
different lengths do not meet; components beyond +-LIMIT count as +-LIMIT (scores then fit 64 bits up to 2048 dimensions);
repeated rows are rows of their own, but no row is a partner of an anchor with its id; a positive score below zero allows
no negative; an empty table, or one without anchors, gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from voxtable.llm.stored import stored

SCALE = 256
LIMIT = 1 << 26
GROUP_BYTES = 8 << 20
#: Rows packed together, and anchors that meet them at a time.
BLOCK = 2048
ANCHORS = 512
WIDE = 16


@dataclass
class Packed:
    """words: fields of ``lanes`` rows each; the rows' sums, their count and the number taken off each component."""

    words: np.ndarray
    width: int
    lanes: int
    n: int
    low: int
    sums: np.ndarray


def pack(rows: np.ndarray, most: int) -> Packed:
    """Pack integer rows for products with components of 0 to ``most``."""
    n, d = rows.shape
    low = int(rows.min()) if rows.size else 0
    biased = rows - low
    width = max(1, (d * int(biased.max(initial=0)) * most).bit_length())
    lanes, kind = (53 // width, np.float64) if width <= 26 else (WIDE, object)
    m = -(-n // lanes)
    fields = np.zeros((lanes * m, d), object if kind is object else np.int64)
    fields[:n] = biased
    words = sum(fields[k * m:(k + 1) * m] * (1 << width * k) for k in range(lanes))
    return Packed(words.astype(kind), width, lanes, n, low, rows.sum(1))


def products(packed: Packed, anchors: np.ndarray, low: int) -> np.ndarray:
    """Exact inner products (rows x anchors) of packed rows with anchors that ``low`` was taken off."""
    wide = packed.words @ anchors.T.astype(packed.words.dtype)
    mask = (1 << packed.width) - 1
    if wide.dtype != object:
        wide = wide.astype(np.int64)
    fields = np.concatenate([(wide >> packed.width * k) & mask for k in range(packed.lanes)])[:packed.n]
    return fields.astype(np.int64) + packed.low * anchors.sum(1)[None, :] + low * packed.sums[:, None]


def first(slot: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The first k of each slot by falling score, then id."""
    order = np.lexsort((ids, -score, slot))
    slot, score, ids = slot[order], score[order], ids[order]
    keep = np.arange(len(slot)) - np.searchsorted(slot, slot) < k
    return slot[keep], score[keep], ids[keep]


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, vector) of the rows that take part."""
    broken = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
            .where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).where(~broken))


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and integer vectors, one length at a time."""
    vectors = batch["vector"]
    sizes, ends = np.asarray(vectors.value_lengths()), vectors.offsets.to_numpy()
    values = np.clip(np.floor(vectors.values.to_numpy(zero_copy_only=False) * SCALE), -LIMIT, LIMIT).astype(np.int64)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        for part in np.array_split(at, -(-len(at) // BLOCK)):
            yield part, values[ends[part][:, None] + np.arange(d)]


@dataclass
class Group:
    """Anchors of a group, and for each of its questions (slots) the anchor, the scores allowed and how many to give."""

    ids: np.ndarray
    labels: np.ndarray
    by_length: list  # (places of anchors, their vectors less low, low)
    anchor: np.ndarray
    least: np.ndarray
    most: np.ndarray
    same_label: bool
    count: int


def scan(rows: DataFrame, group: Group) -> DataFrame:
    """(slot, score, id): what each task finds first for every slot of the group."""
    shared = rows.sparkSession.sparkContext.broadcast(group)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        floor = g.least.copy()
        slot = score = ids = np.zeros(0, np.int64)
        turn = np.argsort(g.anchor, kind="stable")
        begins = np.searchsorted(g.anchor[turn], np.arange(len(g.ids) + 1))
        per_anchor = int(np.diff(begins).max(initial=0))
        for batch in batches:
            names, labels = batch["id"].to_numpy(), np.asarray(batch["label"].to_pylist(), object)
            for part, vectors in matrices(batch):
                for places, anchors, low in g.by_length:
                    if anchors.shape[1] != vectors.shape[1]:
                        continue
                    packed = pack(vectors, int(anchors.max(initial=0)))
                    for chunk in np.array_split(np.arange(len(places)), -(-len(places) // ANCHORS)):
                        found = products(packed, anchors[chunk], low)
                        own = places[chunk]
                        same = labels[part][:, None] == g.labels[own][None, :]
                        meet = (same if g.same_label else ~same) & (names[part][:, None] != g.ids[own][None, :])
                        for q in range(per_anchor):
                            asks = begins[own] + q < begins[own + 1]
                            s = np.where(asks, turn[np.minimum(begins[own] + q, len(turn) - 1)], 0)
                            row, col = np.nonzero(meet & asks[None, :] & (found >= floor[s][None, :]) & (found <= g.most[s][None, :]))
                            if len(row):
                                slot, score, ids = first(np.concatenate([slot, s[col]]), np.concatenate([score, found[row, col]]),
                                                         np.concatenate([ids, names[part][row]]), g.count)
                                full = np.flatnonzero(np.bincount(slot, minlength=len(floor)) >= g.count)
                                floor[full] = score[np.searchsorted(slot, full) + g.count - 1]
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(score), pa.array(ids)], ["slot", "score", "id"])

    return rows.mapInArrow(fn, "slot long, score long, id long")


def ranked(found: DataFrame, count: int) -> DataFrame:
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def mine(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
         positives: int = 5, negatives: int = 10, least_percent: int = 30, most_percent: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    is_anchor: which rows are anchors. An anchor's positives are its first rows of the same label; each positive's negatives
    are the first rows of other labels with a score of least_percent to most_percent of the positive's.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col, label_col)
    anchors = stored(usable(vectors.where(is_anchor), id_col, vector_col, label_col), "anchors")
    size = anchors.agg(F.coalesce(F.sum(F.size("vector") * 8 + 24), F.lit(0))).first()[0]
    parts = max(1, -(-size // GROUP_BYTES))
    if parts > 1:
        anchors = stored(anchors.repartition(parts).withColumn("part", F.spark_partition_id()), "anchor_groups")
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    done = spark.createDataFrame([], shape)
    for k in range(parts):
        table = (anchors.where(F.col("part") == k) if parts > 1 else anchors).select("id", "label", "vector").toArrow().combine_chunks()
        if not table.num_rows:
            continue
        batch = table.to_batches()[0]
        ids, labels = batch["id"].to_numpy(), np.asarray(batch["label"].to_pylist(), object)
        by_length = {}
        for at, v in matrices(batch):
            by_length.setdefault(v.shape[1], []).append((at, v))
        lists = []
        for parts_of in by_length.values():
            v = np.concatenate([x for _, x in parts_of])
            low = int(v.min()) if v.size else 0
            lists.append((np.concatenate([a for a, _ in parts_of]), v - low, low))
        wide = np.iinfo(np.int64)
        ask = Group(ids, labels, lists, np.arange(len(ids)), np.full(len(ids), wide.min), np.full(len(ids), wide.max), True, positives)
        chosen = ranked(scan(rows, ask), positives).orderBy("slot", "rank").toArrow()
        anchor, positive, score = (chosen[c].to_numpy() for c in ("slot", "id", "score"))
        # Products with a percentage may pass 64 bits, so the bounds are taken with Python integers.
        least = np.array([-(-least_percent * int(s) // 100) for s in score], np.int64)
        most = np.array([most_percent * int(s) // 100 for s in score], np.int64)
        ask = Group(ids, labels, lists, anchor, least, most, False, negatives)
        found = ranked(scan(rows, ask), negatives)
        asked = spark.createDataFrame(pa.table({"slot": np.arange(len(anchor)), "anchor_id": ids[anchor], "positive_id": positive, "positive_score": score}),
                                      "slot long, anchor_id long, positive_id long, positive_score long")
        out = found.join(F.broadcast(asked), "slot").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                                                            F.col("score").alias("negative_score"))
        done = done.unionByName(stored(out, "negatives") if parts > 1 else out)
    return done
