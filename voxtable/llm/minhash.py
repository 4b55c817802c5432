"""Near duplicates by MinHash bands and sequential Bayesian verification.

A text's set holds its distinct SHINGLE-word shingles, as 64-bit hashes. Texts of equal sets form one class; only
classes are compared. Classes that agree on a band of ROWS MinHash values are candidates. They are not paired within a
band's group: every group first tests its members against one leader, which makes most groups one component. Groups
that stay in several are cut into blocks; tasks compare and verify two blocks at a time and give a spanning set of links.

A candidate pair's signatures are compared in batches of BATCH values. After each batch the similarity has a beta
posterior (uniform prior); the pair is dropped when similarity >= the threshold is less likely than MISS. Pairs that
survive are verified on their full sets.

A pair at the threshold has no common band with a probability of (1 - t^ROWS)^BANDS, 8e-7 at 0.85, and is pruned with
one of MISS; components are linked by many pairs as a rule.

Defined cases: null, empty or wordless texts have an empty set and are linked with nothing; texts of fewer words are
one shingle; null ids form classes like others, their component is the least id, null if there is none; repeated rows
are in one class; an empty table gives no rows; other columns are not read. Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from voxtable.llm.arrow import BASE, mixed, powers, prefix_sums, slices, span_hashes, text_of, word_hashes
from voxtable.llm.components import roots
from voxtable.llm.stored import stored

SHINGLE = 5
PERCENT = 85
BANDS, ROWS = 24, 5
BATCH = 24
MISS = 1e-5
#: Members of a block of an unsettled group, and bytes of their sets.
BLOCK = 2000
BLOCK_BYTES = 8 << 20
#: Sets that are verified together.
VERIFY = 64

_random = np.random.default_rng(20)
FACTORS = _random.integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending within it, and where each text's begin."""
    words, starts = word_hashes(pc.ascii_lower(texts))
    n = np.diff(starts)
    prefix, scale = prefix_sums(words), powers(BASE, len(words) + 1)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(n)), count)
    lo = starts[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    length = np.minimum(n, size)[doc]
    hashes = mixed(span_hashes(prefix, lo, lo + length, scale) + length.astype(np.uint64)) if len(lo) else np.zeros(0, np.uint64)
    by = np.lexsort([hashes, doc])
    hashes, doc = hashes[by], doc[by]
    new = np.concatenate([[True], (np.diff(hashes) != 0) | (np.diff(doc) != 0)])[:len(doc)]
    return hashes[new], np.searchsorted(doc[new], np.arange(len(n) + 1))


def signatures(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Least permuted hash of each non-empty set under each of the permutations: (values, sets)."""
    out = np.empty((len(FACTORS), len(starts) - 1), np.uint64)
    buffer = np.empty_like(hashes)
    for k, (a, b) in enumerate(zip(FACTORS, TERMS, strict=True)):
        np.multiply(hashes, a, out=buffer)
        np.add(buffer, b, out=buffer)
        out[k] = np.minimum.reduceat(buffer, starts[:-1])
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        passed = [c for c in batch.schema.names if c != "text"]
        hashes, starts = shingle_sets(text_of(batch))
        n = np.diff(starts)
        full = np.flatnonzero(n > 0)
        node, sketches, bands = pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.binary()), pa.nulls(len(n), pa.list_(pa.int64()))
        if len(full):
            begin = np.concatenate([starts[full], starts[-1:]])
            node = pa.array(node_ids(hashes, starts), mask=n == 0)
            values = signatures(hashes, begin)
            short = (mixed(values) >> np.uint64(48)).astype("<u2").T.copy()
            sketch = np.full(len(n), None, object)
            sketch[full] = [row.tobytes() for row in short]
            keys = np.empty((len(full), BANDS), np.uint64)
            for k in range(BANDS):
                key = np.full(len(full), k + 1, np.uint64)
                for value in values[k * ROWS:(k + 1) * ROWS]:
                    key = mixed(key * BASE + value)
                keys[:, k] = key
            at = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
            sketches = pa.array(sketch, pa.binary())
            bands = pa.ListArray.from_arrays(pa.array(at), pa.array(keys.view(np.int64).ravel()))
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in passed), pa.array(n), node, sketches, bands], [*passed, "n", "node", "sketch", "bands"])


def node_ids(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit id for each set, equal for equal sets; 0 for the empty set."""
    n, out = np.diff(starts), np.zeros(len(starts) - 1, np.uint64)
    full = np.flatnonzero(n > 0)
    if len(full):
        out[full] = mixed(np.add.reduceat(mixed(hashes), starts[full]) + n[full].astype(np.uint64))
    return out.view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        hashes, starts = shingle_sets(text_of(batch))
        right = pa.array(node_ids(hashes, starts) == batch["node"].to_numpy(zero_copy_only=False))  # an id may have several texts
        yield pa.RecordBatch.from_arrays([batch["node"], pa.array([hashes[a:b].tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)], pa.binary())],
                                         ["node", "shingles"]).filter(right)


def least_matches(compared: int, threshold: float, miss: float) -> int:
    """Fewest matches of ``compared`` values with which similarity >= threshold keeps a posterior probability of miss.

    The posterior after m matches is Beta(m + 1, compared - m + 1); its tail is a binomial sum.
    """
    total = 0.0
    for m in range(compared + 1):
        total += comb(compared + 1, m) * threshold ** m * (1 - threshold) ** (compared + 1 - m)
        if total >= miss:
            return m
    return compared


def _pruned(threshold: float, miss: float):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = [least_matches(k, threshold, miss) for k in range(BATCH, BANDS * ROWS + 1, BATCH)]
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), "<u2").reshape(batch.num_rows, -1) for c in ("sketch_a", "sketch_b"))
            alive, same = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for k, need in enumerate(least):
                part = slice(k * BATCH, (k + 1) * BATCH)
                same[alive] += (a[alive, part] == b[alive, part]).sum(1)
                alive = alive[same[alive] >= need]
            yield batch.select(["a", "b"]).take(pa.array(alive))

    return fn


def _verified(percent: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch["set_a"].to_pylist(), batch["set_b"].to_pylist(), strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                both = int((both[1:] == both[:-1]).sum())
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return fn


def with_sides(pairs: DataFrame, table: DataFrame, column: str, prefix: str) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(table.select(F.col("node").alias(side), F.col(column).alias(f"{prefix}_{side}")), side)
    return pairs.select("a", "b", f"{prefix}_a", f"{prefix}_b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of the pairs (a, b), those whose full sets are similar enough."""
    return stored(with_sides(stored(pairs, "survivors"), sets, "shingles", "set").mapInArrow(_verified(percent), "a long, b long"), "links")


def similar(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """Of the pairs (a, b), those that are similar enough: pruned on sketches, verified on sets."""
    return verified(with_sides(pairs, classes, "sketch", "sketch").mapInArrow(_pruned(percent / 100, miss), "a long, b long"), sets, percent)


def grouped(classes: DataFrame) -> DataFrame:
    """(band, node, n, root) of the bands that several classes share; every class is its own root yet."""
    every = classes.select("node", "n", F.explode("bands").alias("band"))
    shared = every.groupBy("band").agg(F.count("*").alias("members")).where("members > 1").select("band")
    return stored(every.join(shared, "band").withColumn("root", F.col("node")), "members")


def tests(leaders: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of leaders and members of one band, of different roots and of sizes that can be similar."""
    ahead = leaders.select("band", F.col("node").alias("leader"), F.col("n").alias("leader_n"), F.col("root").alias("leader_root"))
    sized = 100 * F.least("n", "leader_n") >= percent * F.greatest("n", "leader_n")
    return (members.join(ahead, "band").where((F.col("root") != F.col("leader_root")) & sized)
            .select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct())


def _linked(percent: int, miss: float):
    """One pair of blocks of a band: links that hold together all that is similar in them, at most one less than their members.

    A pair is looked at in the first band it shares, while its two sides still have different roots.
    """

    def fn(rows: pa.Table) -> pa.Table:
        least = [least_matches(k, percent / 100, miss) for k in range(BATCH, BANDS * ROWS + 1, BATCH)]
        node, n, root, part = (rows[c].to_numpy() for c in ("node", "n", "root", "part"))
        sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), "<u2").reshape(len(node), -1)
        bands = rows["bands"].combine_chunks().flatten().to_numpy().reshape(len(node), BANDS)
        earlier = int(np.flatnonzero(bands[0] == rows["band"][0].as_py())[0])
        hashes = np.frombuffer(b"".join(rows["shingles"].to_pylist()), np.uint64)
        ends = np.cumsum(n)
        codes = np.unique(hashes, return_inverse=True)[1]
        has = np.zeros(len(hashes), np.int64)
        label = np.unique(root, return_inverse=True)[1]
        one = rows["i"][0].as_py() == rows["j"][0].as_py()
        side = part == rows["j"][0].as_py()
        links = []
        for k in np.arange(len(node)) if one else np.flatnonzero(~side):
            alive = np.flatnonzero((node > node[k] if one else side) & (label != label[k]) & (100 * np.minimum(n, n[k]) >= percent * np.maximum(n, n[k])))
            alive = alive[~(bands[alive, :earlier] == bands[k, :earlier]).any(1)]
            same = np.zeros(len(alive), np.int64)
            for step, need in enumerate(least):
                columns = slice(step * BATCH, (step + 1) * BATCH)
                same += (sketch[alive, columns] == sketch[k, columns]).sum(1)
                alive, same = alive[same >= need], same[same >= need]
            own = codes[ends[k] - n[k]:ends[k]]
            has[own] = 1
            alive = alive[np.argsort(-same, kind="stable")]
            for a in range(0, len(alive), VERIFY):
                some = alive[a:a + VERIFY]
                some = some[label[some] != label[k]]
                if len(some):
                    upto = np.cumsum(n[some])
                    places = np.arange(upto[-1]) + np.repeat(ends[some] - upto, n[some])
                    both = np.add.reduceat(has[codes[places]], upto - n[some])
                    for other in some[100 * both >= percent * (n[some] + n[k] - both)]:
                        if label[other] != label[k]:
                            links.append((min(node[k], node[other]), max(node[k], node[other])))
                            label[label == label[other]] = label[k]
            has[own] = 0
        found = np.array(links, np.int64).reshape(-1, 2)
        return pa.table([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    return fn


def alike(members: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, miss: float = MISS) -> DataFrame:
    """Links (a, b) that join the roots of members which a band has together and whose full sets are similar enough.

    Bands are cut into blocks of about BLOCK members and BLOCK_BYTES of sets; a task takes two blocks with their sets, so
    the links that come out grow with the members, not with their pairs.
    """
    many = F.greatest(F.count("*") / BLOCK, F.sum("n") * 8 / BLOCK_BYTES)
    blocks = members.groupBy("band").agg(F.ceil(many).cast("int").alias("blocks"))
    placed = members.join(blocks, "band").withColumn("part", F.pmod(F.hash("node"), F.col("blocks")))
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = (other.select("band", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "n", "root")
             .join(classes.select("node", "sketch", "bands"), "node").join(sets, "node"))
    return dealt.groupBy("band", "i", "j").applyInArrow(_linked(percent, miss), "a long, b long").distinct()


def unsettled(members: DataFrame, label: DataFrame) -> DataFrame:
    """What is left of the bands whose members still have several roots, with the present roots."""
    rooted = members.select("band", "node", "n").join(label, "node", "left").select("band", "node", "n", F.coalesce("root", "node").alias("root"))
    several = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band")
    return stored(rooted.join(several, "band"), "members")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: the id, n_shingles, component_id, kept."""
    features, of_node = _parts(docs, id_col, text_col, percent)
    done = features.join(of_node, features["node"] == of_node["own"], "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component"))
    kind = docs.schema[id_col].dataType
    return done.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), component.cast(kind).alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _parts(docs: DataFrame, id_col: str, text_col: str, percent: int, **keys: Column) -> tuple[DataFrame, DataFrame]:
    """The features of each row, with long columns keys of docs; root and least id (component) of each class (own)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *(c.alias(k) for k, c in keys.items()))
    features = stored(read.mapInArrow(_features, "id long, " + "".join(f"{k} long, " for k in keys) + "n long, node long, sketch binary, bands array<long>"), "features")
    full = features.where(F.col("node").isNotNull())
    least = full.groupBy("node").agg(F.min("id").alias("least"), F.max("n").alias("n"))
    # one row of each class; a class without any id is found by its null
    classes = stored(full.join(least.select(F.col("node").alias("own"), "least"), (F.col("node") == F.col("own")) & F.col("id").eqNullSafe(F.col("least")))
                     .select("node", "least", "n", "sketch", "bands").dropDuplicates(["node"]), "classes")
    members = grouped(classes)
    needed = members.select("node").distinct().join(classes.select("node", "least"), "node")
    sets = stored(rows.join(needed, F.col("id").eqNullSafe(F.col("least"))).select("node", "text").mapInArrow(_sets, "node long, shingles binary")
                  .dropDuplicates(["node"]), "sets")
    leaders = stored(members.groupBy("band").agg(F.min(F.struct("node", "n", "root")).alias("m")).select("band", "m.*"), "leaders")
    links = similar(tests(leaders, members, percent), classes, sets, percent)
    label = roots(links)
    members = unsettled(members.join(leaders.select("band", "node"), ["band", "node"], "left_anti"), label)
    if not members.isEmpty():
        links = links.unionByName(stored(alike(members, classes, sets, percent), "more_links"))
        label = roots(links)
    nodes = stored(classes.select("node", "least").join(label, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "rooted")
    parts = nodes.groupBy("root").agg(F.min("least").alias("component"))
    return features, stored(nodes.join(parts, "root").select(F.col("node").alias("own"), "root", "component"), "components")


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, that are kept: one of each component and, of rows without words, one of each id and text.

    A component's row is that of its least id; of several texts of that id, or where all ids are null, of the least text
    digest. Rows are found again by id and text digest.
    """
    features, of_node = _parts(docs, id_col, text_col, percent, text_key=F.xxhash64(text_col))
    rows = features.join(of_node, features["node"] == of_node["own"], "left").groupBy("root", "id", "text_key").agg(F.count("*").alias("kept_rows"))
    alone = F.col("root").isNull()
    kept = (rows.groupBy("root", F.when(alone, F.col("id")).alias("own_id"), F.when(alone, F.col("text_key")).alias("own_key"))
            .agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("kept_id"), F.col("text_key").alias("kept_key"), "kept_rows")).alias("m")).select("m.*"))
    kept = stored(kept, "kept")
    same = docs[id_col].cast("long").eqNullSafe(kept["kept_id"]) & (F.xxhash64(docs[text_col]) == kept["kept_key"])
    left = docs.join(kept, same, "left_semi")
    return left if kept.where("kept_rows > 1").isEmpty() else left.dropDuplicates([id_col, text_col])
