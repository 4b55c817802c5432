"""Near-duplicate vectors by a robust-pruned flat graph.

Equal vectors of a label form one node. Nodes go to the shards of their OVERLAP nearest centres (a sample of the label's
vectors), so shards overlap. In each shard a graph is built: every node gets neighbours from its nearest and some random
members, pruned robustly, so that no neighbour is much closer to another one than to the node. The adjacency lists of
all shards are united. Then every node searches the united graph, as far as it lies in its shards: greedily from the
medoid with a beam, and where members in range turn up, by expanding all of them until no more come. What is found is
verified in double precision. ``audit`` measures recall against brute force.

A crowded shard is cut into parts of PART members; every part is searched for every node of the shard.

Defined cases: vectors that are null, zero or hold null or non-finite components, and null labels, link with nothing;
vectors of different length never link; repeated rows are links of each other; null ids never name a component unless
all its ids are null; an empty table gives no rows; other columns are not read. Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from voxtable.llm.components import roots
from voxtable.llm.stored import stored

COSINE = 0.98
#: Vectors per centre, and centres altogether at most; they are broadcast.
PER_CENTRE, MAX_CENTRES = 500, 50_000
OVERLAP = 3
#: The widest overlap that a low recall leads to.
MAX_OVERLAP = 48
PART = 2000
DEGREE, NEAREST, RANDOM, ALPHA = 24, 64, 24, 1.2
BEAM = 24
#: The search goes on through members that miss the range by that much.
SLACK = 0.03


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Unit vectors, one row each."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    x = flat.reshape(len(vectors), -1)
    return x / np.sqrt((x * x).sum(1))[:, None]


def pruned(order: np.ndarray, to_node: np.ndarray, among: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[int]:
    """Robust pruning: candidates by distance, each taken one drops those that are alpha times nearer to it than to the node."""
    taken, alive = [], np.ones(len(order), bool)
    for k in range(len(order)):
        if alive[k]:
            taken.append(int(order[k]))
            if len(taken) == degree:
                break
            alive &= alpha * among[k] > to_node
    return taken


def build(x: np.ndarray, seed: int = 0) -> list[list[int]]:
    """Adjacency lists of a robust-pruned graph over the rows of x, arcs both ways."""
    m, random = len(x), np.random.default_rng(seed)
    distance = np.sqrt(np.maximum(2 - 2 * (x @ x.T), 0)).astype(np.float32)
    near = min(NEAREST, m - 1)
    nearest = np.argpartition(distance, near, axis=1)[:, :near + 1] if m > 1 else np.zeros((m, 1), int)
    far = random.integers(0, m, (m, RANDOM))
    lists: list[list[int]] = []
    for p in range(m):
        order = np.unique(np.concatenate([nearest[p], far[p]]))
        order = order[order != p]
        order = order[np.argsort(distance[p, order], kind="stable")]
        lists.append(pruned(order, distance[p, order], distance[np.ix_(order, order)]))
    both: list[set[int]] = [set(q) for q in lists]
    for p, q in enumerate(lists):
        for k in q:
            both[k].add(p)
    out = []
    for p, q in enumerate(both):
        order = np.array(sorted(q), int)
        if len(order) > 2 * DEGREE:
            order = order[np.argsort(distance[p, order], kind="stable")]
            order = np.array(pruned(order, distance[p, order], distance[np.ix_(order, order)], 2 * DEGREE), int)
        out.append(order.tolist())
    return out


def search(query: np.ndarray, x: np.ndarray, links: list[np.ndarray], start: int, cosine: float) -> np.ndarray:
    """Rows of x within the range of query: a beam from the start, then all in range are expanded until no more come.

    A step expands all open members of the beam at once, so a search takes a few array operations.
    """
    seen, open_ = np.zeros(len(x), bool), np.array([start])
    seen[start] = True
    ids, scores, expanded = open_, x[open_] @ query, np.zeros(1, bool)
    while True:
        todo = np.flatnonzero(~expanded & (scores >= cosine - SLACK))
        if not len(todo):
            best = np.arange(len(ids)) if len(ids) <= BEAM else np.argpartition(-scores, BEAM - 1)[:BEAM]
            todo = best[~expanded[best]]
            if not len(todo):
                break
        expanded[todo] = True
        new = np.concatenate([links[k] for k in ids[todo]])
        new = np.unique(new[~seen[new]])
        if len(new):
            seen[new] = True
            ids, scores = np.concatenate([ids, new]), np.concatenate([scores, x[new] @ query])
            expanded = np.concatenate([expanded, np.zeros(len(new), bool)])
    return ids[scores >= cosine]


def nodes_of(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id and node of every row; space (label and length) and vector where the vector can link, else null."""
    v = F.transform(vector_col, lambda c: c.cast("double"))
    sound = (F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & F.exists(v, lambda c: c != 0)
             & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    space = F.concat_ws(":", F.col(label_col).cast("string"), F.size(vector_col))
    good = vectors.select(F.col(id_col).cast("long").alias("id"), F.coalesce(sound, F.lit(False)).alias("sound"), space.alias("space"), v.alias("vector"))
    return good.select("id", *(F.when(F.col("sound"), F.col(c)).alias(c) for c in ("space", "vector"))).withColumn(
        "node", F.when(F.col("space").isNotNull(), F.xxhash64("space", "vector")))


def sharded(nodes: DataFrame, overlap: int) -> DataFrame:
    """(space, centre, node, vector): every node with its nearest centres. The centres are a sample of bounded size."""
    n = nodes.count()
    every = max(PER_CENTRE, -(-n // MAX_CENTRES))
    sample = nodes.where(F.pmod(F.hash("node"), F.lit(every)) == 0).select("space", "vector").limit(2 * MAX_CENTRES).toArrow()
    centres: dict[str, np.ndarray] = {}
    for space in set(sample["space"].to_pylist()):
        centres[space] = _matrix(sample.filter(pc.equal(sample["space"], space))["vector"].combine_chunks())
    shared = nodes.sparkSession.sparkContext.broadcast(centres)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spaces = np.array(batch["space"].to_pylist(), object)
            rows, at = [], []
            for space in set(spaces):
                mine = np.flatnonzero(spaces == space)
                c = shared.value.get(space)
                k = 1 if c is None else min(overlap, len(c))
                for a in range(0, len(mine), 2000):
                    part = mine[a:a + 2000]
                    near = np.zeros((len(part), 1), int) if c is None else np.argsort(-(_matrix(batch["vector"].take(pa.array(part))) @ c.T), axis=1, kind="stable")[:, :k]
                    rows.append(np.repeat(part, k))
                    at.append(near.ravel())
            rows = pa.array(np.concatenate(rows)) if rows else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["space"].take(rows), pa.array(np.concatenate(at) if at else [], pa.int32()), batch["node"].take(rows), batch["vector"].take(rows)],
                                             ["space", "centre", "node", "vector"])

    return nodes.select("space", "node", "vector").mapInArrow(fn, "space string, centre int, node long, vector array<double>")


def _graph(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("node")
    node = rows["node"].to_numpy()
    lists = build(_matrix(rows["vector"].combine_chunks()))
    return pa.table([rows["node"], pa.array([node[q] for q in lists], pa.list_(pa.int64()))], names=["node", "next"])


def _searched(cosine: float):
    def fn(asked: pa.Table, there: pa.Table) -> pa.Table:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if asked.num_rows and there.num_rows:
            there = there.sort_by("node")
            node, x = there["node"].to_numpy(), _matrix(there["vector"].combine_chunks())
            links = []
            for q in there["next"].to_pylist():
                q = np.array(q, np.int64)
                at = np.minimum(np.searchsorted(node, q), len(node) - 1)
                links.append(at[node[at] == q])
            start = int(np.argmax(x @ x.mean(0)))
            for own, query in zip(asked["node"].to_pylist(), _matrix(asked["vector"].combine_chunks()), strict=True):
                found = node[search(query, x, links, start, cosine)]
                found = found[found != own]
                a.append(np.minimum(found, own))
                b.append(np.maximum(found, own))
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
        return pa.table([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return fn


def linked(nodes: DataFrame, cosine: float = COSINE, overlap: int = OVERLAP) -> DataFrame:
    """Distinct pairs (a, b) of nodes of one space with a cosine of at least that, a < b."""
    members = stored(sharded(nodes, overlap), "shards")
    crowded = members.groupBy("space", "centre").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    members = members.join(crowded, ["space", "centre"]).withColumn("part", F.pmod(F.hash("node", F.lit(1)), F.col("parts")))
    lists = members.groupBy("space", "centre", "part").applyInArrow(_graph, "node long, next array<long>")
    united = stored(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("next"))).alias("next")), "graph")
    key = ["space", "centre", "part", "other"]
    there = members.join(united, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*key, "node", "vector", "next")
    asked = (members.withColumnRenamed("part", "other").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select(*(F.col(c).alias(c) for c in (*key, "node", "vector"))))
    return stored(asked.groupBy(*key).cogroup(there.groupBy(*key)).applyInArrow(_searched(cosine), "a long, b long").distinct(), "links")


def audit(nodes: DataFrame, links: DataFrame, cosine: float = COSINE, sample: int = 200) -> float:
    """Share of its true links that was found for a node of a bounded sample, as the mean over the nodes that have
    any, so that a large group does not hide what a small one lost; 1.0 where none has. Every row is compared with
    the sample: half of it from all nodes, half from nodes with links, as most nodes may have none.
    """
    drawn = [F.hash("node", F.lit(2)), "node"]
    tied = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    some = nodes.select("node").orderBy(*drawn).limit(sample // 2).unionByName(tied.orderBy(*drawn).limit(sample - sample // 2)).distinct()
    asked = nodes.join(F.broadcast(some), "node").select("space", "node", "vector").toArrow()
    spaces, ids = np.array(asked["space"].to_pylist(), object), asked["node"].to_numpy()
    queries = {s: (ids[spaces == s], _matrix(asked.filter(pc.equal(asked["space"], s))["vector"].combine_chunks())) for s in set(spaces)}

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, node = np.array(batch["space"].to_pylist(), object), batch["node"].to_numpy()
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for s, (names, q) in queries.items():
                at = np.flatnonzero(own == s)
                for part in np.array_split(at, max(1, len(at) // 2000)):
                    if len(part):
                        row, col = np.nonzero(_matrix(batch["vector"].take(pa.array(part))) @ q.T >= cosine)
                        a.append(node[part[row]])
                        b.append(names[col])
            a, b = np.concatenate(a), np.concatenate(b)
            a, b = a[a != b], b[a != b]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(b)], ["a", "b", "asked"])

    true = stored(nodes.select("space", "node", "vector").mapInArrow(fn, "a long, b long, asked long"), "audit")
    found = true.join(links.withColumn("there", F.lit(1)), ["a", "b"], "left").groupBy("asked").agg((F.count("there") / F.count("*")).alias("share"))
    return found.agg(F.coalesce(F.avg("share"), F.lit(1.0))).first()[0]


def dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE,
          least_recall: float = 0.99) -> DataFrame:
    """One row per row of vectors: the id, n_links, component_id, kept, recall.

    Recall is audited; while it is below least_recall the search is done again with shards that overlap twice as much,
    up to MAX_OVERLAP. ``recall`` is the last audit's share, the same in all rows: it says when the search ended below least_recall.
    """
    rows = stored(nodes_of(vectors, id_col, vector_col, label_col), "vectors")
    nodes = stored(rows.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.min("id").alias("least"), F.count("*").alias("rows"), F.first("space").alias("space"), F.first("vector").alias("vector")), "nodes")
    overlap = OVERLAP
    links = linked(nodes, cosine, overlap)
    while (recall := audit(nodes, links, cosine)) < least_recall and overlap < MAX_OVERLAP:
        overlap *= 2
        links = links.unionByName(linked(nodes, cosine, overlap)).distinct()
    sizes = nodes.select("node", "rows")
    ways = links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to")))).alias("w")).select("w.*")
    counts = ways.join(sizes.withColumnRenamed("node", "to"), "to").groupBy("node").agg(F.sum("rows").alias("others"))
    rooted = (nodes.select("node", "least", "rows").join(counts, "node", "left").join(roots(links), "node", "left")
              .select(F.col("node").alias("own"), "least", (F.coalesce("others", F.lit(0)) + F.col("rows") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")))
    rooted = stored(rooted, "rooted")
    parts = rooted.groupBy("root").agg(F.min("least").alias("component"))
    of_node = stored(rooted.join(parts, "root").select("own", "n_links", "component"), "components")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component"))
    kind = vectors.schema[id_col].dataType
    return rows.join(of_node, F.col("node") == F.col("own"), "left").select(
        F.col("id").cast(kind).alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast(kind).alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"), F.lit(recall).alias("recall"))
