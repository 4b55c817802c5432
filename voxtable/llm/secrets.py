"""Secrets in texts: fixed patterns, and a character convolutional network over every candidate with its surroundings.

The patterns (assign, access, hex) are searched in whole texts. A candidate is any run of LEAST or more token characters; it is
cut into pieces of OWN characters, each seen with BEFORE characters before it and AFTER after it as one window of
character classes, those of the candidate apart from those around it. The network (embedding, one convolution, largest and
mean activation, logistic output) is written in numpy and trained on labelled findings: by default candidates in an assign or
access match are secrets, candidates outside all matches and numbers are not, and letters with digits that only the hex
pattern finds are left open; a table of judged spans may be given instead. Half of the training windows are seen without their
surroundings, so that a candidate's own characters count.

Equal windows fall into one of FOLDS folds by their hash. Fold 0 is not learnt: over all its findings Spark counts scores
by label and form, monotone regression turns scores into probabilities, and each form (digits, letters, mixed) gets the
largest threshold that still finds RECALL of its secrets; forms with few use the threshold of all. Candidates at the
threshold that meet no pattern match become spans of the kind ``net``; pattern matches always stay.

Trained on at most 2 * MAX_TRAIN distinct windows, taken by hash; all else covers all rows. Texts are read row by row with no
shuffle; only the sample, the counts of scores and the thresholds reach the driver.

Defined cases: null or empty text has no spans; null and repeated ids are rows of their own; without findings of either
label nothing is learnt and only pattern matches are given; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from voxtable.llm.arrow import slices, text_of
from voxtable.llm.stored import stored

KINDS = ("assign", "access", "hex", "net")
#: Pattern, the group whose length counts, least length, and a quick test that every text with a match passes.
ASSIGN = (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 12,
          "(?i)password|passwd|secret|token|api_?key")
ACCESS = (re.compile("AKIA[A-Z0-9]+"), 0, 18, "AKIA[A-Z0-9]{14}")
HEX = (re.compile("[0-9a-f]+"), 0, 16, "[0-9a-f]{16}")
LEAST = 12
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-][A-Za-z0-9+/_.-]{10,}[A-Za-z0-9+/_-]={0,2}")
BEFORE, OWN, AFTER = 16, 40, 8
WINDOW = BEFORE + OWN + AFTER
#: Classes of characters around a candidate: 0 nothing, 1 not ASCII, 2-95 printable, 96 space and control; plus INSIDE within it.
INSIDE = 97
CLASSES = np.full(129, 96, np.uint8)
CLASSES[33:127] = np.arange(2, 96)
CLASSES[128] = 1
FORMS = ("digits", "letters", "mixed")
FOLDS = 4
MAX_TRAIN = 4000
RECALL = 0.98
#: A form with fewer secrets in fold 0 has the threshold of all forms.
FEW = 20
BINS = 400
EMBED, FILTERS, WIDTH = 8, 16, 4
EPOCHS, BATCH, RATE = 12, 64, 0.004


def matches(text: str, kind: tuple) -> list[tuple[int, int]]:
    """Leftmost matches one after the other, those that are long enough."""
    pattern, group, least, _ = kind
    return [m.span() for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]


def form(run: str) -> int:
    return 0 if run.isdigit() else 2 if any(c.isdigit() for c in run) else 1


def windows(text: str, spans: list[tuple[int, int]]) -> list[bytes]:
    """For each span, the windows of its pieces end to end."""
    codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)
    codes = np.pad(CLASSES[codes], (BEFORE, WINDOW))
    begins, ends = np.array(spans, np.int64).T
    pieces = -(-(ends - begins) // OWN)
    of = np.repeat(np.arange(len(spans)), pieces)
    starts = begins[of] + OWN * (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    places = starts[:, None] - BEFORE + np.arange(WINDOW)
    seen = codes[places + BEFORE]
    seen = seen + np.where((places >= begins[of][:, None]) & (places < ends[of][:, None]), INSIDE, 0).astype(np.uint8)
    cuts = np.concatenate([[0], np.cumsum(pieces)])
    return [seen[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]


CANDIDATES = "array<struct<start:long,stop:long,form:int,label:int,digest:long>>"
BASE = "array<struct<start:long,kind:int,stop:long>>"


def read(texts: pa.Array) -> tuple[list, list, list]:
    """For each text: its pattern matches, its candidates and their windows."""
    quick = [np.asarray(pc.match_substring_regex(texts, kind[3])) for kind in (ASSIGN, ACCESS, HEX)]
    base, candidates, seen = [], [], []
    for k, text in enumerate(texts.to_pylist()):
        found = [(a, kind, b) for kind, of in enumerate((ASSIGN, ACCESS, HEX)) if quick[kind][k] for a, b in matches(text, of)]
        base.append([{"start": a, "kind": kind, "stop": b} for a, kind, b in sorted(found)])
        runs = [m.span() for m in CANDIDATE.finditer(text)]
        own = windows(text, runs) if runs else []
        rows = []
        for (a, b), window in zip(runs, own, strict=True):
            shape = form(text[a:b])
            kinds = {kind for x, kind, y in found if x < b and a < y}
            label = 1 if kinds & {0, 1} else 0 if not kinds or shape == 0 else None
            rows.append({"start": a, "stop": b, "form": shape, "label": label, "digest": xxhash.xxh3_64_intdigest(window) >> 1})
        candidates.append(rows)
        seen.append(own)
    return base, candidates, seen


def extract(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, base, candidates, windows), one row a document."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64())]))
        runs = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("form", pa.int32()), ("label", pa.int32()), ("digest", pa.int64())]))
        for batch in slices(batches, "text"):
            base, candidates, seen = read(text_of(batch))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(base, spans), pa.array(candidates, runs), pa.array(seen, pa.list_(pa.binary()))],
                                             ["id", "base", "candidates", "windows"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(fn, f"id {kind}, base {BASE}, candidates {CANDIDATES}, windows array<binary>")


@dataclass
class Network:
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    output: np.ndarray
    shift: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.output, self.shift]

    def forward(self, codes: np.ndarray) -> tuple:
        """Logits of windows, and what the way back needs."""
        x = self.embedding[codes]
        size = WINDOW - WIDTH + 1
        columns = np.concatenate([x[:, k:k + size] for k in range(WIDTH)], 2)
        active = np.maximum(columns @ self.filters + self.bias, 0)
        top = active.argmax(1)
        features = np.concatenate([np.take_along_axis(active, top[:, None], 1)[:, 0], active.mean(1)], 1)
        return features @ self.output + self.shift[0], columns, active, top, features

    def logits(self, codes: np.ndarray) -> np.ndarray:
        parts = [self.forward(c)[0] for c in np.array_split(codes, -(-len(codes) // 1024) or 1)]
        return np.concatenate(parts)


def train(codes: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> Network:
    """Logistic loss with both labels weighted alike, Adam steps; every other window of a batch without its surroundings."""
    r = np.random.default_rng(seed)
    kind = np.float32
    net = Network(r.normal(0, 0.3, (2 * INSIDE, EMBED)).astype(kind), r.normal(0, 0.2, (WIDTH * EMBED, FILTERS)).astype(kind), np.zeros(FILTERS, kind),
                  r.normal(0, 0.2, 2 * FILTERS).astype(kind), np.zeros(1, kind))
    mean, square = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()]
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9)).astype(kind)
    step, size = 0, WINDOW - WIDTH + 1
    for _ in range(epochs):
        for rows in np.array_split(r.permutation(len(labels)), -(-len(labels) // BATCH)):
            seen = codes[rows].copy()
            seen[::2] = np.where(seen[::2] < INSIDE, 0, seen[::2])
            z, columns, active, top, features = net.forward(seen)
            g = (weight[rows] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[rows]) / len(rows)).astype(kind)
            back = g[:, None] * net.output
            d_active = np.repeat(back[:, None, FILTERS:] / size, size, 1)
            np.put_along_axis(d_active, top[:, None], np.take_along_axis(d_active, top[:, None], 1) + back[:, None, :FILTERS], 1)
            d_active *= active > 0
            d_columns = d_active @ net.filters.T
            d_embedding = np.zeros_like(net.embedding)
            for k in range(WIDTH):
                np.add.at(d_embedding, seen[:, k:k + size], d_columns[:, :, k * EMBED:(k + 1) * EMBED])
            slopes = [d_embedding, np.tensordot(columns, d_active, ([0, 1], [0, 1])), d_active.sum((0, 1)), features.T @ g, g.sum(keepdims=True)]
            step += 1
            for p, m, s, d in zip(net.parts(), mean, square, slopes, strict=True):
                m += 0.1 * (d - m)
                s += 0.001 * (d * d - s)
                p -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
    return net


def scored(found: DataFrame, net: Network) -> DataFrame:
    """found with logits (one a candidate, the largest of its pieces) instead of windows."""
    shared = found.sparkSession.sparkContext.broadcast(net)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["windows"].to_pylist()
            flat = [w for own in lists for w in own]
            logits = np.zeros(0, np.float32)
            if flat:
                cuts = np.cumsum([0, *(len(w) // WINDOW for w in flat)])
                logits = np.maximum.reduceat(shared.value.logits(np.frombuffer(b"".join(flat), np.uint8).reshape(-1, WINDOW)), cuts[:-1])
            ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["base"], batch["candidates"], pa.ListArray.from_arrays(pa.array(ends), pa.array(logits.astype(float)))],
                                             ["id", "base", "candidates", "logits"])

    kind = found.schema["id"].dataType.simpleString()
    return found.mapInArrow(fn, f"id {kind}, base {BASE}, candidates {CANDIDATES}, logits array<double>")


def labelled(table: DataFrame, other: str, labels: DataFrame | None) -> DataFrame:
    """(form, digest, label, and ``other`` of each candidate that has a label). labels: (id, start, stop, label)."""
    each = table.select("id", F.explode(F.arrays_zip("candidates", other)).alias("c")).select("id", "c.candidates.*", F.col(f"c.{other}").alias("what"))
    if labels is not None:
        judged = labels.select(*(F.col(c).alias(f"judged_{c}") for c in ("id", "start", "stop", "label")))
        meet = (F.col("id") == F.col("judged_id")) & (F.col("start") < F.col("judged_stop")) & (F.col("judged_start") < F.col("stop"))
        each = each.join(judged, meet).withColumn("label", F.col("judged_label").cast("int"))
    return each.where(F.col("label").isNotNull()).select("form", "digest", "label", "what")


def sample(found: DataFrame, labels: DataFrame | None, most: int = MAX_TRAIN) -> tuple[np.ndarray, np.ndarray]:
    """First windows and labels of at most ``most`` distinct findings a label, outside fold 0, by hash."""
    rows = labelled(found, "windows", labels).where(F.col("digest") % FOLDS != 0)
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0)
    parts = []
    for label, n in sorted(counts.items()):
        # Copies fall together below the cut or above it; it is lifted while too few distinct findings lie below.
        share = min(1.0, 4 * most / n)
        while True:
            below = rows.where((F.col("label") == label) & (F.col("digest") < int(share * (1 << 63)) - 1))
            picked = below.groupBy("digest").agg(F.min("what").alias("what")).orderBy("digest").limit(most).collect()
            if len(picked) >= most or share == 1.0:
                break
            share = min(1.0, 8 * share)
        parts.append((label, picked))
    codes = [np.frombuffer(r["what"], np.uint8).reshape(-1, WINDOW)[0] for _, picked in parts for r in picked]
    return np.stack(codes), np.concatenate([np.full(len(picked), float(label)) for label, picked in parts])


def monotone(good: np.ndarray, all_of: np.ndarray) -> np.ndarray:
    """Rising shares by pooling neighbours; bins without rows take the share of their pool."""
    pools: list[list[float]] = []
    for g, n in zip(good, all_of, strict=True):
        pools.append([g, n, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            g2, n2, k2 = pools.pop()
            pools[-1] = [pools[-1][0] + g2, pools[-1][1] + n2, pools[-1][2] + k2]
    return np.concatenate([np.full(int(k), g / n if n else 0.0) for g, n, k in pools])


@dataclass
class Calibration:
    """Probability of each bin of scores, and the least bin that counts as a secret, for each form."""

    probability: np.ndarray
    least: list[int]


def bin_of(logit: Column) -> Column:
    """Bins of a tenth of a unit or finer around zero, the same for every table."""
    return F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((logit + 20) * (BINS / 40)))).cast("int")


def calibrate(table: DataFrame, labels: DataFrame | None, recall: float = RECALL) -> Calibration:
    """From all findings of fold 0; each form's threshold is the largest bin with that recall."""
    rows = labelled(table, "logits", labels).where(F.col("digest") % FOLDS == 0)
    counts = np.zeros((len(FORMS), 2, BINS))
    for r in rows.groupBy("form", "label", bin_of(F.col("what")).alias("bin")).agg(F.count("*").alias("n")).collect():
        counts[r["form"], r["label"], r["bin"]] += r["n"]

    def least(secrets: np.ndarray) -> int:
        reached = np.cumsum(secrets[::-1])[::-1] >= recall * secrets.sum()
        return int(np.flatnonzero(reached)[-1]) if secrets.sum() else BINS

    every = least(counts[:, 1].sum(0))
    return Calibration(monotone(counts[:, 1].sum(0), counts.sum((0, 1))), [least(c[1]) if c[1].sum() >= FEW else every for c in counts])


def count_of(spans: str, kind: str) -> Column:
    """How many of the spans are of that kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def spans_text(spans: Column) -> Column:
    """kind:start:stop of spans by start, then kind, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def find(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """One row a document: id, base and found (spans as structs of start, kind, stop) and the probabilities of found.

    labels: judged spans (id, start, stop, label 0 or 1) that replace the labels by patterns; both overlap candidates of that id.
    """
    kind = docs.schema[id_col].dataType
    found = stored(extract(docs, id_col, text_col), "candidates")
    codes, truth = sample(found, labels)
    if not len(truth):
        nothing = F.array().cast("array<double>")
        return found.select(F.col("id").cast(kind).alias(id_col), "base", F.array().cast(BASE).alias("found"), nothing.alias("probabilities"))
    table = stored(scored(found, train(codes, truth)), "scored")
    by = calibrate(table, labels, recall)
    least = F.array(*(F.lit(b) for b in by.least))
    chance = F.array(*(F.lit(float(p)) for p in by.probability))
    apart = lambda c: ~F.exists("base", lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"]))
    each = F.transform(F.arrays_zip("candidates", "logits"), lambda z: F.struct(
        z["candidates"]["start"].alias("start"), F.lit(KINDS.index("net")).alias("kind"), z["candidates"]["stop"].alias("stop"),
        z["candidates"]["form"].alias("form"), bin_of(z["logits"]).alias("bin")))
    kept = F.filter(each, lambda c: (c["bin"] >= F.get(least, c["form"])) & apart(c))
    return table.select("id", "base", kept.alias("kept")).select(
        F.col("id").cast(kind).alias(id_col), "base", F.transform("kept", lambda c: F.struct(c["start"], c["kind"], c["stop"])).cast(BASE).alias("found"),
        F.transform("kept", lambda c: F.get(chance, c["bin"])).alias("probabilities"))
