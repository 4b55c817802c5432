"""Hidden Markov model over sentence symbols: 3 states, 5 symbols.

Training passes over a stored table of symbol arrays; a pass returns 28 sums, whatever the
corpus size. Decoding is a fold inside the JVM.
"""

from __future__ import annotations

import math
import sys
from typing import NamedTuple

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from voxtable.functions import lexicons as lex, text
from voxtable.operators import sentiment as se
from voxtable.sources.scratch import literal_table, materialize

# The functions of a training pass go to the tasks as they are: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

N_STATES, N_SYMBOLS = 3, 5


class HmmModel(NamedTuple):
    start: list
    trans: list
    emit: list
    converged: bool = False
    iterations: int = 0
    history: tuple = ()
    stopped_by: str = ""  # "tolerance" or "passes"


# Start of the training: the states already lean the way they are named.
START = HmmModel(
    [1 / 3, 1 / 3, 1 / 3],
    [[0.6, 0.2, 0.2], [0.2, 0.6, 0.2], [0.2, 0.2, 0.6]],
    [[0.05, 0.10, 0.20, 0.30, 0.35], [0.35, 0.30, 0.20, 0.10, 0.05], [0.10, 0.20, 0.40, 0.20, 0.10]],
)


def eligible(observed: DataFrame, symbols: str = "symbols") -> DataFrame:
    return observed.where(F.size(symbols) >= 2)


#: Symbols of a segment, and positions that are handled together. A step is done for all segments at once, so short ones
#: make few steps of many segments.
SEGMENT, POSITIONS = 128, 1 << 20
#: Positions of a stored group, which knows each of its kinds of blocks once.
GROUP = 1 << 22
#: Symbols that are one step: blocks of that many symbols, numbered in base DIGITS, have one matrix each. A digit is 0 where the
#: sequence has ended, 1 + symbol before a transition, 1 + N_SYMBOLS + symbol at the end.
BLOCK, DIGITS = 8, 2 * N_SYMBOLS + 1
QUADS = DIGITS ** (BLOCK // 2)


def _packed(flat, lengths):
    """Block numbers of sequences that lie one after the other: (distinct ones, place of each block among them, blocks of each sequence)."""
    import numpy as np

    blocks = -(-lengths // BLOCK)
    own = np.repeat((np.cumsum(blocks) - blocks) * BLOCK - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(flat))
    digits = np.zeros(int(blocks.sum()) * BLOCK, np.int32)
    digits[own] = flat + 1
    digits[own[np.cumsum(lengths)[lengths > 0] - 1]] += N_SYMBOLS
    numbers = digits.reshape(-1, BLOCK) @ (DIGITS ** np.arange(BLOCK, dtype=np.int32))
    kinds, places = np.unique(numbers, return_inverse=True)
    return kinds.astype(np.int32), places.astype(np.int32), blocks.astype(np.int32)


def _times(left, right):
    """Products of matrices that lie as (3, 3, n), their logarithmic sizes and the factors that bring each to a sum of 1."""
    import numpy as np

    (x, lx), (y, ly) = left, right
    z = x[:, 0, None] * y[None, 0]
    for k in (1, 2):
        z += x[:, k, None] * y[None, k]
    size = z.sum(axis=(0, 1))
    factor = np.divide(1.0, size, out=np.zeros_like(size), where=size > 0)  # impossible blocks stay 0
    z *= factor
    return (z, lx + ly + np.log(size)), factor


def _matrices(kinds, a, b):
    """For one symbol, two, four and the given blocks: scaled products of the step matrices, and the factors of the products."""
    import numpy as np

    one = np.zeros((N_STATES, N_STATES, DIGITS))
    one[..., 0] = np.eye(N_STATES)
    one[..., 1:1 + N_SYMBOLS] = b[:, None, :] * a[:, :, None]
    one[range(N_STATES), range(N_STATES), 1 + N_SYMBOLS:] = b
    levels, factors, level = [], [], (one, np.zeros(DIGITS))
    for numbers in (np.arange(DIGITS ** 2), np.arange(QUADS), kinds):
        levels.append(level)
        low, high = _halves(numbers, len(level[1]))
        level, factor = _times([m[..., low] for m in level], [m[..., high] for m in level])
        factors.append((factor, low, high))
    return level, levels, factors


def _halves(numbers, n):
    return numbers % n, numbers // n


def _cut(lengths):
    """The segments of sequences that lie one after the other, all in blocks: (sequence, number in it, start, length) of each."""
    import numpy as np

    most = SEGMENT // BLOCK
    counts = -(-lengths // most)
    owner = np.repeat(np.arange(len(lengths)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.repeat(np.cumsum(lengths) - lengths, counts) + number * most
    return owner, number, starts, np.minimum(most, lengths[owner] - number * most)


def _borders(places, counts, starts, lengths, pi, matrix):
    """For each segment: predicted states before it, and backward vector after it, as (3, segments).

    The scaled product of a segment's matrices stands for the whole segment. Products are
    associative, so the segments of all sequences advance together and one 3 x 3 matrix each is combined in order.
    """
    import numpy as np

    before, after = np.repeat(pi[:, None], len(starts), axis=1), np.ones((N_STATES, len(starts)))
    longest = np.argsort(-counts, kind="stable")[:int((counts > 1).sum())]
    if not len(longest):
        return before, after
    heads, counts = (np.cumsum(counts) - counts)[longest], counts[longest]
    cut = np.repeat(heads, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    cut = cut[np.argsort(-lengths[cut], kind="stable")]
    product, at = matrix[..., places[starts[cut]]], np.empty(len(starts), np.int64)
    at[cut] = np.arange(len(cut))
    for t in range(1, int(lengths[cut[0]])):
        m, none = int((lengths[cut] > t).sum()), np.zeros(1)
        product[..., :m] = _times((product[..., :m], none), (matrix[..., places[starts[cut[:m]] + t]], none))[0][0]
    for i in range(1, int(counts[0])):
        own = heads[:int((counts > i).sum())] + i
        v = (before[:, None, own - 1] * product[..., at[own - 1]]).sum(axis=0)
        before[:, own] = v / v.sum(axis=0)
    for i in range(int(counts[0]) - 1, 0, -1):
        own = heads[:int((counts > i).sum())] + i
        u = (product[..., at[own]] * after[None, :, own]).sum(axis=1)
        after[:, own - 1] = u / u.sum(axis=0)
    return before, after


def _segment_sums(total, places, starts, lengths, weight, first, before, after, matrix, sizes):
    """Expected pairs of state before and state after each kind of block, from segments, longest first: scaled forward-backward
    between the vectors at their borders. Adds to ``total`` what hangs on the sequences' first states and the likelihood."""
    import numpy as np

    active = [int((lengths > t).sum()) for t in range(int(lengths[0]))]  # segments still running at t
    own = [places[starts[:m] + t] for t, m in enumerate(active)]
    steps, alpha, scale = [matrix[..., kind] for kind in own], [before], []
    for m, kind, step in zip(active, own, steps):
        last = alpha[-1]
        raw = last[0, :m] * step[0] + last[1, :m] * step[1] + last[2, :m] * step[2]
        scale.append(raw[0] + raw[1] + raw[2])
        alpha.append(raw / scale[-1])
        total[27] += weight[:m] @ (np.log(scale[-1]) + sizes[kind])
    beta, pairs = np.empty((N_STATES, 0)), []
    for t in range(len(active) - 1, -1, -1):
        m, n = active[t], beta.shape[1]
        ends = after[:, n:m] / (alpha[t + 1][:, n:m] * after[:, n:m]).sum(axis=0)
        beta = np.concatenate([beta, ends], axis=1)
        shared = alpha[t][:, :m] * (weight[:m] / scale[t])
        pairs.append((shared[:, None] * beta[None]).reshape(N_STATES * N_STATES, m))
        step = steps.pop()
        beta = (step[:, 0] * beta[0] + step[:, 1] * beta[1] + step[:, 2] * beta[2]) / scale[t]
    total[0:3] += (alpha[0] * beta * weight)[:, first].sum(axis=1)
    total[28] += weight[first].sum()
    kinds, pairs = np.concatenate(own[::-1]), np.concatenate(pairs, axis=1)
    return np.array([np.bincount(kinds, p, len(sizes)) for p in pairs]).reshape(N_STATES, N_STATES, -1)


def _packed_sums(total, kinds, places, blocks, weights, pi, a, b):
    """Adds the sums of packed sequences (``_packed``), each standing for ``weights`` of them.

    Forward and backward vectors step from block to block; what happens inside a block hangs only on its kind and on the expected
    states at its borders, so it is worked out once a kind: halves of blocks, then pairs, then symbols.
    """
    import numpy as np

    with np.errstate(divide="ignore", invalid="ignore"):  # a sequence that the model cannot make
        (matrix, sizes), levels, factors = _matrices(kinds, a, b)
        owner, number, starts, lengths = _cut(blocks)
        before, after = _borders(places, np.bincount(owner, minlength=len(blocks)), starts, lengths, pi, matrix)
        weight, first = np.asarray(weights, float)[owner], number == 0
        order = np.argsort(-lengths, kind="stable")
        expected, at = 0.0, 0
        while at < len(order):
            group = order[at:at + max(1, POSITIONS // (BLOCK * int(lengths[order[at]])))]
            at += len(group)
            expected = expected + _segment_sums(total, places, starts[group], lengths[group], weight[group], first[group],
                                                before[:, group], after[:, group], matrix, sizes)
        for (parts, _), (factor, low, high) in zip(levels[::-1], factors[::-1]):
            expected = expected * factor
            left = sum(expected[:, None, j] * parts[:, j][None][..., high] for j in range(N_STATES))
            right = sum(parts[i][:, None][..., low] * expected[i][None] for i in range(N_STATES))
            halves = [[np.bincount(low, x, parts.shape[2]) + np.bincount(high, y, parts.shape[2]) for x, y in zip(*rows)] for rows in zip(left, right)]
            expected = np.array(halves)
        moves = expected[..., 1:1 + N_SYMBOLS] * b[:, None, :] * a[:, :, None]
        total[3:12] += moves.sum(axis=2).ravel()
        last = expected[range(N_STATES), range(N_STATES), 1 + N_SYMBOLS:] * b
        total[12:27] += (moves.sum(axis=1) + last).ravel()


def _expected_counts(start, trans, emit):
    """Task function: scaled forward-backward over batches of symbol arrays, each standing for n sequences.

    Sequences are packed and cut into segments, and the segments of many sequences are handled together, so the memory
    is that of the symbols and of one group.
    """
    def run(batches):
        import numpy as np
        import pandas as pd

        total = np.zeros(29)

        def add(sequences, weights):
            flat, lengths = np.concatenate(sequences).astype(np.int32), np.array([len(s) for s in sequences])
            _packed_sums(total, *_packed(flat, lengths), weights, np.array(start), np.array(trans), np.array(emit))

        for batch in batches:
            some, weights, size = [], [], 0
            for symbols, n in zip(batch["symbols"], batch["n"]):
                if some and size + len(symbols) > POSITIONS:
                    add(some, weights)
                    some, weights, size = [], [], 0
                some.append(symbols)
                weights.append(n)
                size += len(symbols)
            if some:
                add(some, weights)
        yield pd.DataFrame([total], columns=[f"k{i}" for i in range(29)])

    return run


_PACKED = "kinds binary, places binary, blocks binary, weights binary"


def _pack(batches):
    """Arrow batches of (symbols, n) to packed groups, a row each; a group has about GROUP symbols."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def row(parts):
        flat, lengths, weights = (np.concatenate(x) for x in zip(*parts))
        arrays = [*_packed(flat, lengths), weights.astype(np.int64)]
        return pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in arrays], [c.split()[0] for c in _PACKED.split(", ")])

    parts, size = [], 0
    for batch in batches:
        lists = batch.column(0)
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, weights = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32), batch.column(1).to_numpy(zero_copy_only=False)
        ends, low = np.cumsum(lengths), 0
        while low < len(ends):
            first = ends[low] - lengths[low]
            high = max(low + 1, int(np.searchsorted(ends, first + GROUP - size, "right")))
            parts.append((flat[first:ends[high - 1]], lengths[low:high], weights[low:high]))
            size, low = size + int(ends[high - 1] - first), high
            if size >= GROUP or low < len(ends):
                yield row(parts)
                parts, size = [], 0
    if parts:
        yield row(parts)


def packed(observed: DataFrame) -> DataFrame:
    """Symbol arrays (symbols, n) as ``expected_counts`` reads them with least work: groups of sequences in blocks, a row a group."""
    return observed.select("symbols", "n").mapInArrow(_pack, _PACKED)


def _packed_counts(start, trans, emit):
    """Task function: as ``_expected_counts``, over packed groups."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(29)
        for batch in batches:
            for group in zip(*(column.to_pylist() for column in batch.columns)):
                arrays = [np.frombuffer(x, kind) for x, kind in zip(group, (np.int32, np.int32, np.int32, np.int64))]
                _packed_sums(total, *arrays, np.array(start), np.array(trans), np.array(emit))
        yield pa.record_batch([pa.array([x]) for x in total], [f"k{i}" for i in range(29)])

    return run


_SUMS = ", ".join(f"k{i} double" for i in range(29))


def expected_counts(observed: DataFrame, model: HmmModel) -> DataFrame:
    """One row: 3 start, 9 transition and 15 emission sums, log-likelihood, sequence count. ``observed`` has symbols, or is ``packed``."""
    parameters = (model.start, model.trans, model.emit)
    if "kinds" in observed.columns:
        parts = observed.mapInArrow(_packed_counts(*parameters), _SUMS)
    else:
        weight = F.col("n") if "n" in observed.columns else F.lit(1).alias("n")
        parts = observed.select("symbols", weight).mapInPandas(_expected_counts(*parameters), _SUMS)
    return parts.agg(*[F.sum(f"k{i}").alias(f"k{i}") for i in range(29)])


def _normalized(values):
    total = sum(values)
    return [v / total for v in values] if total else list(values)


def maximize(sums) -> tuple[list, list, list]:
    trans = [_normalized(sums[3 + 3 * i:6 + 3 * i]) for i in range(3)]
    emit = [_normalized(sums[12 + 5 * i:17 + 5 * i]) for i in range(3)]
    return _normalized(sums[0:3]), trans, emit


def relabeled(model: HmmModel) -> HmmModel:
    """Name the states by mean symbol: highest positive, lowest negative, middle neutral."""
    mean = [sum(k * p for k, p in enumerate(row)) for row in model.emit]
    low, mid, high = sorted(range(3), key=lambda i: (mean[i], i))
    order = [high, low, mid]
    return model._replace(start=[model.start[i] for i in order],
                          trans=[[model.trans[i][j] for j in order] for i in order],
                          emit=[model.emit[i] for i in order])


def fit(observed: DataFrame, max_iter: int = 100, tolerance: float = 0.01, init: HmmModel = START,
        relabel: bool = True) -> HmmModel | None:
    """Baum-Welch. No sequence of two or more symbols: no model.

    The symbols are stored once in the shared folder, equal sequences as one row with their number,
    so a lost executor costs a re-read and no pass depends on the lineage of the one before. They are
    few bytes for much work: dealt over a file a core, or one task would read all of them in every pass. They are packed
    before, so a pass steps over blocks of symbols.
    """
    cores = observed.sparkSession.sparkContext.defaultParallelism
    distinct = eligible(observed).groupBy("symbols").agg(F.count("*").alias("n")).repartition(cores)
    stored = materialize(packed(distinct), "symbols")
    model, history = init, []
    while len(history) < max_iter:
        row = expected_counts(stored, model).first()
        sums = [v or 0.0 for v in row]
        if not sums[28]:
            return None
        history.append(sums[27])
        start, trans, emit = maximize(sums)
        model = HmmModel(start, trans, emit)
        if len(history) > 1 and history[-1] - history[-2] < tolerance:
            break
    settled = len(history) > 1 and history[-1] - history[-2] < tolerance
    model = model._replace(converged=settled or len(history) == max_iter, iterations=len(history), history=tuple(history),
                           stopped_by="tolerance" if settled else "passes")
    return relabeled(model) if relabel else model


def parameter_table(spark, model: HmmModel) -> DataFrame:
    """(kind, from_state, to_state, p): start, transition and emission tables in long form."""
    rows = [("start", "", s, model.start[i]) for i, s in enumerate(lex.SENTIMENTS)]
    rows += [("transition", s, t, model.trans[i][j]) for i, s in enumerate(lex.SENTIMENTS)
             for j, t in enumerate(lex.SENTIMENTS)]
    rows += [("emission", s, str(k), model.emit[i][k]) for i, s in enumerate(lex.SENTIMENTS) for k in range(N_SYMBOLS)]
    return literal_table(spark, {c: [r[i] for r in rows] for i, c in enumerate(["kind", "from_state", "to_state", "p"])})


def from_parameter_table(table: DataFrame) -> HmmModel:
    """Inverse of ``parameter_table``; 27 rows."""
    p = {(r["kind"], r["from_state"], r["to_state"]): r["p"] for r in table.collect()}
    names = lex.SENTIMENTS
    return HmmModel([p["start", "", s] for s in names], [[p["transition", s, t] for t in names] for s in names],
                    [[p["emission", s, str(k)] for k in range(N_SYMBOLS)] for s in names])


def transition_matrix(spark, model: HmmModel) -> DataFrame:
    return parameter_table(spark, model).where(F.col("kind") == "transition").select("from_state", "to_state", "p")


def log(p: float) -> float:
    return math.log(p) if p > 0 else float("-inf")


#: Sentences whose back pointers lie in one string; a sequence is a list of such strings.
POINTERS = 512


def viterbi(symbols, model: HmmModel) -> Column:
    """Best state path of a symbol array as ARRAY<STRING>; ties go to the lower state, an empty array has no states.

    Forward, a step appends one character that packs the three back pointers; backward, a fold
    over these characters follows them. Both folds run over blocks of ``POINTERS`` steps, so what
    a step copies does not grow with the sequence.
    """
    obs = F.col(symbols) if isinstance(symbols, str) else symbols
    emit = [F.array(*[F.lit(log(model.emit[j][k])) for k in range(N_SYMBOLS)]) for j in range(3)]
    names = F.array(*[F.lit(s) for s in lex.SENTIMENTS])

    def best_of(scores) -> Column:
        best = F.greatest(*scores)
        return F.when(scores[0] == best, 0).when(scores[1] == best, 1).otherwise(2)

    def step(acc: Column, o: Column) -> Column:
        scores, packed = [], F.lit(64)
        for j in range(3):
            into = [acc[f"d{i}"] + F.lit(log(model.trans[i][j])) for i in range(3)]
            scores.append((F.greatest(*into) + F.get(emit[j], o)).alias(f"d{j}"))
            packed = packed + best_of(into) * F.lit(4 ** j)
        return F.struct(*scores, F.concat(acc["back"], F.char(packed)).alias("back"))

    def path(os: Column) -> Column:
        first = F.get(os, F.lit(0))
        start = F.struct(*[(F.lit(log(model.start[j])) + F.get(emit[j], first)).alias(f"d{j}") for j in range(3)],
                         F.array().cast("array<string>").alias("blocks"))

        def forward(acc: Column, k: Column) -> Column:
            scores = [acc[f"d{j}"].alias(f"d{j}") for j in range(3)]
            block = F.aggregate(F.slice(os, k * POINTERS + 2, F.lit(POINTERS)), F.struct(*scores, F.lit("").alias("back")), step)
            return text.let(block, lambda x: F.struct(*[x[f"d{j}"].alias(f"d{j}") for j in range(3)],
                                                      F.array_append(acc["blocks"], x["back"]).alias("blocks")))

        def follow(acc: Column, c: Column) -> Column:
            state = (F.ascii(c) - 64).bitwiseAND(F.element_at(F.array(F.lit(3), F.lit(12), F.lit(48)), acc["state"] + 1))
            state = F.floor(state / F.element_at(F.array(F.lit(1), F.lit(4), F.lit(16)), acc["state"] + 1)).cast("int")
            return text.let(state, lambda to: F.struct(to.alias("state"), F.concat(acc["states"], to.cast("string")).alias("states")))

        def backward(acc: Column, back: Column) -> Column:
            block = F.aggregate(F.reverse(F.split(back, "")), F.struct(acc["state"].alias("state"), F.lit("").alias("states")), follow)
            return text.let(block, lambda x: F.struct(x["state"].alias("state"), F.array_append(acc["blocks"], x["states"]).alias("blocks")))

        def finish(end: Column) -> Column:
            last = best_of([end["d0"], end["d1"], end["d2"]])
            start = text.let(last, lambda s: F.struct(s.alias("state"), F.array(s.cast("string")).alias("blocks")))
            return F.aggregate(F.reverse(F.filter(end["blocks"], lambda b: b != "")), start, backward,
                               lambda acc: F.split(F.reverse(F.array_join(acc["blocks"], "")), ""))

        blocks = F.sequence(F.lit(0), F.floor((F.size(os) - 1) / POINTERS).cast("int"))
        digits = text.let(F.aggregate(blocks, start, forward), finish)
        return F.transform(digits, lambda d: F.get(names, d.cast("int")))

    return text.let(obs, lambda os: F.when(F.size(os) > 0, path(os)).otherwise(F.array().cast("array<string>")))


def analyze(observed: DataFrame, model: HmmModel | None, min_symbols: int = 2) -> DataFrame:
    """Adds sentiment_states and transitions to (key, scores, symbols) rows.

    Without a model, or with fewer than two sentences, the states come from the polarity.
    """
    fallback = F.transform("scores", se.fallback_state)
    states = fallback if model is None else F.when(F.size("symbols") >= min_symbols, viterbi("symbols", model)).otherwise(fallback)
    staged = observed.withColumn("sentiment_states", states)
    return staged.withColumn("transitions", se.transitions("sentiment_states"))


def score(observed: DataFrame, model: HmmModel) -> DataFrame:
    """Log-likelihood and perplexity exp(-LL / symbols); held out when ``observed`` took no part in the training. Equal sequences are scored once."""
    usable = eligible(observed).groupBy("symbols").agg(F.count("*").alias("n"))
    ll = expected_counts(usable, model).select(F.col("k27").alias("log_likelihood"), F.col("k28").cast("bigint").alias("n_sequences"))
    n = usable.agg(F.sum(F.size("symbols") * F.col("n"))).scalar()
    return ll.withColumn("n_symbols", n).withColumn("perplexity", F.exp(-F.col("log_likelihood") / F.col("n_symbols")))
