"""Whitening by the exact characteristic polynomial of an integer scatter matrix.

Entries become integers, floor(SCALE * c) + SHIFT. With whole numbers taken off near the means, the scatter
n * sum(z z') - sum(z) sum(z)' is an exact integer matrix, n^2 times the covariance, summed in Spark from one partial matrix
a batch. Its characteristic polynomial is found modulo many primes, each by a Hessenberg reduction in a task of its own,
and put together by Chinese remaindering. The polynomial has real roots only, so the sign changes of its shifted coefficients
count the roots above a number exactly: roots are isolated by bisection over these counts and refined to 2^-ROOT_BITS of
the scatter's unit. Roots that are still together count as one of that multiplicity; zero roots are seen exactly. Components
are the null space of scatter - root, by inverse iteration in DIGITS-digit decimals, one root a task.

Only the sums, the polynomial and the components (sizes set by the dimensions, not by the rows) reach the driver.

Defined cases: vectors that are null, empty, or hold null or non-finite entries are left out; so are vectors of another length
than most have (ties: the longer). Entries beyond +-LIMIT count as +-LIMIT. Repeated rows count as often as they come, null
ids stay. Components of eigenvalue zero are not given, so equal vectors, one vector or an empty table give no rows. The sign of a
component makes its largest entry positive. deviation is null where it passes 64 bits; deviation_text is always there.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext
from fractions import Fraction
from math import comb, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from voxtable.llm.stored import stored

SCALE = 64
SHIFT = 1_000_000
LIMIT = 1 << 44
ROWS = 4096
LIMB = 20
ROOT_BITS = 64
DIGITS = 70


@dataclass
class Fit:
    """n vectors, sums and scatter (both exact), roots as (root * 2^ROOT_BITS, multiplicity) falling, components as rows."""

    n: int
    sums: list[int]
    scatter: np.ndarray
    roots: list[tuple[int, int]]
    eigenvalues: list[int]
    components: np.ndarray

    def variance(self, k: int) -> float:
        """Eigenvalue of the covariance, correctly rounded."""
        return float(Fraction(self.eigenvalues[k], self.n * self.n << ROOT_BITS))

    def explained(self, k: int) -> float:
        return float(Fraction(self.eigenvalues[k], sum(int(x) for x in self.scatter.diagonal()) << ROOT_BITS))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    broken = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.where(F.size("vector") > 0).where(~broken)


def integers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All entries as integers, and begin and length of each row's."""
    vectors = batch["vector"]
    entries = np.clip(np.floor(vectors.values.to_numpy(zero_copy_only=False) * SCALE), -LIMIT, LIMIT).astype(np.int64) + SHIFT
    return entries, vectors.offsets.to_numpy()[:-1].astype(np.int64), np.asarray(vectors.value_lengths()).astype(np.int64)


def blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of length d, at most ROWS at a time, with their integers."""
    for batch in batches:
        entries, begins, sizes = integers(batch)
        at = np.flatnonzero(sizes == d)
        for part in np.array_split(at, -(-len(at) // ROWS) or 1):
            if len(part):
                yield batch.take(pa.array(part)), entries[begins[part][:, None] + np.arange(d)]


def added(keys: list[str], parts: DataFrame) -> DataFrame:
    return parts.groupBy(*keys).agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))


def decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def totals(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors of the commonest length, and the sums of their integers."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries, begins, sizes = integers(batch)
            for d in np.unique(sizes):
                at = begins[sizes == d]
                sums = entries[at[:, None] + np.arange(d)].sum(0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(d + 1, d)), pa.array(np.arange(-1, d)), decimals([len(at), *sums])], ["size", "place", "value"])

    sums = stored(added(["size", "place"], rows.mapInArrow(fn, "size long, place long, value decimal(38,0)")), "sums")
    most = sums.where("place = -1").orderBy(F.desc("value"), F.desc("size")).first()
    if most is None:
        return 0, []
    own = sums.where((F.col("size") == most["size"]) & (F.col("place") >= 0)).orderBy("place").collect()
    return int(most["value"]), [int(r["value"]) for r in own]


def products(z: np.ndarray) -> np.ndarray:
    """z'z exactly: limbs of LIMB bits are multiplied in doubles, where all sums stay below 2^53."""
    if np.abs(z).max(initial=0) < 1 << LIMB:
        f = z.astype(float)
        return (f.T @ f).astype(np.int64).astype(object)
    limbs, left = [], z
    while np.abs(left).max() >= 1 << LIMB:
        limbs.append((left & ((1 << LIMB) - 1)).astype(float))
        left = left >> LIMB
    limbs.append(left.astype(float))
    return sum((a.T @ b).astype(np.int64).astype(object) << LIMB * (i + j) for i, a in enumerate(limbs) for j, b in enumerate(limbs))


def scatter_of(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """n^2 times the covariance as an exact integer matrix."""
    d = len(sums)
    centre = [s // n for s in sums]
    upper = np.triu_indices(d)
    places = np.arange(len(upper[0]))

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), object)
        for _, x in blocks(batches, d):
            total = total + products(x - np.array(centre, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(places), decimals(total[upper])], ["place", "value"])

    found = added(["place"], rows.mapInArrow(fn, "place long, value decimal(38,0)")).orderBy("place").collect()
    out = np.zeros((d, d), object)
    out[upper] = [int(r["value"]) for r in found]
    out = np.where(np.tri(d, k=-1, dtype=bool), out.T, out)
    off = np.array([s - n * c for s, c in zip(sums, centre, strict=True)], object)
    return out * n - np.multiply.outer(off, off)


def is_prime(p: int) -> bool:
    """Miller-Rabin; these bases decide all numbers below 3.2e9."""
    odd, twos = p - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, p)
        if x not in (1, p - 1) and all((x := x * x % p) != p - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """Primes below 2^31, from the largest on, with a product above the bound."""
    out, product, p = [], 1, (1 << 31) - 1
    while product <= bound:
        if is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients (constant first) of the characteristic polynomial modulo p, by reduction to Hessenberg form."""
    h = (matrix % p).astype(np.int64)
    n = len(h)
    for k in range(n - 2):
        below = np.flatnonzero(h[k + 1:, k])
        if not len(below):
            continue
        i = k + 1 + below[0]
        if i != k + 1:
            h[[i, k + 1]] = h[[k + 1, i]]
            h[:, [i, k + 1]] = h[:, [k + 1, i]]
        u = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:] = (h[k + 2:] - u[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2:] * u % p).sum(1)) % p
    found = [np.ones(1, np.int64)]
    for m in range(1, n + 1):
        q = np.zeros(m + 1, np.int64)
        q[1:] = found[-1]
        q[:-1] = (q[:-1] - h[m - 1, m - 1] * found[-1] % p) % p
        chain = 1
        for i in range(m - 1, 0, -1):
            chain = chain * int(h[i, i - 1]) % p
            if chain == 0:
                break
            q[:i] = (q[:i] - chain * int(h[i - 1, m - 1]) % p * found[i - 1] % p) % p
        found.append(q)
    return found[-1]


def polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """The exact characteristic polynomial of a positive semidefinite integer matrix, constant first; a task takes some primes."""
    d, trace = len(matrix), sum(int(x) for x in matrix.diagonal())
    # The k-th coefficient is a symmetric sum of non-negative roots, largest when all are trace / d.
    bound = 2 * max(comb(d, k) * -(-trace ** k // d ** k) for k in range(d + 1))
    primes = primes_beyond(bound)
    shared = spark.sparkContext.broadcast(matrix)

    def fn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"prime": frame["prime"], "coefficients": [polynomial_modulo(shared.value, int(p)).tolist() for p in frame["prime"]]})

    asked = spark.createDataFrame(pd.DataFrame({"prime": primes})).repartition(min(len(primes), 64))
    product, out = 1, [0] * (d + 1)
    for row in asked.mapInPandas(fn, "prime long, coefficients array<long>").collect():
        p = row["prime"]
        inverse = pow(product, -1, p)
        out = [x + product * ((r - x) * inverse % p) for x, r in zip(out, row["coefficients"], strict=True)]
        product *= p
    return [x - product if 2 * x > product else x for x in out]


def above(coefficients: list[int], a: int) -> int:
    """How many roots are greater than a, with multiplicity: sign changes after a shift by a. All roots are real."""
    c = list(coefficients)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += a * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def value(coefficients: list[int], x: int) -> int:
    total = 0
    for c in reversed(coefficients):
        total = total * x + c
    return total


def refined(coefficients: list[int], lo: int, hi: int) -> int:
    """The least integer that is not below the single root in (lo, hi]."""
    end = value(coefficients, hi)
    while end and hi - lo > 1:
        mid = (lo + hi) // 2
        v = value(coefficients, mid)
        if v == 0:
            return mid
        lo, hi = (lo, mid) if (v > 0) == (end > 0) else (mid, hi)
    return hi


def roots(coefficients: list[int], count: int, bits: int = ROOT_BITS) -> list[tuple[int, int]]:
    """The largest positive roots times 2^bits, rounded up, with multiplicities, until ``count`` roots are given."""
    coefficients = coefficients[next((k for k, c in enumerate(coefficients) if c), 0):]
    d = len(coefficients) - 1
    fine = [c << bits * (d - k) for k, c in enumerate(coefficients)]
    out: list[tuple[int, int]] = []
    if d == 0:
        return out
    # Intervals (lo, hi] with the number of roots above lo and above hi; scaled ones are in units of 2^-bits.
    todo = [(False, 0, 1 << max(1, int(-coefficients[-2]).bit_length()), d, 0)]
    while todo and sum(m for _, m in out) < count:
        scaled, lo, hi, over_lo, over_hi = todo.pop()
        if over_lo == over_hi:
            continue
        if over_lo - over_hi == 1:
            out.append((refined(fine, lo if scaled else lo << bits, hi if scaled else hi << bits), 1))
        elif hi - lo > 1:
            mid = (lo + hi) // 2
            over = above(fine if scaled else coefficients, mid)
            todo += [(scaled, lo, mid, over_lo, over), (scaled, mid, hi, over, over_hi)]
        elif scaled:
            out.append((hi, over_lo - over_hi))
        else:
            todo.append((True, lo << bits, hi << bits, over_lo, over_hi))
    return out


def null_space(matrix: np.ndarray, root: int, multiplicity: int, bits: int = ROOT_BITS) -> np.ndarray:
    """Orthonormal rows that span the null space of matrix - root / 2^bits, by inverse iteration in decimals."""
    d = len(matrix)
    with localcontext() as context:
        context.prec = DIGITS
        unit = Decimal(2) ** bits
        a = np.array([[Decimal(int(x)) for x in row] for row in matrix], object)
        a[np.diag_indices(d)] -= Decimal(root) / unit
        tiny = (Decimal(1) + sum(abs(x) for x in a.diagonal())).scaleb(-DIGITS + 10)
        x = np.array([[Decimal((7919 * (i + 1) * (k + 1) + 104729 * i * i * (k + 1)) % 1009 - 504) + Decimal("0.5") for k in range(multiplicity)] for i in range(d)], object)
        order = np.arange(d)
        for k in range(d):
            i = k + max(range(d - k), key=lambda j: abs(a[k + j, k]))
            a[[i, k]] = a[[k, i]]
            order[[i, k]] = order[[k, i]]
            if abs(a[k, k]) < tiny:
                a[k, k] = tiny
            factor = a[k + 1:, k] / a[k, k]
            a[k + 1:, k + 1:] -= factor[:, None] * a[k, k + 1:]
            a[k + 1:, k] = factor
        for _ in range(3):
            x = x[order]
            for k in range(d):
                x[k + 1:] -= a[k + 1:, k][:, None] * x[k]
            for k in range(d - 1, -1, -1):
                x[k] = x[k] / a[k, k]
                x[:k] -= a[:k, k][:, None] * x[k]
            for k in range(multiplicity):
                for _ in range(2):
                    for j in range(k):
                        x[:, k] -= x[:, j] * (x[:, j] * x[:, k]).sum()
                    x[:, k] /= (x[:, k] * x[:, k]).sum().sqrt()
        out = x.T.astype(float)
    most = np.abs(out).argmax(1)
    return out * np.sign(out[np.arange(multiplicity), most])[:, None]


def components_of(spark: SparkSession, matrix: np.ndarray, found: list[tuple[int, int]]) -> np.ndarray:
    """Unit eigenvectors as rows, in the order of the roots; each root is a task's."""
    shared = spark.sparkContext.broadcast(matrix)

    def fn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            spaces = [null_space(shared.value, int(r), int(m)) for r, m in zip(frame["root"], frame["multiplicity"], strict=True)]
            yield pd.DataFrame({"place": frame["place"], "vectors": [s.ravel().tolist() for s in spaces]})

    asked = spark.createDataFrame([(k, str(r), m) for k, (r, m) in enumerate(found)], "place int, root string, multiplicity int")
    done = asked.repartition(len(found)).mapInPandas(fn, "place int, vectors array<double>").collect()
    return np.concatenate([np.reshape(r["vectors"], (-1, len(matrix))) for r in sorted(done)])


def fit(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> Fit | None:
    """Scatter, roots and components over all usable vectors; None where no eigenvalue is above zero."""
    rows, spark = usable(vectors, id_col, vector_col), vectors.sparkSession
    n, sums = totals(rows)
    if not n:
        return None
    scatter = scatter_of(rows, n, sums)
    found = roots(polynomial(spark, scatter), components) if any(scatter.diagonal()) else []
    if not found:
        return None
    values = [r for r, m in found for _ in range(m)][:components]
    return Fit(n, sums, scatter, found, values, components_of(spark, scatter, found)[:components])


def covariance_error(whitened: DataFrame, n: int, k: int) -> float:
    """Largest absolute entry of the covariance of k whitened columns minus the identity; centred, then multiplied."""

    def sums(batches: Iterator[pa.RecordBatch], of) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            total = total + of(batch["whitened"].flatten().to_numpy().reshape(-1, k))
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["place", "value"])

    def summed(of) -> np.ndarray:
        parts = whitened.select("whitened").mapInArrow(lambda batches: sums(batches, of), "place long, value double")
        return np.array([r["value"] for r in parts.groupBy("place").agg(F.sum("value").alias("value")).orderBy("place").collect()])

    mean = summed(lambda w: w.sum(0)) / n
    covariance = summed(lambda w: (w - mean).T @ (w - mean)).reshape(k, k) / n
    return float(np.abs(covariance - np.eye(k)).max())


def transform(vectors: DataFrame, model: Fit, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row a usable vector: id, deviation, deviation_text, whitened (an array, one entry a component)."""
    n, d = model.n, len(model.sums)
    centre = np.array([s // n for s in model.sums], np.int64)
    off = [s - n * int(c) for s, c in zip(model.sums, centre, strict=True)]
    weights = (model.components / np.array([sqrt(model.variance(k)) for k in range(len(model.components))])[:, None]).T
    wide = np.iinfo(np.int64).max

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = np.array([o / n for o in off])
        for batch, x in blocks(batches, d):
            z = x - centre
            fits = (int(np.abs(z).max()) + 1) ** 2 * n * n * d <= wide
            far = n * (z if fits else z.astype(object)) - np.array(off, np.int64 if fits else object)
            deviation = (far * far).sum(1).tolist()
            whitened = (z - part) @ weights
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array([v if v <= wide else None for v in deviation], pa.int64()), pa.array([str(v) for v in deviation]),
                 pa.FixedSizeListArray.from_arrays(pa.array(whitened.ravel()), weights.shape[1]).cast(pa.list_(pa.float64()))],
                ["id", "deviation", "deviation_text", "whitened"])

    rows = usable(vectors, id_col, vector_col)
    kind = rows.select("id").schema.add("deviation", "long").add("deviation_text", "string").add("whitened", ArrayType(DoubleType()))
    return rows.mapInArrow(fn, kind).withColumnRenamed("id", id_col)


def whiten(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row a usable vector and component: id, component (from 1), n, deviation, whitened, explained, identity_error, deviation_text."""
    spark = vectors.sparkSession
    model = fit(vectors, components, id_col, vector_col)
    kind = vectors.schema[id_col].dataType.simpleString()
    if model is None:
        return spark.createDataFrame([], f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_text string")
    rows = stored(transform(vectors, model, id_col, vector_col), "whitened")
    error = covariance_error(rows, model.n, len(model.components))
    shares = F.array(*(F.lit(model.explained(k)) for k in range(len(model.components))))
    each = rows.select(id_col, "deviation", "deviation_text", F.posexplode("whitened").alias("place", "whitened"))
    return each.select(id_col, (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                       F.get(shares, F.col("place")).alias("explained"), F.lit(error).alias("identity_error"), "deviation_text")
