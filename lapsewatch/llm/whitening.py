"""Embedding whitening by an exact characteristic polynomial.

Entries become integers, so the scatter matrix n * sum(x x') - S S' is one too (x's covariance is
that over n * n). Spark sums its entries exactly over all vectors. Its characteristic polynomial
comes from its residues: each prime's task reduces the matrix to Hessenberg form modulo the prime,
and Chinese remaindering gives the integer coefficients; there are enough primes for the bound
(1 + trace / d) ** d. All roots are real, so the sign changes of the shifted polynomial count those
above a point exactly, which isolates the largest ones; bisection brings them to ``BITS`` bits.
Components come from the null space of the matrix less an eigenvalue, by inverse iteration in
``DIGITS`` digits. A last pass over the vectors measures the covariance of what is returned.

Vectors that are null or hold a null or non-finite entry are dropped; so are those with an entry
whose integer does not fit a long (64 * c beyond 2 ** 62). Zero vectors and repeated rows stay.
Vectors of different widths cannot be compared: each width is a fit of its own. Vectors of width
zero, and directions without any spread (exactly zero roots), have no component, so a single
vector or equal ones return no row. Roots that agree in ``SAME`` bits count as one multiple root:
its components are an orthonormal basis of its space. A deviation beyond a long is null. Only
the named columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewatch.llm.common import partitions, pieces_of

SCALE, LIFT, COMPONENTS = 64, 1_000_000, 32
#: Relative bits of a root, bits in which different roots differ, decimal digits of the iteration.
BITS, SAME, DIGITS = 240, 160, 110
#: Halves of a sum of products, so that each fits a decimal of 38 digits.
LIMB = 1 << 60
LARGEST = float(1 << 62)


def integer_blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and integers floor(64 * c) of the usable vectors, one block per width."""
    lengths = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    for width in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == width)
        block = flat[starts[at][:, None] + np.arange(width)]
        with np.errstate(over="ignore", invalid="ignore"):
            scaled = np.floor(SCALE * block)
            good = (np.abs(scaled) < LARGEST).all(axis=1)
        yield at[good], scaled[good].astype(np.int64)


def gram(rows: np.ndarray) -> np.ndarray:
    """Exact sums of products of the columns, as Python integers."""
    most = int(np.abs(rows).max(initial=0))
    bound = most * most * max(1, len(rows))
    if bound < 1 << 53:  # every partial sum is an integer that a double holds
        return (rows.T.astype(float) @ rows.astype(float)).astype(np.int64).astype(object)
    if bound < 1 << 62:
        return (rows.T @ rows).astype(object)
    return rows.T.astype(object) @ rows.astype(object)


@dataclass
class Sums:
    """Number of vectors of a width, sums of their integers, sums of products."""

    n: int
    first: list[int]
    second: np.ndarray

    def scatter(self) -> np.ndarray:
        s = np.array(self.first, object)
        return self.n * self.second - np.outer(s, s)


def sums_by_width(df: DataFrame, vector: str) -> dict[int, Sums]:
    """Exact sums over all vectors; a task sends one row per entry, Spark adds them up."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, Sums] = {}
        for batch in batches:
            for piece in pieces_of(batch, 4096):
                for _, rows in integer_blocks(piece.column(0)):
                    width = rows.shape[1]
                    held = total.setdefault(width, Sums(0, [0] * width, np.zeros((width, width), object)))
                    held.n += len(rows)
                    held.first = [a + b for a, b in zip(held.first, rows.astype(object).sum(axis=0))] \
                        if len(rows) else held.first
                    held.second = held.second + gram(rows)
        for width, held in total.items():
            upper = [(i, j, held.second[i, j]) for i in range(width) for j in range(i, width)]
            cells = [(-1, -1, held.n)] + [(i, -1, v) for i, v in enumerate(held.first)] + upper
            split = [divmod(int(v), LIMB) for _, _, v in cells]
            yield pa.RecordBatch.from_arrays(
                [pa.array([width] * len(cells), pa.int32()), pa.array([c[0] for c in cells], pa.int32()),
                 pa.array([c[1] for c in cells], pa.int32()),
                 *(pa.array([Decimal(s[k]) for s in split], pa.decimal128(38, 0)) for k in (0, 1))],
                ["width", "i", "j", "high", "low"])

    cells = (df.select(vector).mapInArrow(work, "width int, i int, j int, high decimal(38,0), low decimal(38,0)")
             .groupBy("width", "i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")))
    out: dict[int, Sums] = {}
    for r in cells.collect():  # as many rows as the widths' matrices have entries
        held = out.setdefault(r.width, Sums(0, [0] * r.width, np.zeros((r.width, r.width), object)))
        value = int(r.high) * LIMB + int(r.low)
        if r.i < 0:
            held.n = value
        elif r.j < 0:
            held.first[r.i] = value
        else:
            held.second[r.i, r.j] = held.second[r.j, r.i] = value
    return {width: held for width, held in out.items() if held.n}


def is_prime(n: int) -> bool:
    """Miller-Rabin; these bases decide for every n below 3 * 10 ** 9."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x not in (1, n - 1):
            for _ in range(twos - 1):
                x = x * x % n
                if x == n - 1:
                    break
            else:
                return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """The largest primes below 2 ** 31 whose product exceeds the bound."""
    found, product, n = [], 1, (1 << 31) - 1
    while product <= bound:
        if is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def polynomial_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients, constant first, of det(t - matrix) modulo p, by way of the Hessenberg form."""
    a = np.array([[int(v) % p for v in row] for row in matrix], np.int64)
    d = len(a)
    for k in range(d - 2):
        below = np.flatnonzero(a[k + 1:, k])
        if not len(below):
            continue
        i, to = k + 1 + int(below[0]), k + 1
        if i != to:
            a[[i, to]] = a[[to, i]]
            a[:, [i, to]] = a[:, [to, i]]
        factors = a[k + 2:, k] * pow(int(a[to, k]), p - 2, p) % p
        a[k + 2:] = (a[k + 2:] - factors[:, None] * a[to] % p) % p
        a[:, to] = (a[:, to] + (a[:, k + 2:] * factors % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        new = np.roll(polys[k - 1], 1)
        weights = np.zeros(k, np.int64)
        weights[k - 1] = a[k - 1, k - 1]
        chain = 1
        for m in range(k - 1, 0, -1):
            chain = chain * int(a[m, m - 1]) % p
            if not chain:
                break
            weights[m - 1] = chain * int(a[m - 1, k - 1]) % p
        polys[k] = (new - (weights[:, None] * polys[:k] % p).sum(axis=0)) % p
    return polys[d]


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Exact coefficients, constant first, for a symmetric matrix without negative eigenvalues.

    One residue per prime, in parallel tasks; a coefficient is at most (1 + trace / d) ** d.
    """
    d = len(matrix)
    trace = int(sum(matrix[i, i] for i in range(d)))
    primes = primes_beyond(2 * (1 + -(-trace // d)) ** d)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p]), pa.array([polynomial_mod(matrix, p).tolist()], pa.list_(pa.int64()))],
                    ["p", "residues"])

    tasks = min(len(primes), partitions(spark))
    found = spark.createDataFrame([(p,) for p in primes], "p bigint").repartition(tasks).mapInArrow(
        work, "p bigint, residues array<bigint>").collect()
    modulus = math.prod(primes)
    total = [0] * (d + 1)
    for r in found:
        rest = modulus // r.p
        unit = rest * pow(rest % r.p, -1, r.p)
        total = [t + v * unit for t, v in zip(total, r.residues)]
    total = [t % modulus for t in total]
    return [t - modulus if 2 * t > modulus else t for t in total]


class RealRoots:
    """The positive roots of an integer polynomial that has real roots only, largest first."""

    def __init__(self, coefficients: list[int]):
        first = next(i for i, c in enumerate(coefficients) if c)
        self.c = coefficients[first:]
        self.degree = len(self.c) - 1
        # No root exceeds the sum of all, the negative second coefficient of a monic polynomial.
        self.top = abs(self.c[-2]) + 1 if self.degree else 0

    def above(self, at: int, bits: int) -> int:
        """How many roots exceed at / 2 ** bits: sign changes of the polynomial shifted there."""
        c = [v << (bits * (self.degree - i)) for i, v in enumerate(self.c)]
        for i in range(self.degree):
            for j in range(self.degree - 1, i - 1, -1):
                c[j] += at * c[j + 1]
        signs = [v > 0 for v in c if v]
        return sum(a != b for a, b in zip(signs, signs[1:]))

    def sign(self, at: int, bits: int) -> int:
        value, scale = 0, 1
        for i in range(self.degree, -1, -1):
            value = value * at + self.c[i] * scale
            scale <<= bits
        return (value > 0) - (value < 0)

    def largest(self, count: int) -> list[tuple[Fraction, int]]:
        """At least ``count`` roots, if there are as many, with their multiplicities."""
        found: list[tuple[Fraction, int]] = []
        stack = [(0, self.top, 0, self.degree, 0)] if self.degree else []
        while stack and sum(m for _, m in found) < count:
            low, high, bits, upto, beyond = stack.pop()
            number = upto - beyond  # roots in (low, high]
            if not number:
                continue
            if number == 1:
                found.append((self.refine(low, high, bits), 1))
            elif low and (high - low) << SAME < low:
                found.append((Fraction(low + high, 2 << bits), number))
            else:
                if high - low == 1:
                    low, high, bits = low << 32, high << 32, bits + 32
                middle = (low + high) // 2
                between = self.above(middle, bits)
                stack.append((low, middle, bits, upto, between))
                stack.append((middle, high, bits, between, beyond))
        return found

    def refine(self, low: int, high: int, bits: int) -> Fraction:
        right = self.sign(high, bits)
        if not right:
            return Fraction(high, 1 << bits)
        while not low or (high - low) << BITS > low:
            if high - low == 1:
                low, high, bits = low << 64, high << 64, bits + 64
            middle = (low + high) // 2
            sign = self.sign(middle, bits)
            if not sign:
                return Fraction(middle, 1 << bits)
            low, high = (low, middle) if sign == right else (middle, high)
        return Fraction(low + high, 2 << bits)


def null_space(matrix: np.ndarray, root: Fraction, count: int) -> list[np.ndarray]:
    """Unit vectors that the matrix only stretches by ``root``, by inverse iteration from fixed starts."""
    d = len(matrix)
    with localcontext() as context:
        context.prec = DIGITS
        to_decimal = np.frompyfunc(lambda v: Decimal(int(v)), 1, 1)
        value = Decimal(root.numerator) / Decimal(root.denominator)
        a = to_decimal(matrix)
        for i in range(d):
            a[i, i] -= value
        tiny = max(abs(v) for v in a.flat) * Decimal(10) ** (10 - DIGITS) or Decimal(1)
        order = list(range(d))
        for k in range(d):
            best = max(range(k, d), key=lambda i: abs(a[i, k]))
            if best != k:
                a[[k, best]] = a[[best, k]]
                order[k], order[best] = order[best], order[k]
            if abs(a[k, k]) < tiny:
                a[k, k] = tiny
            if k + 1 < d:
                a[k + 1:, k] = a[k + 1:, k] / a[k, k]
                a[k + 1:, k + 1:] -= np.outer(a[k + 1:, k], a[k, k + 1:])

        def solve(b: np.ndarray) -> np.ndarray:
            b = b[order]
            for i in range(1, d):
                b[i] -= (a[i, :i] * b[:i]).sum()
            for i in range(d - 1, -1, -1):
                if i + 1 < d:
                    b[i] -= (a[i, i + 1:] * b[i + 1:]).sum()
                b[i] /= a[i, i]
            return b

        state, vectors = 1, []
        for _ in range(count):
            start = []
            for _ in range(d):
                state = state * 69069 % ((1 << 31) - 1)
                start.append(Decimal(state - (1 << 30)))
            vectors.append(np.array(start, object))
        for _ in range(3):
            done: list[np.ndarray] = []
            for v in vectors:
                v = solve(v / max(abs(x) for x in v))
                v = v / max(abs(x) for x in v)
                for _ in range(2):
                    for u in done:
                        v = v - u * (u * v).sum()
                done.append(v / (v * v).sum().sqrt())
            vectors = done
        out = []
        for v in vectors:
            lead = max(range(d), key=lambda i: abs(v[i]))
            out.append(np.array([float(x if v[lead] > 0 else -x) for x in v]))
    return out


@dataclass
class Fit:
    """What a width's vectors are centred on and projected on."""

    n: int
    first: list[int]
    mean: np.ndarray
    components: np.ndarray  # a column each
    scale: np.ndarray  # 1 / sqrt(eigenvalue)
    explained: np.ndarray
    identity_error: float = math.nan

    def whiten(self, rows: np.ndarray) -> np.ndarray:
        return ((rows - self.mean) @ self.components) * self.scale

    def deviation(self, rows: np.ndarray) -> list[int | None]:
        most = max(int(np.abs(rows).max(initial=0)) * self.n, max(map(abs, self.first)))
        if (2 * most) ** 2 * rows.shape[1] < 1 << 63:
            moved = rows * self.n - np.array(self.first, np.int64)
            return (moved * moved).sum(axis=1).tolist()
        moved = rows.astype(object) * self.n - np.array(self.first, object)
        return [v if v < 1 << 63 else None for v in (moved * moved).sum(axis=1)]


def fit(spark: SparkSession, sums: Sums, most: int = COMPONENTS) -> Fit | None:
    """The components of a width with the largest eigenvalues, or None without any spread."""
    scatter = sums.scatter()
    trace = int(scatter.trace())
    if not trace:
        return None
    columns, values = [], []
    for root, count in RealRoots(characteristic_polynomial(spark, scatter)).largest(most):
        columns += null_space(scatter, root, count)
        values += [root] * count
    columns, values = columns[:most], values[:most]
    with localcontext() as context:
        context.prec = DIGITS
        scale = [float(sums.n / (Decimal(v.numerator) / Decimal(v.denominator)).sqrt()) for v in values]
    return Fit(sums.n, sums.first, np.array([float(Fraction(s, sums.n)) for s in sums.first]),
               np.array(columns).T, np.array(scale), np.array([float(v / trace) for v in values]))


def measure(df: DataFrame, vector: str, fits: dict[int, Fit]) -> None:
    """Sets each fit's largest departure of the whitened covariance from the identity."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece in pieces_of(batch, 4096):
                for _, rows in integer_blocks(piece.column(0)):
                    if rows.shape[1] in fits and len(rows):
                        # A one beside the coordinates: their sums are in the products too.
                        white = np.c_[fits[rows.shape[1]].whiten(rows), np.ones(len(rows))]
                        total[rows.shape[1]] = total.get(rows.shape[1], 0) + white.T @ white
        for width, products in total.items():
            i, j = np.triu_indices(len(products))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), width, np.int32)), pa.array(i.astype(np.int32)),
                 pa.array(j.astype(np.int32)), pa.array(products[i, j])], ["width", "i", "j", "value"])

    cells = (df.select(vector).mapInArrow(work, "width int, i int, j int, value double")
             .groupBy("width", "i", "j").agg(F.sum("value").alias("value")).collect())
    for width, held in fits.items():
        k = len(held.scale)
        products = np.zeros((k + 1, k + 1))
        for r in cells:
            if r.width == width:
                products[r.i, r.j] = products[r.j, r.i] = r.value
        mean = products[:k, k] / held.n
        held.identity_error = float(np.abs(
            products[:k, :k] / held.n - np.outer(mean, mean) - np.eye(k)).max())


OUT = ("key bigint, component int, n bigint, deviation bigint, whitened double, explained double, "
       "identity_error double")


def whiten(df: DataFrame, key: str, vector: str, most: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: key, component, n, deviation, whitened, explained,
    identity_error."""
    spark = df.sparkSession
    chosen = df.select(F.col(key).cast("bigint").alias("key"), F.col(vector).alias("vector"))
    fits = {width: found for width, sums in sums_by_width(chosen, "vector").items()
            if (found := fit(spark, sums, most)) is not None}
    if fits:
        measure(chosen, "vector", fits)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces_of(batch, 1024):
                for at, rows in integer_blocks(piece.column(1)):
                    held = fits.get(rows.shape[1])
                    if held is None or not len(rows):
                        continue
                    k = len(held.scale)
                    each = np.repeat(np.arange(len(rows)), k)
                    deviation = pa.array(held.deviation(rows), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [piece.column(0).take(pa.array(at[each])),
                         pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                         pa.array(np.full(len(each), held.n, np.int64)), deviation.take(pa.array(each)),
                         pa.array(held.whiten(rows).ravel()), pa.array(np.tile(held.explained, len(rows))),
                         pa.array(np.full(len(each), held.identity_error))],
                        [part.split()[0] for part in OUT.split(", ")])

    return chosen.mapInArrow(work, OUT).withColumnRenamed("key", key)
