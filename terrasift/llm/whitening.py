"""Embedding whitening through the exact characteristic polynomial of the scatter matrix.

Entries become integers, so the scatter matrix ``M = n * sum(x x') - S S'`` is an integer
matrix that tasks add up without rounding. ``det(tI - M)`` is found modulo many primes, one
Hessenberg reduction each, as Spark tasks, and put together by the Chinese remainder theorem.
All its roots are real and not negative, hence the sign changes of the shifted polynomial count
the roots above a point exactly; bisection isolates the largest ones and refines them far
beyond a double. Inverse iteration in decimal arithmetic on ``M - tI`` then gives the null
space of each root, one task per group of roots too close to part.

What reaches the driver is bounded by the dimension d alone: the d (d + 1) / 2 sums, d + 1
coefficients a prime and the components.

Defined cases: rows whose vector is null, empty or holds null or non-finite entries take no
part; of vectors of several lengths the commonest length counts (ties: the longer), others take
no part; repeated rows and null ids are rows like any other; entries that leave 62
bits when multiplied by 1024 are held at that bound; an empty table, or one whose vectors are all equal, gives no
rows; only roots above zero have a component, so fewer than ``components`` may come back; a
deviation beyond 38 digits is null; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Context, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.llm.common import stage

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Entries are cut into digits of so many bits; products of two, over a block of rows, fit 52 bits.
DIGIT, BLOCK = 20, 4096
BOUND = 1 << 62
#: Sums travel as so many base-2^31 digits, which longs add without overflow.
LIMB, LIMBS = 31, 8
#: Bits behind the point of a root, and digits of the decimal arithmetic.
FRACTION, DIGITS = 200, 110
#: Roots nearer than this share of the larger count as one root of higher multiplicity.
CLOSE = Decimal(10) ** -30


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf))
    rows = vectors.select("vec_id", F.col(column).cast("array<double>").alias("v")).filter(
        F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad)
    )
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("v") == lengths["d"]) if lengths else rows.limit(0)


def integers(batch: pa.RecordBatch) -> np.ndarray:
    """Rows of ``floor(1024 c)``; the constant added to every entry changes no centred value."""
    column = batch.column("v")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        scaled = np.floor(flat * SCALE)
    # 2^62 and its negative are doubles, so the cast is exact.
    return np.clip(scaled, -float(BOUND), float(BOUND)).astype(np.int64).reshape(batch.num_rows, -1)


def gram(y: np.ndarray) -> np.ndarray:
    """Exact ``y' y`` as Python integers: products of short digits are exact in doubles."""
    d = y.shape[1]
    total = np.zeros((d, d), object)
    for block in (y[i:i + BLOCK] for i in range(0, len(y), BLOCK)):
        top = max(abs(int(block.max())), abs(int(block.min())))
        count = max(1, -(-top.bit_length() // DIGIT))
        digits = [(block >> DIGIT * k) & ((1 << DIGIT) - 1) for k in range(count - 1)] + [block >> DIGIT * (count - 1)]
        wide = np.hstack(digits).astype(np.float64)
        product = (wide.T @ wide).astype(np.int64).astype(object)
        for a in range(count):
            for b in range(count):
                total += product[a * d:(a + 1) * d, b * d:(b + 1) * d] << DIGIT * (a + b)
    return total


def limbs(value: int) -> list[int]:
    low = [(value >> LIMB * k) & ((1 << LIMB) - 1) for k in range(LIMBS - 1)]
    return [*low, value >> LIMB * (LIMBS - 1)]


def scatter(rows: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums of the integers, integer scatter matrix) of ``rows(v)``, exact."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            y = integers(batch)
            if sums is None:
                sums, products = np.zeros(y.shape[1], object), np.zeros((y.shape[1],) * 2, object)
            n += len(y)
            sums += y.astype(object).sum(axis=0)
            products += gram(y)
        if n:
            d = len(sums)
            cells = [(-1, -1, n)] + [(-1, j, int(sums[j])) for j in range(d)]
            cells += [(i, j, int(products[i, j])) for i in range(d) for j in range(i, d)]
            parts = zip(*(limbs(v) for _, _, v in cells))
            yield pa.RecordBatch.from_arrays(
                [pa.array([c[0] for c in cells], pa.int32()), pa.array([c[1] for c in cells], pa.int32()),
                 *(pa.array(p, pa.int64()) for p in parts)],
                ["i", "j", *(f"l{k}" for k in range(LIMBS))],
            )

    fields = ", ".join(f"l{k} long" for k in range(LIMBS))
    cells = rows.select("v").mapInArrow(partial, f"i int, j int, {fields}")
    summed = cells.groupBy("i", "j").agg(*(F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS))).collect()
    value = {(r.i, r.j): sum(r[f"l{k}"] << LIMB * k for k in range(LIMBS)) for r in summed}
    n = value.get((-1, -1), 0)
    d = max((j for _, j in value), default=-1) + 1
    sums = [value[-1, j] for j in range(d)]
    return n, sums, [[n * value[min(i, j), max(i, j)] - sums[i] * sums[j] for j in range(d)] for i in range(d)]


def is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide every number below 3 * 10^9."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """Primes below 2^31, largest first, whose product is above ``bound``."""
    found, product, n = [], 1, (1 << 31) - 1
    while product <= bound:
        if is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of ``det(tI - matrix)`` modulo ``p``, lowest power first; p is below 2^31."""
    h = matrix.copy() % p
    d = len(h)
    for k in range(d - 2):
        rows = np.flatnonzero(h[k + 1:, k])
        if not len(rows):
            continue
        pivot = k + 1 + rows[0]
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        u = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        # Taking multiples of one row away from others is a similarity once the column takes them back.
        h[k + 2:] = (h[k + 2:] - u[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2:] * u % p).sum(axis=1)) % p
    # Leading minors of the Hessenberg form, each from those before it.
    minors = np.zeros((d + 1, d + 1), np.int64)
    minors[0, 0] = 1
    for k in range(1, d + 1):
        minors[k, 1:] = minors[k - 1, :-1]
        minors[k] -= h[k - 1, k - 1] * minors[k - 1] % p
        chain = 1
        for i in range(k - 1, 0, -1):
            chain = chain * int(h[i, i - 1]) % p
            if not chain:
                break
            minors[k] -= chain * int(h[i - 1, k - 1]) % p * minors[i - 1] % p
        minors[k] %= p
    return minors[d]


def characteristic(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Integer coefficients of ``det(tI - matrix)``, lowest power first; the matrix is a scatter matrix."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    # The roots are not negative, so a symmetric function is greatest when all are equal.
    bound = max(math.comb(d, k) * (trace // d + 1) ** k for k in range(d + 1))
    primes = primes_beyond(2 * bound + 1)

    def residues(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p in frame["p"]:
                p = int(p)
                reduced = np.array([[v % p for v in row] for row in matrix], np.int64)
                yield pd.DataFrame({"p": [p], "residues": [polynomial_modulo(reduced, p).tolist()]})

    listed = spark.createDataFrame(pd.DataFrame({"p": primes}), "p long").repartition(min(len(primes), spark.sparkContext.defaultParallelism))
    found = listed.mapInPandas(residues, "p long, residues array<long>").collect()
    product = math.prod(primes)
    coefficients = [0] * (d + 1)
    for row in found:
        rest = product // row.p
        weight = rest * pow(rest, -1, row.p)
        for k, r in enumerate(row.residues):
            coefficients[k] += r * weight
    # Signs alternate; the symmetric residue is the coefficient.
    return [c - product if (c := v % product) > product // 2 else c for v in coefficients]


def roots_above(coefficients: list[int], a: int) -> int:
    """How many roots of a polynomial with real roots only exceed ``a``, by the signs after a shift."""
    c = list(coefficients)
    d = len(c) - 1
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            c[j] += a * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def largest_roots(coefficients: list[int], count: int) -> list[Decimal]:
    """The largest positive roots with multiplicity, falling, with FRACTION bits behind the point."""
    d = len(coefficients) - 1
    scaled = [c << FRACTION * (d - k) for k, c in enumerate(coefficients)]
    positive = d - next(k for k, c in enumerate(coefficients) if c)
    high = max(1, -scaled[d - 1])  # the sum of all roots
    known: dict[int, int] = {0: positive, high: 0}

    def above(a: int) -> int:
        if a not in known:
            known[a] = roots_above(scaled, a)
        return known[a]

    def value(a: int) -> int:
        total = 0
        for c in reversed(scaled):
            total = total * a + c
        return total

    found = []
    for number in range(min(count, positive)):
        # The root with so many above it lies in (low, up]: above(low) > number >= above(up).
        low = max(a for a, n in known.items() if n > number)
        up = min(a for a, n in known.items() if n <= number)
        while up - low > 1 and not (above(low) == number + 1 and above(up) == number):
            middle = (low + up) // 2
            if above(middle) > number:
                low = middle
            else:
                up = middle
        # Alone between low and up: the sign of the polynomial is enough.
        sign = number % 2 == 0
        while up - low > 1:
            middle = (low + up) // 2
            v = value(middle)
            if v == 0:
                low = up = middle
            elif (v > 0) == sign:
                up = middle
            else:
                low = middle
        found.append(Context(prec=DIGITS).divide(Decimal(up), Decimal(1 << FRACTION)))
    return found


def null_vectors(matrix: list[list[int]], root: Decimal, count: int) -> list[list[Decimal]]:
    """``count`` orthonormal vectors of the null space of ``matrix - root``, by inverse iteration."""
    c = Context(prec=DIGITS)
    d = len(matrix)
    a = [[c.subtract(Decimal(v), root) if i == j else Decimal(v) for j, v in enumerate(row)] for i, row in enumerate(matrix)]
    tiny = c.scaleb(max(root, Decimal(1)), -(DIGITS - 5))
    order = list(range(d))
    for k in range(d):
        pivot = max(range(k, d), key=lambda i: abs(a[i][k]))
        a[k], a[pivot] = a[pivot], a[k]
        order[k], order[pivot] = order[pivot], order[k]
        if abs(a[k][k]) < tiny:
            a[k][k] = tiny
        for i in range(k + 1, d):
            if a[i][k]:
                f = c.divide(a[i][k], a[k][k])
                a[i][k] = f
                row, top = a[i], a[k]
                for j in range(k + 1, d):
                    row[j] = c.subtract(row[j], c.multiply(f, top[j]))

    def dot(u: list[Decimal], v: list[Decimal]) -> Decimal:
        total = Decimal(0)
        for x, y in zip(u, v):
            total = c.fma(x, y, total)
        return total

    def unit(v: list[Decimal]) -> list[Decimal]:
        length = c.sqrt(dot(v, v))
        return [c.divide(x, length) for x in v]

    found: list[list[Decimal]] = []
    for number in range(count):
        v = unit([Decimal(1 + (i * 7919 + number * 104_729) % 997) for i in range(d)])
        for _ in range(3):
            v = [v[i] for i in order]
            for i in range(d):
                for j in range(i):
                    v[i] = c.subtract(v[i], c.multiply(a[i][j], v[j]))
            for i in reversed(range(d)):
                for j in range(i + 1, d):
                    v[i] = c.subtract(v[i], c.multiply(a[i][j], v[j]))
                v[i] = c.divide(v[i], a[i][i])
            v = unit(v)
            for _twice in range(2):
                for u in found:
                    along = dot(u, v)
                    v = [c.subtract(x, c.multiply(along, y)) for x, y in zip(v, u)]
                v = unit(v)
        found.append(v)
    return found


def components(spark: SparkSession, matrix: list[list[int]], count: int = COMPONENTS) -> tuple[list[Decimal], np.ndarray]:
    """(roots, unit vectors as rows) of the largest positive roots; the largest entry is positive."""
    if not any(matrix[i][i] for i in range(len(matrix))):
        return [], np.zeros((0, len(matrix)))
    roots = largest_roots(characteristic(spark, matrix), count)
    groups: list[list[int]] = []
    for number, root in enumerate(roots):
        if groups and roots[groups[-1][-1]] - root <= CLOSE * roots[groups[-1][-1]]:
            groups[-1].append(number)
        else:
            groups.append([number])

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for first, root, size in zip(frame["first"], frame["root"], frame["size"]):
                for k, v in enumerate(null_vectors(matrix, Decimal(root), int(size))):
                    yield pd.DataFrame({"number": [int(first) + k], "v": [[float(x) for x in v]]})

    listed = spark.createDataFrame(
        [(g[0], str(roots[g[0]]), len(g)) for g in groups], "first int, root string, size int"
    ).repartition(len(groups), "first")
    found = {r.number: r.v for r in listed.mapInPandas(solve, "number int, v array<double>").collect()}
    vectors = np.array([found[k] for k in range(len(roots))])
    turn = np.sign(vectors[np.arange(len(roots)), np.abs(vectors).argmax(axis=1)])
    return roots, vectors * turn[:, None]


def whitened(vectors: DataFrame, count: int = COMPONENTS, column: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation decimal(38,0), whitened, explained, identity_error."""
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)["vec_id"]
    rows = usable(vectors, column)
    n, sums, matrix = scatter(rows)
    roots, directions = components(spark, matrix, count) if n else ([], np.zeros((0, 0)))
    if not roots:
        return spark.createDataFrame(
            [], f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        )
    # A root is n^2 times the variance along its component.
    spread = np.array([float(r.sqrt(Context(prec=40))) / n for r in roots])
    turned = (directions / spread[:, None]).T
    most = 10 ** 38

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = integers(batch)
            reach = n * max(abs(int(y.max())), abs(int(y.min()))) + max(map(abs, sums))
            if reach * reach * y.shape[1] < BOUND:
                z = y * n - np.array(sums, np.int64)
                deviation = pa.array((z * z).sum(axis=1)).cast(pa.decimal128(38, 0))
            else:
                z = y.astype(object) * n - np.array(sums, object)
                exact = [int(v) for v in (z * z).sum(axis=1)]
                deviation = pa.array([Decimal(v) if v < most else None for v in exact], pa.decimal128(38, 0))
            w = z.astype(np.float64) / n @ turned
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), deviation, pa.ListArray.from_arrays(
                    np.arange(0, w.size + 1, w.shape[1], dtype=np.int32), w.ravel())],
                ["vec_id", "deviation", "w"],
            )

    placed = stage(rows.mapInArrow(project, f"vec_id {kind}, deviation decimal(38,0), w array<double>"), "whitened")
    pairs = [(i, j) for i in range(len(roots)) for j in range(i, len(roots))]
    sums_w = [F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(len(roots))]
    products = [F.sum(F.col("w")[i] * F.col("w")[j]).alias(f"p{i}_{j}") for i, j in pairs]
    got = placed.agg(*sums_w, *products).first()
    error = max(
        abs(got[f"p{i}_{j}"] / n - got[f"s{i}"] / n * (got[f"s{j}"] / n) - (i == j)) for i, j in pairs
    )
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    share: Column = F.array(*(F.lit(float(r / trace)) for r in roots))
    return placed.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(share, F.col("at") + 1).alias("explained"), F.lit(float(error)).alias("identity_error"),
    )
