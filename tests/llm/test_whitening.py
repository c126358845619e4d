"""Whitening against numpy, exact fractions and known polynomials."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import types as T

from terrasift.llm import whitening
from terrasift.llm.queries import QUERIES

# Names that the operator uses inside go along.
KIND = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("v", T.StringType()), T.StructField("w", T.LongType()), T.StructField("component", T.StringType()),
])


def frame(spark, vectors, start=0):
    rows = [(start + i, None if v is None else [None if x is None else float(x) for x in v], "x", 1, "y") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, KIND).repartition(3)


def plain(vectors):
    x = np.floor(1024 * np.array(vectors, np.float32).astype(float)) + 100_000
    centred = x - x.mean(axis=0)
    e, u = np.linalg.eigh(centred.T @ centred / len(x))
    keep = np.argsort(-e)[:8]
    return x, centred @ u[:, keep] / np.sqrt(e[keep]), e[keep] / e.sum()


def test_matches_numpy_and_exact_sums(spark):
    chance = np.random.default_rng(4)
    good = chance.normal(size=(300, 12)) * np.linspace(0.1, 1, 12)
    odd = [None, [], [None] * 12, [math.nan] * 12, [math.inf] + [0] * 11, [1.0] * 5]
    vectors = [*good, *odd, good[7]]
    got = whitening.whitened(frame(spark, vectors)).toPandas()
    used = [*good, good[7]]
    x, want, share = plain(used)
    ids = [*range(300), 306]
    assert sorted(set(got.vec_id)) == ids and set(got.n) == {301} and len(got) == 301 * 8
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    table = table * np.sign((table * want).sum(axis=0))
    assert np.abs(table - want).max() < 1e-9
    assert np.allclose(got.groupby("component").explained.first(), share, rtol=1e-9)
    assert set(got.identity_error) == {got.identity_error[0]} and got.identity_error[0] < 1e-9
    sums = x.sum(axis=0)
    exact = {i: sum((301 * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for i, row in zip(ids, x)}
    assert {r.vec_id: int(r.deviation) for r in got.itertuples()} == exact


def test_few_or_equal_vectors(spark):
    none = whitening.whitened(frame(spark, []))
    assert none.count() == 0 and none.columns[:2] == ["vec_id", "component"]
    assert whitening.whitened(frame(spark, [[1.0, 2.0]])).count() == 0
    assert whitening.whitened(frame(spark, [[1.0, 2.0]] * 5)).count() == 0
    # Two vectors span one direction.
    line = whitening.whitened(frame(spark, [[0.0, 0.0, 0.0], [1.0, 1.0, 0.0]])).collect()
    assert sorted(round(r.whitened, 9) for r in line) == [-1, 1] and {r.component for r in line} == {1}


def test_equal_roots_give_orthogonal_components(spark):
    # Corners of a cross: all variances are equal.
    cross = [[s if i == j else 0.0 for j in range(3)] for i in range(3) for s in (1.0, -1.0)]
    got = whitening.whitened(frame(spark, cross)).toPandas()
    assert set(got.component) == {1, 2, 3} and got.identity_error.max() < 1e-12
    assert np.allclose(got.explained, 1 / 3)


def test_entries_beyond_64_bits_stay_exact(spark):
    vectors = [[3e38, 1.0], [-3e38, 2.0], [1e10, 5.0], [2.5, -1e9]]
    got = whitening.whitened(frame(spark, vectors)).toPandas()
    assert got.identity_error.max() < 1e-6
    y = np.array([[5, 7, -3], [1 << 61, -(1 << 62), 9], [2, 1 << 40, -1]], np.int64)
    want = y.astype(object).T @ y.astype(object)
    assert (whitening.gram(y) == want).all()
    for value in (0, -1, 1, 1 << 200, -(1 << 200) + 3):
        assert sum(p << 31 * k for k, p in enumerate(whitening.limbs(value))) == value


def exact_polynomial(matrix):
    """Faddeev-LeVerrier in fractions, lowest power first."""
    d = len(matrix)
    m, out = [[Fraction(0)] * d for _ in range(d)], [Fraction(1)]
    for k in range(1, d + 1):
        for i in range(d):
            m[i][i] += out[-1]
        m = [[sum(matrix[i][t] * m[t][j] for t in range(d)) for j in range(d)] for i in range(d)]
        out.append(-sum(m[i][i] for i in range(d)) / k)
    return [int(c) for c in reversed(out)]


@pytest.mark.parametrize("d", [1, 2, 3, 7])
def test_characteristic_polynomial_is_exact(spark, d):
    chance = np.random.default_rng(d)
    y = chance.integers(-10**6, 10**6, (20, d)).astype(object)
    matrix = (y.T @ y).tolist()
    assert whitening.characteristic(spark, matrix) == exact_polynomial(matrix)
    sparse = [[0, 2, 0], [2, 0, 0], [0, 0, 5]]
    p = 1_000_003
    assert [int(c) for c in whitening.polynomial_modulo(np.array(sparse), p)] == [c % p for c in exact_polynomial(sparse)]


def test_roots_are_counted_and_refined():
    # (t - 2)^2 (t - 7) t
    coefficients = [0, -28, 32, -11, 1]
    assert [whitening.roots_above(coefficients, a) for a in (0, 1, 2, 6, 7)] == [3, 3, 1, 1, 0]
    roots = whitening.largest_roots(coefficients, 8)
    assert [round(float(r), 12) for r in roots] == [7, 2, 2]
    near = whitening.largest_roots([2 * 3 - 1, -5, 1], 2)  # (5 +- sqrt 5) / 2
    assert abs(near[0] - (5 + near[0].__class__(5).sqrt()) / 2) < near[0].__class__("1e-25")


def test_query_over_its_table(spark):
    got = QUERIES["op13_whitening"](spark, "/root/testdata/sf0.001").toPandas()
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").toPandas()
    x, want, share = plain(vectors.embedding.tolist())
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[vectors.vec_id].to_numpy()
    assert np.abs(table * np.sign((table * want).sum(axis=0)) - want).max() < 1e-8
    assert got.deviation.dtype == np.int64 and got.identity_error.max() <= 1e-4
