"""Steps whose cost must not grow with a list, a batch or an exploded pixel."""

import unicodedata
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrasift.functions import geo, text
from terrasift.operators import imagery


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_quads_have_the_area_and_centroid_of_their_ring(spark):
    rows = [([0.0, 0.0, 4.0, 0.0, 4.0, 2.0, 0.0, 2.0],), ([1.0, 1.0, 3.0, 2.0, 2.5, 5.0, 0.5, 4.0],), ([1.0, 1.0, 1.0, 1.0, 4.0, 1.0, 1.0, 3.0],), ([2.0] * 8,), (None,)]
    df = spark.createDataFrame(rows, "xy array<double>")
    ring = df.withColumn("ring", F.expr("transform(sequence(0, 3), i -> named_struct('x', xy[2 * i], 'y', xy[2 * i + 1]))"))
    want = ring.filter("xy IS NOT NULL").select(*geo.ring_centroid(F.col("ring")), geo.ring_area(F.col("ring"))).collect()
    quads = df.select(*geo.quad_centroid("xy"), geo.quad_area("xy"))
    got = quads.collect()
    for a, b in zip(got, want):
        assert [None if v is None else pytest.approx(v) for v in b] == list(a)
    assert list(got[-1]) == [None] * 3 and "lambda" not in _plan(quads)


def test_alignment_compares_patches_without_a_row_per_pixel(spark):
    rng = np.random.default_rng(4)
    first = rng.integers(0, 256, (6, 8, 8))
    second = np.zeros_like(first)
    for i, (dx, dy) in enumerate([(0, 0), (1, 0), (-1, 1), (0, -1), (1, 1), (-1, -1)]):
        second[i] = np.roll(first[i], (dy, dx), (0, 1))
    first[5] = 9  # no variance: the histogram decides

    def table(patches):
        return spark.createDataFrame([(i, [int(v) for v in p.ravel()]) for i, p in enumerate(patches)] + [(9, None)], "chip int, px array<int>")

    best = imagery.best_alignment(table(first), table(second), 8)
    got = {r.chip: (r.dx, r.dy, r.compared_pixels) for r in best.collect()}
    assert {c: got[c] for c in range(5)} == {0: (0, 0, 64), 1: (1, 0, 56), 2: (-1, 1, 49), 3: (0, -1, 56), 4: (1, 1, 49)}
    assert sorted(got) == list(range(6)) and "Generate" not in _plan(best)


def test_texts_become_strings_few_at_a_time(monkeypatch):
    texts = [None, "", "é" * 1000, *["É \u0301ñ" * i for i in range(200)]]
    made, plain = [], pa.Array.to_pylist
    monkeypatch.setattr(text, "AT_ONCE", 2000)
    monkeypatch.setattr(text.F, "arrow_udf", lambda f, _: lambda column: f(iter([column])))
    monkeypatch.setattr(text, "pa", SimpleNamespace(**{**vars(pa), "concat_arrays": lambda parts: made.extend(len(p) for p in parts) or pa.concat_arrays(parts)}))
    (got,) = text._normal_form(pa.array(texts), "NFD")
    assert plain(got) == [None if t is None else unicodedata.normalize("NFD", t) for t in texts]
    assert len(made) > 20 and sum(made) == len(texts)


def test_folded_names(spark):
    df = spark.createDataFrame([(0, None), (1, ""), (2, "École \u0301 Ñu")], "i int, t string")
    assert {r.i: r.f for r in df.select("i", text.fold_name("t").alias("f")).collect()} == {0: None, 1: "", 2: "ecolenu"}
