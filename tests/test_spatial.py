"""Grid joins against brute force, including one hot spot holding most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrasift.functions import geo, overlap
from terrasift.operators import polygons, spatial


def _cloud(seed, n, hot):
    rng = np.random.default_rng(seed)
    xy = rng.uniform(0, 20000, (n, 2))
    xy[: int(n * hot)] = rng.uniform(5000, 5030, (int(n * hot), 2))
    xy[: n // 10] = (5010.0, 5010.0)
    return pd.DataFrame({"id": np.arange(n), "x": xy[:, 0], "y": xy[:, 1], "g": rng.integers(0, 2, n)})


@pytest.fixture(scope="module")
def clouds(spark):
    left, right = _cloud(1, 300, 0.4), _cloud(2, 800, 0.5)
    return left, right, spark.createDataFrame(left), spark.createDataFrame(right).withColumnRenamed("id", "fid")


@pytest.mark.parametrize("leaf", [16, 100000])
@pytest.mark.parametrize("reach", [None, 900.0])
@pytest.mark.parametrize("metric", ["euclidean", "chebyshev"])
def test_nearest(clouds, leaf, reach, metric):
    left, right, ldf, rdf = clouds
    got = spatial.nearest(ldf, rdf, "id", ["fid"], ["g"], reach, metric, leaf=leaf).toPandas()
    assert len(got) == len(left)
    got = got.set_index("id")
    for row in left.itertuples():
        part = right[right.g == row.g]
        dx, dy = (part.x - row.x).abs(), (part.y - row.y).abs()
        d = np.sqrt(dx * dx + dy * dy) if metric == "euclidean" else np.maximum(dx, dy)
        if reach is not None and d.min() > reach:
            assert pd.isna(got.loc[row.id, "distance"])
            continue
        assert got.loc[row.id, "distance"] == pytest.approx(d.min(), abs=1e-9)
        assert got.loc[row.id, "fid"] == part.id[d == d.min()].min()


@pytest.mark.parametrize("leaf", [16, 100000])
def test_nearest_without_groups(clouds, leaf):
    left, right, ldf, rdf = clouds
    got = spatial.nearest(ldf, rdf.drop("g"), "id", ["fid"], leaf=leaf).toPandas().set_index("id")
    for row in left.itertuples():
        d = np.hypot(right.x - row.x, right.y - row.y).min()
        assert got.loc[row.id, "distance"] == pytest.approx(d, abs=1e-9)


@pytest.mark.parametrize("leaf", [16, 100000])
@pytest.mark.parametrize("radius", [12.0, 700.0])
def test_radius_count(clouds, leaf, radius):
    left, right, ldf, rdf = clouds
    got = spatial.radius_count(ldf, rdf.drop("g"), "id", radius, leaf=leaf).toPandas().set_index("id")
    for row in left.itertuples():
        d = np.sqrt((right.x - row.x) ** 2 + (right.y - row.y) ** 2)
        assert got.loc[row.id, "n"] == (d <= radius).sum()


def test_segments(spark):
    left = spark.createDataFrame([(1, 0.0, 5.0), (2, 30.0, 0.0), (3, None, 1.0)], "id int, x double, y double")
    rail = spark.createDataFrame(
        [("a", -10.0, 0.0, 10.0, 0.0), ("b", 20.0, 3.0, 20.0, 3.0)],
        "name string, x1 double, y1 double, x2 double, y2 double",
    )
    got = {r.id: r for r in spatial.nearest(left, rail, "id", ["name"], shape="segment").collect()}
    assert (got[1].distance, got[1].name) == (5.0, "a")
    assert got[2].distance == pytest.approx(np.sqrt(109)) and got[2].name == "b"
    assert got[3].distance is None


def test_empty_side(spark, clouds):
    ldf = clouds[2]
    none = clouds[3].filter("false")
    assert spatial.nearest(ldf, none, "id", ["fid"], ["g"]).filter("distance is not null").count() == 0
    assert spatial.nearest(ldf, none.drop("g"), "id", ["fid"]).filter("distance is null").count() == 300
    assert spatial.nearest(ldf, none.drop("g"), "id", ["fid"], reach=5.0).filter("distance is null").count() == 300
    assert spatial.radius_count(ldf, none.drop("g"), "id", 10.0).filter("n = 0").count() == 300


def test_point_in_polygon_with_hole(spark):
    ring = lambda pts: [(float(a), float(b)) for a, b in pts]
    polys = spark.createDataFrame(
        [
            ("donut", [ring([(0, 0), (4, 0), (4, 4), (0, 4)]), ring([(1, 1), (3, 1), (3, 3), (1, 3)])]),
            ("tri", [ring([(10, 0), (14, 0), (12, 5)])]),
        ],
        "name string, rings array<array<struct<x double, y double>>>",
    )
    pts = spark.createDataFrame(
        [(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 12.0, 1.0), (4, 10.1, 4.0), (5, 3.5, 3.9)],
        "id int, lon double, lat double",
    )
    for most in (1, 3, 48):
        got = {r.id: r.name for r in polygons.point_in_polygon(pts, polys, "id", ["name"], most=most).collect()}
        assert got == {1: "donut", 2: None, 3: "tri", 4: None, 5: "donut"}


def test_projection_axis_and_meridian(spark):
    df = spark.createDataFrame([(24.0, 90.0), (24.3, 91.7), (24.3001, 91.7), (24.3, 91.7001)], "lat double, lon double")
    rows = geo.project(df).collect()
    assert rows[0].x == pytest.approx(500000.0, abs=1e-6)
    # Meridian arc to 24 N on WGS84 by quadrature, times the scale factor.
    phi = np.radians(np.linspace(0, 24, 200001))
    e2 = geo.WGS84_F * (2 - geo.WGS84_F)
    arc = geo.WGS84_A * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5
    assert rows[0].y == pytest.approx(np.trapezoid(arc, phi) * geo.SCALE, abs=1e-3)
    north = (rows[2].x - rows[1].x, rows[2].y - rows[1].y)
    east = (rows[3].x - rows[1].x, rows[3].y - rows[1].y)
    cosine = np.dot(north, east) / np.linalg.norm(north) / np.linalg.norm(east)
    assert abs(cosine) < 1e-5
    assert geo.project_point(24.3, 91.7) == pytest.approx((rows[1].x, rows[1].y), abs=1e-6)


def test_centroid_and_area(spark):
    df = spark.createDataFrame(
        [([(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0)],)], "ring array<struct<x double, y double>>"
    )
    cx, cy = geo.ring_centroid(F.col("ring"))
    row = df.select(cx.alias("cx"), cy.alias("cy"), geo.ring_area(F.col("ring")).alias("a")).first()
    assert (row.cx, row.cy, row.a) == (2.0, 1.0, 8.0)


def test_searching_rows_are_not_broadcast(spark):
    """Exploded rows and collected lists are larger than their estimate: none goes through the driver."""
    rng = np.random.default_rng(3)
    pts = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 100, (400, 2)))], "id int, x double, y double")
    counted = spatial.radius_count(pts, pts.select("x", "y"), "id", 5.0, leaf=4)
    near = spatial.nearest(pts, pts.selectExpr("id AS other", "x", "y"), "id", ["other"], reach=5.0, leaf=4)
    for df in (counted, near):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    got = {r.id: r.n for r in counted.collect()}
    xy = np.array([(r.x, r.y) for r in pts.orderBy("id").collect()])
    assert got == {i: int((np.hypot(*(xy - p).T) <= 5.0).sum()) for i, p in enumerate(xy)}


def test_circle_share_of_edges_equals_clipped_polygons():
    rng = np.random.default_rng(5)
    angle = -2 * np.pi * np.arange(overlap.CIRCLE_SIDES) / overlap.CIRCLE_SIDES
    disc = np.stack([np.cos(angle), np.sin(angle)], axis=1)
    turn = np.sort(rng.uniform(0, 2 * np.pi, (500, 5)), axis=1)
    poly = rng.uniform(-1.5, 1.5, (500, 1, 2)) + rng.uniform(0.05, 2, (500, 1, 1)) * np.stack([np.cos(turn), np.sin(turn)], axis=2)
    share = overlap._disc_share(poly.reshape(-1, 2), np.roll(poly, -1, axis=1).reshape(-1, 2)).reshape(500, 5).sum(axis=1)
    assert np.abs(share - overlap.convex_overlap(poly, np.repeat(disc[None], 500, axis=0))).max() < 1e-12
    far = np.array([[[-9.0, -9], [9, -9], [9, 9], [-9, 9]], [[2, 2], [3, 2], [3, 3], [2, 3]], [[0, 0], [0, 0], [0, 0], [0, 0]]])
    share = overlap._disc_share(far.reshape(-1, 2), np.roll(far, -1, axis=1).reshape(-1, 2)).reshape(3, 4).sum(axis=1)
    assert np.abs(share - [overlap.CIRCLE_SIDES / 2 * np.sin(2 * np.pi / overlap.CIRCLE_SIDES), 0, 0]).max() < 1e-12


@pytest.mark.parametrize("reach", [None, 60.0])
def test_rows_of_a_cell_walk_as_one_box(spark, monkeypatch, reach):
    rng = np.random.default_rng(7)
    feats = rng.uniform(-500, 500, (300, 2))
    rows = np.concatenate([rng.uniform(-1, 1, (1000, 2)) + spot for spot in ((30, -30), (-200, 480), (2000, 0))])
    right = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(feats)], "fid int, x double, y double")
    left = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rows)] + [(-1, float("nan"), 30.0)], "id int, x double, y double")
    walked, step = [], spatial._open
    monkeypatch.setattr(spatial, "_open", lambda joined, *args: walked.append(joined.count()) or step(joined, *args))
    got = {r.id: r for r in spatial.nearest(left, right, "id", ["fid"], reach=reach, leaf=8).collect()}
    # Only the last step, from a cell's leaves to the leaves of each row, is taken by rows.
    assert len(walked) > 1 and max(walked[:-1]) < 300
    d = np.hypot(*(rows[:, None] - feats[None]).transpose(2, 0, 1))
    assert len(got) == 3001 and got[-1].distance is None
    for i, near in enumerate(d):
        want = near.argmin() if reach is None or near.min() <= reach else None
        assert got[i].fid == want and (want is None or got[i].distance == pytest.approx(near[want], abs=1e-9))


def test_corners_on_the_border_of_a_circle():
    angle = 2 * np.pi * np.arange(overlap.CIRCLE_SIDES) / overlap.CIRCLE_SIDES
    disc = np.stack([np.cos(angle), np.sin(angle)], axis=1)
    rng = np.random.default_rng(6)
    on = disc[np.stack([np.sort(rng.permutation(64)[:4]) for _ in range(400)])] * rng.choice([1.0, 1.0, 2.0, 0.5], (400, 1, 1))
    snapped = np.round(rng.uniform(-2, 2, (400, 4, 2)) * 4) / 4
    poly = np.concatenate([on, snapped])
    poly = poly[overlap.is_convex(poly) & (np.abs(poly - np.roll(poly, 1, axis=1)).max(axis=2) > 0).all(axis=1)]
    n, copies = len(poly), np.full(len(poly), 2.0)
    boxes = np.stack([poly[..., 0].min(axis=1), poly[..., 1].min(axis=1), poly[..., 0].max(axis=1), poly[..., 1].max(axis=1)])
    assert n > 300
    for k in range(n):
        areas = np.stack([overlap.polygon_area(poly[k:k + 1]) * 2, copies[:1]])
        got = overlap.discs_overlap(np.zeros(1), np.zeros(1), 1.0, poly[k], np.array([4]), boxes[:, k:k + 1], areas)[0]
        assert got == pytest.approx(2 * overlap.convex_overlap(poly[k:k + 1], disc[None])[0], abs=1e-11), poly[k]
    x, y = rng.uniform(-2, 2, (2, 30))
    got = overlap.discs_overlap(x, y, 0.7, poly.reshape(-1, 2), np.full(n, 4), boxes, np.stack([overlap.polygon_area(poly) * 2 / 0.49, copies]))
    for i in range(30):
        want = 2 * overlap.convex_overlap(poly, np.repeat(disc[None] * 0.7 + [x[i], y[i]], n, axis=0)).sum()
        assert got[i] == pytest.approx(want, rel=1e-11)
