"""Polygon cells against plain ray casting, and clipped lines against dense sampling."""

import numpy as np
import pytest

from terrasift.operators import polygons

RINGS = "name string, rings array<array<struct<x double, y double>>>"


def star(n, seed, centre=(0.0, 0.0), low=0.4, high=1.0):
    rng = np.random.default_rng(seed)
    angle = np.sort(rng.uniform(0, 2 * np.pi, n))
    r = rng.uniform(low, high, n)
    return np.stack([centre[0] + r * np.cos(angle), centre[1] + r * np.sin(angle)], axis=1)


def inside(rings, points):
    odd = np.zeros(len(points), bool)
    for ring in rings:
        for p, q in zip(ring, np.roll(ring, -1, 0)):
            spans = (p[1] > points[:, 1]) != (q[1] > points[:, 1])
            with np.errstate(divide="ignore", invalid="ignore"):
                odd ^= spans & (points[:, 0] < (q[0] - p[0]) * (points[:, 1] - p[1]) / (q[1] - p[1]) + p[0])
    return odd


def frame(spark, named):
    return spark.createDataFrame([(n, [[(float(x), float(y)) for x, y in r] for r in rings]) for n, rings in named.items()], RINGS)


SHAPES = {
    "star": [star(400, 1)],
    "ring": [star(60, 2, (2.5, 0.3), 0.8, 1.0), star(40, 3, (2.5, 0.3), 0.2, 0.5)],
    "square": [np.array([[-3, -3], [-1, -3], [-1, -1], [-3, -1]])],
    "parts": [star(30, 4, (-2, 2)), star(30, 5, (0.5, 2.6))[::-1]],
}


@pytest.mark.parametrize("most", [4, 48])
def test_points_match_ray_casting(spark, most):
    index = polygons.cells(frame(spark, SHAPES), ["name"], most)
    assert max(len(r._edges) for r in index.collect()) <= most
    rng = np.random.default_rng(7)
    points = np.concatenate([rng.uniform(-4, 4, (1500, 2)), SHAPES["star"][0] * 0.999, SHAPES["star"][0] * 1.001])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)] + [(-1, None, 1.0)], "id int, lon double, lat double")
    got = {r.id: r._hit.name for r in polygons.containing(df, index, "id", ["name"]).collect()}
    want = {}
    for name in sorted(SHAPES, reverse=True):
        want |= {int(i): name for i in np.flatnonzero(inside(SHAPES[name], points))}
    assert got == want


def test_border_points_are_not_inside(spark):
    index = polygons.cells(frame(spark, {"square": [np.array([[0, 0], [2, 0], [2, 2], [0, 2]])]}), ["name"])
    df = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 2.0, 1.0), (3, 1.0, 1.0), (4, 0.5, 1.9), (5, 2.5, 1.0)], "id int, lon double, lat double")
    assert {r.id for r in polygons.containing(df, index, "id", ["name"]).collect()} == {3, 4}
    assert polygons.cells(frame(spark, {}), ["name"]).count() == 0


@pytest.mark.parametrize("most", [4, 48])
def test_lines_are_cut_at_the_border(spark, most):
    index = polygons.cells(frame(spark, SHAPES), ["name"], most)
    rng = np.random.default_rng(8)
    lines = {i: rng.uniform(-4, 4, (rng.integers(2, 6), 2)) for i in range(25)}
    lines[25] = np.array([[-4.0, -2.0], [4.0, -2.0]])
    lines[26] = np.array([[-2.0, -4.0], [-2.0, 4.0]])
    lines[27] = np.array([[-2.5, -2.5], [-1.5, -2.5], [-1.5, -1.5]])
    df = spark.createDataFrame([(i, [(float(x), float(y)) for x, y in p]) for i, p in lines.items()] + [(99, [(0.0, 0.0)])], "id int, path array<struct<x double, y double>>")
    got = {}
    for r in polygons.clip_lines(df, index, "id", ["name"]).collect():
        path = np.array([(p.x, p.y) for p in r.path])
        got.setdefault((r.id, r.name), []).append(np.hypot(*np.diff(path, axis=0).T).sum())
        assert inside(SHAPES[r.name], (path[:-1] + path[1:]) / 2).all()
    for i, line in lines.items():
        for name, rings in SHAPES.items():
            total = 0.0
            for p, q in zip(line, line[1:]):
                t = (np.arange(20_000) + 0.5)[:, None] / 20_000
                total += inside(rings, p + t * (q - p)).mean() * np.hypot(*(q - p))
            assert sum(got.get((i, name), [0.0])) == pytest.approx(total, abs=5e-3), (i, name)
    # A line that stays inside comes back whole, in one piece.
    assert got[27, "square"] == [pytest.approx(2.0)]


def test_points_on_an_edge_go_by_the_even_odd_count(spark):
    border = [(89.55, 23.05), (90.1, 23.1), (90.0, 23.65), (89.6, 23.6)]
    area = frame(spark, {"pilot": [np.array(border)]})
    df = spark.createDataFrame([(1, 89.64512, 23.60564), (2, 89.64512, 23.60565), (3, 89.7, 23.3)], "id int, lon double, lat double")
    got = polygons.point_in_polygon(df, area, "id", ["name"], how="left_semi", strict=False)
    assert {r.id for r in got.collect()} == {1, 3}
    halves = frame(spark, {"left": [np.array([[0, 0], [1, 0], [1, 2], [0, 2]])], "right": [np.array([[1, 0], [2, 0], [2, 2], [1, 2]])]})
    shared = spark.createDataFrame([(0, 1.0, 0.5), (1, 1.0, 1.5), (2, 0.0, 0.0), (3, 2.0, 1.0)], "id int, lon double, lat double")
    got = polygons.point_in_polygon(shared, halves, "id", ["name"], strict=False).collect()
    assert {r.id: r.name for r in got} == {0: "right", 1: "right", 2: "left", 3: None}


def test_polygons_under_a_smaller_record_are_not_looked_at(spark, monkeypatch):
    rng = np.random.default_rng(9)
    corners, sides = rng.uniform(0, 20, (600, 2)), rng.uniform(1, 6, (600, 1, 1))
    squares = {f"{i:03d}": [q] for i, q in enumerate(corners[:, None] + sides * np.array([[0, 0], [1, 0], [1, 1], [0, 1]]))}
    squares |= {f"{i + 600:03d}": squares["007"] for i in range(50)}
    index = polygons.cells(frame(spark, squares), ["name"])
    points = rng.uniform(-1, 27, (800, 2))
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "id int, lon double, lat double")
    got = {r.id: r._hit.name for r in polygons.containing(df, index, "id", ["name"]).collect()}
    want = {}
    for name in sorted(squares, reverse=True):
        want |= {int(i): name for i in np.flatnonzero(inside(squares[name], points))}
    assert got == want and 400 < len(want) < 800

    def pairs(of):
        met = [np.floor(points / 2.0**level) for level in range(-6, 6)]
        cells = {}
        for r in of.collect():
            cells[r._level, r._cx, r._cy] = cells.get((r._level, r._cx, r._cy), 0) + 1
        return sum(cells.get((level, *c), 0) for level, m in zip(range(-6, 6), met) for c in m.astype(int).tolist())

    assert pairs(polygons.thinned(index, ["name"])) < pairs(index) / 5
    # Where nothing is hidden, quartering ends.
    monkeypatch.setattr(polygons, "GROWN", 1)
    slivers = {f"{i}": [np.array([[0, 0], [9, i], [9, i + 0.5]])] for i in range(40)}
    index = polygons.cells(frame(spark, slivers), ["name"])
    assert {r.id: r._hit.name for r in polygons.containing(df, index, "id", ["name"]).collect()} == {
        int(i): name for name in sorted(slivers, reverse=True) for i in np.flatnonzero(inside(slivers[name], points))
    }
