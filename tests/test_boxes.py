"""Suppression, matching and near-duplicate groups against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasift.functions.overlap import convex_overlap, quad_iou
from terrasift.operators import area, boxes, components
from terrasift.operators.area import radius_area


def _square(x, y, s=1.0):
    return [x, y, x + s, y, x + s, y + s, x, y + s]


def test_iou_known_values():
    a = np.array([_square(0, 0)] * 4, float).reshape(4, 4, 2)
    b = np.array([_square(0, 0), _square(5, 5), _square(0.5, 0), _square(1, 0)], float).reshape(4, 4, 2)
    assert quad_iou(a, b) == pytest.approx([1, 0, 1 / 3, 0])
    twisted = np.array([[0, 0, 1, 1, 1, 0, 0, 1]], float).reshape(1, 4, 2)
    assert quad_iou(a[:1], twisted) == pytest.approx([0])
    assert quad_iou(a[:1, ::-1], b[2:3]) == pytest.approx([1 / 3])


def test_overlap_by_sampling():
    rng = np.random.default_rng(0)
    for _ in range(20):
        t = rng.uniform(0, np.pi, 2)
        quads = []
        for angle in t:
            r = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
            base = np.array([[-1, -0.6], [1, -0.6], [1, 0.6], [-1, 0.6]])
            quads.append(base @ r.T + rng.uniform(-0.7, 0.7, 2))
        got = convex_overlap(quads[0][None], quads[1][None])[0]
        pts = rng.uniform(-3, 3, (200000, 2))

        def inside(q):
            e = np.roll(q, -1, 0) - q
            d = pts[:, None] - q[None]
            return (e[None, :, 0] * d[..., 1] - e[None, :, 1] * d[..., 0] >= 0).all(1)

        assert got == pytest.approx((inside(quads[0]) & inside(quads[1])).mean() * 36, abs=0.06)


def _scene(seed, n):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        hot = i < n * 0.6
        x, y = rng.integers(0, 3, 2) if hot else rng.integers(0, 200, 2)
        rows.append((int(rng.integers(0, 2)), i, [float(v) for v in _square(int(x), int(y), 6)], float(rng.integers(0, 20)) / 20, int(rng.integers(0, 2))))
    return rows


SCHEMA = "scene int, box_id int, xy array<double>, conf double, class_id int"


def _iou(a, b):
    ox = max(0, min(a[2], b[2]) - max(a[0], b[0]))
    oy = max(0, min(a[5], b[5]) - max(a[1], b[1]))
    return ox * oy / (72 - ox * oy)


@pytest.mark.parametrize("n", [60, 400])
def test_suppress(spark, n):
    rows = _scene(3, n)
    got = {(r.scene, r.box_id) for r in boxes.suppress(spark.createDataFrame(rows, SCHEMA), 0.4).collect()}
    want = {
        (r[0], r[1]) for r in rows
        if not any(
            q[0] == r[0] and (-q[3], q[1]) < (-r[3], r[1]) and _iou(q[2], r[2]) > 0.4 for q in rows
        )
    }
    assert got == want


def test_turned_boxes(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(80):
        angle, centre = rng.uniform(0, np.pi), rng.uniform(0, 8, 2)
        turn = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
        quad = np.array([[-3, -2], [3, -2], [3, 2], [-3, 2]]) @ turn.T + centre
        rows.append((0, i, [float(v) for v in quad.reshape(-1)], float(rng.uniform()), 0))
    df = spark.createDataFrame(rows, SCHEMA)
    quads = np.array([r[2] for r in rows]).reshape(-1, 4, 2)
    table = np.array([quad_iou(np.repeat(q[None], len(quads), 0), quads) for q in quads])
    got = {r.box_id for r in boxes.suppress(df, 0.4).collect()}
    assert got == {
        i for i in range(80) if not any(rows[j][3] > rows[i][3] and table[i, j] > 0.4 for j in range(80))
    }


@pytest.mark.parametrize("match, order", [
    (boxes.match_greedy, lambda r: (-r[3], r[1])),
    (boxes.best_overlap, lambda r: r[1]),
])
def test_one_to_one_matching(spark, match, order):
    preds, truths = _scene(4, 40), _scene(5, 40)
    matched = match(spark.createDataFrame(preds, SCHEMA), spark.createDataFrame(truths, SCHEMA), 0.5)
    got = {(r.scene, r.pred, r.truth) for r in matched.collect()}
    want, used = set(), set()
    for p in sorted(preds, key=order):
        options = [
            (_iou(p[2], t[2]), t[1]) for t in truths
            if t[0] == p[0] and t[4] == p[4] and (t[0], t[1]) not in used
        ]
        if options and max(options)[0] >= 0.5:
            used.add((p[0], max(options)[1]))
            want.add((p[0], p[1], max(options)[1]))
    assert got == want
    fp = boxes.false_positives(spark.createDataFrame(preds, SCHEMA), matched).count()
    assert fp == len(preds) - len(want)


def test_near_duplicates(spark):
    rng = np.random.default_rng(6)
    xy = np.concatenate([rng.uniform(0, 2500, (150, 2)), rng.uniform(100, 160, (150, 2)), [[2000 + 45.0 * i, 5000] for i in range(40)]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "id int, x double, y double")
    parent = list(range(len(xy)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(xy)):
        for j in range(i):
            if np.hypot(*(xy[i] - xy[j])) <= 50:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    for leaf in (4, 256):
        got = {r.id: r.component for r in components.near_duplicates(df, "id", 50.0, leaf).collect()}
        assert got == {i: find(i) for i in range(len(xy))}


def test_radius_area(spark):
    sites = spark.createDataFrame([(1, 0.0, 0.0), (2, 5000.0, 5000.0), (3, 1000.0, 0.0)], "id int, x double, y double")
    def ring(x, y, s):
        return ([(x, y), (x + s, y), (x + s, y + s), (x, y + s)],)
    polys = spark.createDataFrame(
        [ring(-100.0, -100.0, 200.0), ring(-100.0, -100.0, 200.0), ring(900.0, -5000.0, 10000.0)],
        "ring array<struct<x double, y double>>",
    )
    r = 1000.0
    gon = 32 * r * r * np.sin(2 * np.pi / 64)
    for leaf in (1, 256):
        got = {x.id: x.a for x in radius_area(sites, polys, "id", r, "a", leaf).collect()}
        assert got[2] == pytest.approx(gon / 2e6, rel=1e-9)
        segment = r * r * np.arccos(0.9) - 900 * np.sqrt(r * r - 900**2)
        assert got[1] == pytest.approx((80000 + segment) / 1e6, rel=0.01)
        assert got[3] == pytest.approx((gon / 2 + 100 * 1995) / 1e6 + 0.0, rel=0.03)


def test_circles_and_polygons_meet_inside_tasks(spark, monkeypatch):
    """No row per circle and polygon; a crowded leaf's points come in shares."""
    monkeypatch.setattr(area, "SHARE", 7)
    rng = np.random.default_rng(11)
    spots, homes = rng.uniform(0, 3000, (60, 2)), rng.uniform(0, 3000, (300, 2))
    squares = homes[:, None] + 150 * np.array([[0, 0], [1, 0], [1, 1], [0, 1]])
    sites = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(spots)] + [(-1, None, 1.0)], "id int, x double, y double")
    polys = spark.createDataFrame([([(float(x), float(y)) for x, y in q],) for q in squares], "ring array<struct<x double, y double>>")
    disc = 400 * np.stack([np.cos(2 * np.pi * np.arange(64) / 64), np.sin(2 * np.pi * np.arange(64) / 64)], axis=1)
    want = {i: convex_overlap(squares, np.repeat((disc + p)[None], 300, axis=0)).sum() / 1e6 for i, p in enumerate(spots)} | {-1: 0.0}
    for leaf in (20, 1024):
        out = radius_area(sites, polys, "id", 400.0, "a", leaf)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
        assert {r.id: r.a for r in out.collect()} == pytest.approx(want, rel=1e-9)


def test_concave_quads_match_a_raster():
    rng = np.random.default_rng(12)
    step = 0.02
    grid = np.stack(np.meshgrid(np.arange(-3, 3, step) + step / 2, np.arange(-3, 3, step) + step / 2), -1).reshape(-1, 2)

    def inside(q):
        odd = np.zeros(len(grid), bool)
        for p, r in zip(q, np.roll(q, -1, 0)):
            spans = (p[1] > grid[:, 1]) != (r[1] > grid[:, 1])
            with np.errstate(divide="ignore", invalid="ignore"):
                odd ^= spans & (grid[:, 0] < (r[0] - p[0]) * (grid[:, 1] - p[1]) / (r[1] - p[1]) + p[0])
        return odd

    darts = [np.array([[-1, -1], [1, -1], [0, -0.4], [0, 1.2]]), np.array([[0, 0], [2, 0], [2, 2], [1.6, 0.3]]), np.array([[-1, -1], [1, -1], [1, 1], [-1, 1]])]
    for _ in range(12):
        quads = []
        for shape in (darts[rng.integers(2)], darts[rng.integers(3)]):
            t = rng.uniform(0, 2 * np.pi)
            q = shape @ np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]]) + rng.uniform(-0.4, 0.4, 2)
            quads.append(q[::-1] if rng.random() < 0.5 else q)
        a, b = map(inside, quads)
        assert quad_iou(quads[0][None], quads[1][None])[0] == pytest.approx((a & b).sum() / max(1, (a | b).sum()), abs=0.02)


@pytest.mark.parametrize("quad", [
    [0, 0, 1, 1, 1, 0, 0, 1], [0, 0, 2, 0, 2, 2, 1, 0], [0, 0, 1, 0, 1, 0, 0, 1], [0, 0, 1, 0, 2, 0, 3, 0], [0, 0, 2, 0, -1, 0, 1, 1],
])
def test_quads_that_cross_or_touch_themselves_give_nothing(quad):
    square = np.array([_square(0, 0, 2)], float).reshape(1, 4, 2)
    assert quad_iou(np.array([quad], float).reshape(1, 4, 2), square)[0] == 0


def test_one_giant_box_leaves_small_cells(spark):
    rng = np.random.default_rng(2)
    rows = [(0, i, [float(v) for v in _square(*rng.uniform(0, 4000, 2), 6)], float(rng.random()), 0) for i in range(1200)]
    rows += [(0, 5000, [float(v) for v in _square(0, 0, 4000)], 0.99, 0), (0, 5001, [float(v) for v in _square(1, 1, 3999)], 0.5, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    wide = boxes._bounds(df)
    used = boxes.levels(wide)
    found = boxes.meetings(wide, wide.select("*"), "a", "b", ["scene"], used, (["box_id"], ["box_id"]))
    met = sum(p.count() for p in found)
    # All meet the giants, and otherwise only near ones: far fewer pairs than all with all.
    assert met < 4 * len(rows) + 3000
    got = {r.box_id for r in boxes.suppress(df, 0.3).collect()}
    quads = np.array([r[2] for r in rows]).reshape(-1, 4, 2)
    want = set()
    for i, r in enumerate(rows):
        over = quad_iou(np.repeat(quads[i][None], len(rows), 0), quads)
        if not any(over[j] > 0.3 and (-q[3], q[1]) < (-r[3], r[1]) for j, q in enumerate(rows)):
            want.add(r[1])
    assert got == want and 5001 not in got


def test_a_long_chain_is_matched_in_few_rounds(spark, monkeypatch):
    # Each prediction overlaps two truths; the order of the chain decides each next choice.
    preds = [(0, i, [float(v) for v in _square(4 * i + 1, 0, 6)], 1.0 - i / 1e4, 0) for i in range(600)]
    truths = [(0, i, [float(v) for v in _square(4 * i, 0, 6)], 0.0, 0) for i in range(600)]
    a, b = spark.createDataFrame(preds, SCHEMA), spark.createDataFrame(truths, SCHEMA)
    whole = {(r.pred, r.truth) for r in boxes.match_greedy(a, b, 0.3).collect()}
    assert whole == {(i, i) for i in range(600)}
    monkeypatch.setattr(boxes, "PASS", 50)
    assert {(r.pred, r.truth) for r in boxes.match_greedy(a, b, 0.3).collect()} == whole


def test_polygons_of_all_sizes_count(spark):
    rng = np.random.default_rng(3)
    sides = [0.5, 7.0, 60.0, 900.0, 30_000.0]
    rings, sites = [], [(i, *map(float, rng.uniform(-2000, 2000, 2))) for i in range(20)]
    for k in range(60):
        (x, y), s = rng.uniform(-2500, 2500, 2), sides[k % 5]
        rings.append(([(float(x), float(y)), (float(x + s), float(y)), (float(x + s), float(y + s)), (float(x), float(y + s))],))
    polys = spark.createDataFrame(rings, "ring array<struct<x double, y double>>")
    got = {r.id: r.a for r in radius_area(spark.createDataFrame(sites, "id int, x double, y double"), polys, "id", 800.0, "a").collect()}
    angle = 2 * np.pi * np.arange(64) / 64
    for i, x, y in sites:
        disc = np.stack([x + 800 * np.cos(angle), y + 800 * np.sin(angle)], axis=1)[None]
        want = sum(convex_overlap(np.array(r[0])[None], disc)[0] for r in rings) / 1e6
        assert got[i] == pytest.approx(want, rel=1e-9, abs=1e-12)
    assert radius_area(spark.createDataFrame(sites, "id int, x double, y double"), polys.limit(0), "id", 800.0, "a").filter("a = 0").count() == 20


def _quads(seed, scenes, each):
    """Turned and upright boxes, few to a scene, some without one."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(scenes * each):
        angle = rng.uniform(0, np.pi / 2) if i % 3 else 0.0
        turn = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
        corners = np.array([[-3, -2], [3, -2], [3, 2], [-3, 2]]) @ turn.T + rng.integers(0, 4, 2)
        rows.append((i % scenes if i % 7 else None, i, [float(v) for v in corners.ravel()], float(rng.integers(0, 6)), i % 2))
    return rows


def test_few_boxes_of_a_scene_meet_without_a_grid(spark, monkeypatch):
    def grid(*_):
        raise AssertionError("a grid for scenes of few boxes")

    monkeypatch.setattr(boxes, "at_home", grid)
    rows = _quads(5, 12, 9)
    df = spark.createDataFrame(rows, SCHEMA)

    def over(a, b):
        return quad_iou(*(np.array(v[2]).reshape(1, 4, 2) for v in (a, b)))[0]

    got = sorted((r.box_id, r.scene) for r in boxes.suppress(df, 0.3).collect())
    assert got == sorted((a[1], a[0]) for a in rows if not any(
        a[0] is not None and a[0] == b[0] and (-b[3], b[1]) < (-a[3], a[1]) and over(a, b) > 0.3 for b in rows))
    pairs = {(r.pred, r.truth) for r in boxes.candidate_pairs(df, df, 0.3).collect()}
    assert pairs == {(a[1], b[1]) for a in rows for b in rows if a[0] is not None and a[0] == b[0] and a[4] == b[4] and over(a, b) >= 0.3}
