"""Spatial joins: nearest, within a radius, counts, point in polygon.

The searched side is summarised as a hierarchy of grid cells, each holding the tight box of
its features, down to leaves of at most ``LEAF`` distinct features. The searching side
walks down the hierarchy: every level is an equi-join to one row per cell, followed by pruning
on box distances, so a cell (or copies at one spot) holding a third of the features is never
paired row by row with the searching side. For the nearest feature the searching rows of a
finest cell walk as one box, and rows only meet the leaves found for it. All results are exact.

How deep the hierarchy goes is read off the data (one small aggregate per level); small
tables need no levels and become a single join to one row per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.session import cut_lineage

LEAF = 32
BITS = 2
FAN = 1 << BITS  # a cell splits into FAN x FAN children
MIN_CELL = 1e-6
SLACK = 1 + 1e-12  # pruning bounds are widened by rounding error, never the results

METRICS = {
    "euclidean": "sqrt(({0} - {2}) * ({0} - {2}) + ({1} - {3}) * ({1} - {3}))",
    "chebyshev": "greatest(abs({0} - {2}), abs({1} - {3}))",
}
_NORMS = {"euclidean": "hypot({}, {})", "chebyshev": "greatest({}, {})"}


#: Corners of what searches: a row, or the box around the rows of a cell.
ROW = ("_px", "_py", "_px", "_py")
BOX = ("_wx0", "_wy0", "_wx1", "_wy1")


def box_low(b: str, metric: str = "euclidean", of: Sequence[str] = ROW) -> str:
    """Smallest distance from a searching row or box to a box."""
    x0, y0, x1, y1 = of
    return _NORMS[metric].format(
        f"greatest(0D, {b}.x0 - {x1}, {x0} - {b}.x1)", f"greatest(0D, {b}.y0 - {y1}, {y0} - {b}.y1)"
    )


def box_high(b: str, metric: str = "euclidean", of: Sequence[str] = ROW) -> str:
    """Largest distance from a searching row or box to a box: some feature is at most this far."""
    x0, y0, x1, y1 = of
    return _NORMS[metric].format(f"greatest({x1} - {b}.x0, {b}.x1 - {x0})", f"greatest({y1} - {b}.y0, {b}.y1 - {y0})")


def met(rows: DataFrame, cells: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join of searching rows and cells by shuffles on both sides.

    Rows and lists that were exploded or collected outgrow Spark's estimate of them many times,
    so neither side is left to a broadcast, which would pass it whole through the driver.
    """
    return rows.join(cells.hint("merge"), list(on), how)


class Grid:
    """Hierarchy over the searched side; ``sizes`` runs from coarse to fine."""

    def __init__(self, points: DataFrame, on: Sequence[str], sizes: list[float], fields: list[str]):
        self.points, self.on, self.sizes, self.fields = points, list(on), sizes, fields
        self.last = len(sizes) - 1
        self._written = None

    def placed(self, rows: DataFrame, x: str, y: str, cx: str = "_cx", cy: str = "_cy") -> DataFrame:
        """Rows with the index of their finest cell."""
        fine = f"{self.sizes[-1]!r}D"
        return rows.selectExpr("*", f"floor({x} / {fine}) AS {cx}", f"floor({y} / {fine}) AS {cy}")

    def above(self, c: str) -> str:
        """Index at ``_level`` of a finest index, so levels nest exactly."""
        return f"shiftright({c}, {BITS} * ({self.last} - _level))"

    def leaves(self) -> DataFrame:
        """``on, cell -> _pts``: the features of every finest cell (at most a leaf's worth)."""
        return self.placed(self.points, "_mx", "_my").groupBy(*self.on, "_cx", "_cy").agg(
            F.expr(f"collect_list(struct({', '.join(self.fields)})) AS _pts")
        )

    def children(self, level: int) -> DataFrame:
        """``on, cell at level -> boxes of its children`` (at most FAN squared)."""
        up = self.boxes().filter(f"_level = {level + 1}").selectExpr(
            *self.on, f"shiftright(_cx, {BITS}) AS _cx", f"shiftright(_cy, {BITS}) AS _cy", "_box"
        )
        return up.groupBy(*self.on, "_cx", "_cy").agg(F.expr("collect_list(_box) AS _boxes"))

    def roots(self) -> DataFrame:
        """``on -> boxes of the coarsest cells`` (a handful, as they span the extent)."""
        return self.boxes().filter("_level = 0").groupBy(*self.on).agg(F.expr("collect_list(_box) AS _boxes"))

    def boxes(self) -> DataFrame:
        """``on, _level, cell -> _box``: the box and weight of every cell, written once."""
        if self._written is None:
            around = [f"{f}({c}) AS {c}" for f, c in (("min", "_x0"), ("min", "_y0"), ("max", "_x1"), ("max", "_y1"), ("sum", "_w"))]
            fine = self.placed(self.points, "_mx", "_my").groupBy(*self.on, "_cx", "_cy").agg(*map(F.expr, around))
            levels = fine.selectExpr("*", f"explode(sequence(0, {self.last})) AS _level").withColumns(
                {c: F.expr(self.above(c)) for c in ("_cx", "_cy")}
            )
            cells = levels.groupBy(*self.on, "_level", "_cx", "_cy").agg(*map(F.expr, around))
            box = "named_struct('cx', _cx, 'cy', _cy, 'x0', _x0, 'y0', _y0, 'x1', _x1, 'y1', _y1, 'w', _w) AS _box"
            self._written = cut_lineage(cells.selectExpr(*self.on, "_level", "_cx", "_cy", box), "cells")
        return self._written


def _searched(
    right: DataFrame, on: Sequence[str], shape: str, payload: Sequence[str]
) -> tuple[DataFrame, list[str]]:
    """Distinct geometries per group with their box, written once; copies collapse here."""
    coords = ["x", "y"] if shape == "point" else ["x1", "y1", "x2", "y2"]
    valid = right.filter(" AND ".join(f"{c} IS NOT NULL" for c in [*coords, *on]))
    best = [F.expr(f"min(struct({', '.join(payload)})) AS _pay")] if payload else []
    unique = valid.groupBy(*on, *coords).agg(*best, F.expr("count(1) AS _w"))
    ax, ay, bx, by = coords if shape != "point" else ["x", "y", "x", "y"]
    boxed = unique.selectExpr(
        "*", f"({ax} + {bx}) / 2 AS _mx", f"({ay} + {by}) / 2 AS _my",
        f"least({ax}, {bx}, {ax}) AS _x0", f"least({ay}, {by}, {ay}) AS _y0",
        f"greatest({ax}, {bx}, {ax}) AS _x1", f"greatest({ay}, {by}, {ay}) AS _y1",
    )
    return cut_lineage(boxed, "searched"), coords + (["_pay"] if payload else [])


def plan_sizes(points: DataFrame, on: Sequence[str], start: float | None, leaf: int) -> list[float]:
    """Cell sizes needed so that no leaf holds more than ``leaf`` distinct geometries.

    Empty when whole groups already fit and no ``start`` size is given.
    """
    if start is None:
        groups = points.groupBy(*on).agg(
            F.expr("count(1) AS n"), F.expr("min(_mx) AS a"), F.expr("max(_mx) AS b"),
            F.expr("min(_my) AS c"), F.expr("max(_my) AS d"),
        )
        n, a, b, c, d = groups.selectExpr("max(n)", "min(a)", "max(b)", "min(c)", "max(d)").first()
        if (n or 0) <= leaf:
            return []
        start = max(b - a, d - c, MIN_CELL)
    sizes = [start]
    while sizes[-1] / FAN > MIN_CELL:
        cells = points.groupBy(*on, F.expr(f"floor(_mx / {sizes[-1]!r}D)"), F.expr(f"floor(_my / {sizes[-1]!r}D)"))
        if (cells.count().selectExpr("max(count)").first()[0] or 0) <= leaf:
            break
        sizes.append(sizes[-1] / FAN)
    return sizes


def around(rows: DataFrame, size: float, reach: float, of: Sequence[str] = ROW) -> DataFrame:
    """Pair searching rows (boxes) with the at most four (nine) cells their reach touches."""
    x0, y0, x1, y1 = of
    span = "explode(sequence(floor(({0} - {1!r}D) / {2!r}D), floor(({3} + {1!r}D) / {2!r}D))) AS {4}"
    return rows.selectExpr("*", span.format(x0, float(reach), size, x1, "_cx")).selectExpr(
        "*", span.format(y0, float(reach), size, y1, "_cy")
    )


def _capped(cells: DataFrame, grid: Grid, metric: str) -> DataFrame:
    """Tighten ``_cap``, a distance within which some feature is known to lie.

    A searching cell is looked up at every level, in one left join: if it or a cell above it
    holds a feature, that feature is no further than the far corner of the box.
    """
    own = cells.selectExpr("*", f"explode(sequence(0, {grid.last})) AS _level").selectExpr(
        "*", f"{grid.above('_ox')} AS _cx", f"{grid.above('_oy')} AS _cy"
    )
    looked = met(own, grid.boxes(), [*grid.on, "_level", "_cx", "_cy"], "left")
    high = f"min({SLACK!r}D * {box_high('_box', metric, BOX)})"
    return looked.groupBy(*grid.on, "_ox", "_oy", *BOX).agg(F.expr(f"least(min(_cap), {high}) AS _cap"))


def _open(joined: DataFrame, metric: str, of: Sequence[str]) -> DataFrame:
    """One row per box that may hold something within ``_cap``.

    Every box holds a feature, so the boxes' own far corners bound the search as well: rows
    whose own cell is empty, or that lie outside all cells, open a few boxes only.
    """
    nearest = f"array_min(transform(_boxes, b -> {box_high('b', metric, of)}))"
    return (
        joined.selectExpr("*", f"least(_cap, {SLACK!r}D * {nearest}) AS _new")
        .drop("_cap")
        .withColumnRenamed("_new", "_cap")
        .selectExpr("*", "explode(_boxes) AS _box")
        .drop("_boxes")
        .filter(f"{box_low('_box', metric, of)} <= _cap")
        .selectExpr("*", "_box.cx AS _cx", "_box.cy AS _cy")
    )


def _descend(slim: DataFrame, grid: Grid, reach: float | None, margin: float, metric: str) -> DataFrame:
    """Pair searching rows with the leaves worth opening.

    The rows of a finest cell walk down as the box around them, so a level costs by cells that
    search, however many rows they hold; every row then chooses among its cell's leaves.
    """
    cap = "double('infinity')" if reach is None else f"{float(reach) * SLACK!r}D"
    home = [*grid.on, "_ox", "_oy"]
    rows = cut_lineage(grid.placed(slim.filter("NOT isnan(_px) AND NOT isnan(_py)"), "_px", "_py", "_ox", "_oy"), "searching")
    corners = [F.expr(f"{f}({c}) AS {w}") for f, c, w in zip(("min", "min", "max", "max"), ROW, BOX)]
    cells = rows.groupBy(*home).agg(*corners).selectExpr("*", f"{cap} AS _cap")
    if reach is None or grid.last:
        cells = _capped(cells, grid, metric)
    if reach is not None:
        cells = around(cells, grid.sizes[0], (reach + margin) * SLACK, BOX)
        cells = met(cells, grid.boxes().filter("_level = 0").drop("_level"), [*grid.on, "_cx", "_cy"])
    elif grid.on:
        cells = _open(met(cells, grid.roots(), grid.on), metric, BOX)
    else:
        cells = _open(cells.withColumn("_boxes", grid.roots().select("_boxes").scalar()), metric, BOX)
    for level in range(grid.last):
        cells = _open(met(cells.drop("_box"), grid.children(level), [*grid.on, "_cx", "_cy"]).drop("_cx", "_cy"), metric, BOX)
    found = cells.groupBy(*home).agg(F.expr("collect_list(_box) AS _boxes"))
    return _open(met(rows, found, home).selectExpr("*", f"{cap} AS _cap"), metric, ROW).drop("_ox", "_oy", "_box")


def nearest_best(
    left: DataFrame, right: DataFrame, keys: Sequence[str], payload: Sequence[str] = (),
    on: Sequence[str] = (), reach: float | None = None, metric: str = "euclidean",
    shape: str = "point", max_half: float = 0.0, leaf: int = LEAF,
) -> DataFrame:
    """``keys, _best struct<d, pay>`` for the rows of ``left`` that have a nearest feature."""
    if metric not in METRICS:
        raise ValueError(f"Unsupported metric: {metric}")
    points, fields = _searched(right, on, shape, payload)
    grid = Grid(points, on, plan_sizes(points, on, None if reach is None else 2.0 * reach, leaf), fields)
    slim = left.filter("x IS NOT NULL AND y IS NOT NULL").selectExpr(
        *dict.fromkeys([*keys, *on]), "x AS _px", "y AS _py"
    )
    listed = F.expr(f"collect_list(struct({', '.join(fields)})) AS _pts")
    near = "true"
    if grid.sizes:
        found = met(_descend(slim, grid, reach, max_half, metric), grid.leaves(), [*grid.on, "_cx", "_cy"])
        # Few entries of a list lie within the known bound (widened by rounding error), so few are grouped.
        near = f"d <= _cap + {SLACK - 1!r}D * (abs(_px) + abs(_py) + _cap)"
    elif grid.on:
        # At most a leaf's worth of features in a group.
        found = met(slim, points.groupBy(*on).agg(listed), on)
    else:
        found = slim.withColumn("_pts", points.agg(listed).scalar())
    hits = found.selectExpr("*", "explode(_pts) AS _p").drop("_pts")
    if shape == "segment":
        dx, dy = "(_p.x2 - _p.x1)", "(_p.y2 - _p.y1)"
        squared = f"({dx} * {dx} + {dy} * {dy})"
        hits = hits.selectExpr(
            "*",
            f"greatest(0D, least(1D, CASE WHEN {squared} > 0 THEN ((_px - _p.x1) * {dx} + (_py - _p.y1) * {dy}) "
            f"/ {squared} ELSE 0D END)) AS _t",
        )
        d = METRICS[metric].format("_px", "_py", f"(_p.x1 + _t * {dx})", f"(_p.y1 + _t * {dy})")
    else:
        d = METRICS[metric].format("_px", "_py", "_p.x", "_p.y")
    scored = hits.selectExpr("*", f"{d} AS d").filter(near).selectExpr(*keys, "d", "_p")
    if reach is not None:
        scored = scored.filter(f"d <= {float(reach)!r}D")
    if payload:
        return scored.groupBy(*keys).agg(F.expr("min(named_struct('d', d, 'pay', _p._pay)) AS _best"))
    return scored.groupBy(*keys).agg(F.expr("min(d) AS d")).selectExpr(*keys, "struct(d) AS _best")


def nearest(
    left: DataFrame, right: DataFrame, key: str, payload: Sequence[str] = (), on: Sequence[str] = (),
    reach: float | None = None, metric: str = "euclidean", shape: str = "point",
    distance: str = "distance", max_half: float = 0.0, leaf: int = LEAF,
) -> DataFrame:
    """Left join every row to its nearest feature within the same ``on`` group.

    ``left`` has ``x, y`` and a unique ``key``; ``right`` has ``x, y`` (or ``x1, y1, x2, y2``
    for ``shape='segment'``). Adds ``distance`` and the payload columns, null where the
    group is empty or everything is further than ``reach``. Equal distances take the
    smallest payload. For segments under a ``reach``, ``max_half`` bounds half their extent.
    """
    best = nearest_best(left, right, [key], payload, on, reach, metric, shape, max_half, leaf)
    out = [f"_best.d AS {distance}", *[f"_best.pay.{c} AS {c}" for c in payload]]
    return met(left, best, [key], "left").selectExpr("*", *out).drop("_best")


def within(
    left: DataFrame, right: DataFrame, key: str, reach: float, on: Sequence[str] = (),
    metric: str = "euclidean", strict: bool = False, how: str = "left_semi",
) -> DataFrame:
    """Semi or anti join on having any feature within ``reach`` (``strict``: closer than)."""
    best = nearest_best(left, right, [key], (), on, reach, metric)
    near = best.filter(f"_best.d {'<' if strict else '<='} {float(reach)!r}D").select(key)
    return met(left, near, [key], how)


def radius_count(
    left: DataFrame, right: DataFrame, key: str, radius: float, name: str = "n",
    on: Sequence[str] = (), leaf: int = LEAF,
) -> DataFrame:
    """Add the number of features within ``radius`` of every row.

    Cells wholly inside the circle add their stored count, cells wholly outside are
    skipped, and only cells the circle cuts are opened.
    """
    points, fields = _searched(right, on, "point", ())
    fields = [*fields, "_w"]
    grid = Grid(points, on, plan_sizes(points, on, 2.0 * radius, leaf), fields)
    r = f"{float(radius)!r}D"
    slim = left.filter("x IS NOT NULL AND y IS NOT NULL").selectExpr(
        *dict.fromkeys([key, *on]), "x AS _px", "y AS _py"
    )
    rows = around(slim, grid.sizes[0], radius * SLACK)
    parts = []
    for level in range(len(grid.sizes) - 1):
        rows, inside = step_inside(rows, grid, level, f"{box_high('b')} * {SLACK!r}D <= {r}", f"{box_low('b')} <= {r} * {SLACK!r}D")
        parts.append(inside.selectExpr(key, "cast(_sum AS bigint) AS _n"))
    hits = met(rows, grid.leaves(), [*grid.on, "_cx", "_cy"]).selectExpr(key, "_px", "_py", "explode(_pts) AS _p")
    near = METRICS["euclidean"].format("_px", "_py", "_p.x", "_p.y")
    counted = hits.filter(f"{near} <= {r}").selectExpr(key, "_p._w AS _n")
    for part in parts:
        counted = counted.unionByName(part)
    sums = counted.groupBy(key).agg(F.expr("sum(_n) AS _n"))
    return met(left, sums, [key], "left").selectExpr("*", f"coalesce(_n, 0L) AS {name}").drop("_n")


def step_inside(rows: DataFrame, grid: Grid, level: int, inside: str, touched: str) -> tuple[DataFrame, DataFrame]:
    """One level down: rows on the cells to open, and per row the weight of whole cells."""
    joined = met(rows, grid.children(level), [*grid.on, "_cx", "_cy"]).drop("_cx", "_cy")
    whole = joined.selectExpr(
        "*", f"aggregate(filter(_boxes, b -> {inside}), 0D, (acc, b) -> acc + b.w) AS _sum"
    )
    cut = (
        joined.selectExpr("*", f"explode(filter(_boxes, b -> NOT ({inside}) AND {touched})) AS _box")
        .selectExpr("*", "_box.cx AS _cx", "_box.cy AS _cy")
        .drop("_box", "_boxes")
    )
    return cut, whole


_EDGE = "named_struct('x1', r[i].x, 'y1', r[i].y, 'x2', r[(i + 1) % size(r)].x, 'y2', r[(i + 1) % size(r)].y)"
#: The edges of ``rings`` that are not points, as an array.
EDGE_LIST = f"filter(flatten(transform(rings, r -> transform(sequence(0, size(r) - 1), i -> {_EDGE}))), e -> e.x1 <> e.x2 OR e.y1 <> e.y2)"


def polygon_edges(polygons: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Polygons (``rings``) as one row per edge ``x1, y1, x2, y2``."""
    names = [k.split(" AS ")[-1] for k in keep]
    return polygons.selectExpr(*keep, f"explode({EDGE_LIST}) AS _e").selectExpr(*names, "_e.x1", "_e.y1", "_e.x2", "_e.y2")
