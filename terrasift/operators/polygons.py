"""Polygons as quadtree cells: points inside them and lines cut by them.

A polygon is ``rings``, an array of rings; holes and several parts work through even-odd
counts. Its cells are halved until none holds more than ``MOST`` edges. A cell without edges
lies wholly inside or outside, so only cells on the border hold edges, and a border of a million
corners is a million rows in bounded groups. Whether a cell's lower left corner is inside follows
from its parent's corner and the parent's edges between the two, and a point from the corner and
the edges of its own cell.

Cells are squares with sides of a power of two on one common grid, so points, lines and polygons
meet by equal cell numbers. A value on a grid line counts as lying just above it, everywhere.

Where many polygons lie over each other, a search for the smallest record cuts crowded cells into
quarters: under a polygon that holds a whole cell, larger records need no look (``thinned``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.operators.spatial import EDGE_LIST, polygon_edges
from terrasift.session import cut_lineage

#: Edges of a border cell, and how often a cell may be halved; deeper piles share one corner.
MOST, DEEPEST = 48, 40
#: Border polygons of a cell that points go through one by one, how often crowded cells are quartered for
#: fewer, and how many rows that may make of one.
CROWD, QUARTERED, GROWN = 8, 6, 8

EDGE = ("x1", "y1", "x2", "y2")
# Edges crossed on the way from (ax, ay) along the row and then along the column to (bx, by). Points lie a little
# above their values, in x by far more than in y: what meets the column in its end goes by its slope.
_ACROSS = "(y1 > {ay}) <> (y2 > {ay}) AND x1 + ({ay} - y1) / nullif(y2 - y1, 0D) * (x2 - x1) > least({ax}, {bx}) AND x1 + ({ay} - y1) / nullif(y2 - y1, 0D) * (x2 - x1) <= greatest({ax}, {bx})"
_AT = "y1 + ({bx} - x1) / nullif(x2 - x1, 0D) * (y2 - y1)"
_ALONG = f"(x1 > {{bx}}) <> (x2 > {{bx}}) AND if((y2 - y1) * (x2 - x1) <= 0, {_AT} > least({{ay}}, {{by}}) AND {_AT} <= greatest({{ay}}, {{by}}), {_AT} >= least({{ay}}, {{by}}) AND {_AT} < greatest({{ay}}, {{by}}))"


def crossings(ax: str, ay: str, bx: str, by: str, edge: str = "") -> str:
    """Number of times ``edge`` is crossed between two points, as an expression."""
    both = f"(if({_ACROSS.format(ax=ax, ay=ay, bx=bx)}, 1, 0) + if({_ALONG.format(ay=ay, bx=bx, by=by)}, 1, 0))"
    return _of(both, edge)


def _of(expression: str, edge: str) -> str:
    """``expression`` over the coordinates of the lambda variable ``edge``; empty: over columns."""
    for c in EDGE if edge else ():
        expression = expression.replace(c, f"{edge}.{c}")
    return expression


def _side(level: str = "_level") -> str:
    return f"pow(2D, {level})"


def _touches(edge: str = "", cx: str = "_cx", cy: str = "_cy", level: str = "_level") -> str:
    """An edge's bounding box meets the cell, and the cell's corners do not all lie on one side of it."""
    s = _side(level)
    x, y = f"({cx} * {s})", f"({cy} * {s})"
    side = [f"((x2 - x1) * ({y} + {j} * {s} - y1) - (y2 - y1) * ({x} + {i} * {s} - x1))" for i in (0, 1) for j in (0, 1)]
    return _of(
        f"greatest(x1, x2) >= {x} AND least(x1, x2) <= {x} + {s} AND greatest(y1, y2) >= {y} AND least(y1, y2) <= {y} + {s} "
        f"AND least({', '.join(side)}) <= 0 AND greatest({', '.join(side)}) >= 0", edge
    )


def _parts(rows: DataFrame, names: Sequence[str], numbers: str, level: str, inside: str, ox: str, oy: str) -> DataFrame:
    """``names, _level, _cx, _cy, _inside, _edges``: ``rows`` put into the cells ``numbers`` (array<struct<cx, cy>>).

    The cells' corners are reached from (ox, oy), which is inside or not; cells outside are left out.
    """
    s = _side(level)
    crossed = f"aggregate(_edges, 0, (n, e) -> n + {crossings(ox, oy, f'(c.cx * {s})', f'(c.cy * {s})', 'e')})"
    cell = (
        f"named_struct('cx', c.cx, 'cy', c.cy, 'inside', {inside} <> ({crossed} % 2 = 1), "
        f"'edges', filter(_edges, e -> {_touches('e', 'c.cx', 'c.cy', level)}))"
    )
    found = f"explode(filter(transform({numbers}, c -> {cell}), c -> c.inside OR size(c.edges) > 0)) AS _c"
    return rows.selectExpr(*names, f"{level} AS _level", found).selectExpr(
        *names, "_level", "_c.cx AS _cx", "_c.cy AS _cy", "_c.inside AS _inside", "_c.edges AS _edges"
    )


def _roots(lists: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Index rows of polygons that need no halving, each from its own row ``keep, _edges``."""
    bounds = [f"array_{f}(transform(_edges, e -> {g}(e.{c}1, e.{c}2))) AS {n}" for f, g, c, n in (("min", "least", "x", "_w"), ("max", "greatest", "x", "_e"), ("min", "least", "y", "_s"), ("max", "greatest", "y", "_n"))]
    s = _side()
    numbers = f"flatten(transform(sequence(floor(_w / {s}), floor(_e / {s})), i -> transform(sequence(floor(_s / {s}), floor(_n / {s})), j -> named_struct('cx', i, 'cy', j))))"
    placed = lists.selectExpr(*keep, "_edges", *bounds).selectExpr("*", "cast(ceil(log2(greatest(_e - _w, _n - _s, 1e-9D))) AS int) AS _level")
    return _parts(placed, keep, numbers, "_level", "false", "(_w - 1)", "(_s - 1)")


def _quarters(index: DataFrame) -> DataFrame:
    """Index rows of the four quarters of every cell."""
    names = [c for c in index.columns if c not in ("_level", "_cx", "_cy", "_inside", "_edges")]
    numbers = "array(" + ", ".join(f"named_struct('cx', 2 * _cx + {i}, 'cy', 2 * _cy + {j})" for i in (0, 1) for j in (0, 1)) + ")"
    s = _side()
    return _parts(index, names, numbers, "(_level - 1)", "_inside", f"(_cx * {s})", f"(_cy * {s})")


def cells(polygons: DataFrame, keep: Sequence[str], most: int = MOST, deepest: int = DEEPEST) -> DataFrame:
    """(keep, _level, _cx, _cy, _inside, _edges): border cells with their edges, and cells wholly inside.

    ``_inside`` tells whether the lower left corner is inside. Rings may come in any direction.
    """
    keep = list(keep)
    # Of the large ones, only the number of edges is taken here.
    each = polygons.selectExpr(*keep, f"{EDGE_LIST} AS _e").selectExpr(*keep, "_e", "coalesce(array_size(_e), 0) AS _size")
    lists = each.groupBy(*keep).agg(
        F.sum("_size").alias("_many"), F.flatten(F.collect_list(F.when(F.col("_size") <= most, F.col("_e")))).alias("_edges")
    )
    lists = cut_lineage(lists.filter("_many > 0"), "polygon-lists")
    small = _roots(lists.filter(F.col("_many") <= most), keep)
    many = lists.filter(F.col("_many") > most)
    if not many.isEmpty():
        same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keep]
        small = small.unionByName(_halved(polygons.alias("l").join(many.alias("r"), same, "left_semi"), keep, most, deepest))
    return cut_lineage(small, "polygon-index")


def _halved(polygons: DataFrame, keep: Sequence[str], most: int, deepest: int) -> DataFrame:
    """Index rows of polygons of many edges, whose edges are rows until few share a cell."""
    keep = list(keep)
    edges = cut_lineage(polygon_edges(polygons, keep), "polygon-edges")
    box = edges.groupBy(*keep).agg(
        F.expr("min(least(x1, x2)) AS _w"), F.expr("max(greatest(x1, x2)) AS _e"), F.expr("min(least(y1, y2)) AS _s"), F.expr("max(greatest(y1, y2)) AS _n")
    )
    # At the root a polygon touches four cells at most; their corners are found from one outside of it.
    root = box.withColumn("_level", F.expr("cast(ceil(log2(greatest(_e - _w, _n - _s, 1e-9D))) AS int)"))
    s = _side()
    spread = f"explode(flatten(transform(sequence(floor(_w / {s}), floor(_e / {s})), i -> transform(sequence(floor(_s / {s}), floor(_n / {s})), j -> struct(i AS cx, j AS cy))))) AS _c"
    tops = root.selectExpr(*keep, "_level", "_w - 1 AS _ox", "_s - 1 AS _oy", spread).selectExpr(*keep, "_level", "_ox", "_oy", "_c.cx AS _cx", "_c.cy AS _cy")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keep]

    def joined(left: DataFrame, right: DataFrame, on: list[Column], how: str = "inner") -> DataFrame:
        names = [f"r.{c}" for c in right.columns if c not in left.columns]
        return left.alias("l").join(right.alias("r"), on, how).select("l.*", *names)

    counted = F.sum(F.expr(crossings("_ox", "_oy", f"(_cx * {s})", f"(_cy * {s})"))).alias("_n")
    pairs = joined(tops, edges, same)
    state = ["_level", "_cx", "_cy"]
    here = pairs.groupBy(*keep, *state).agg(counted).selectExpr(*keep, *state, "_n % 2 = 1 AS _inside")
    held = pairs.filter(F.expr(_touches())).select(*keep, *state, *EDGE)
    at_cell = [*same, *(F.col(f"l.{c}") == F.col(f"r.{c}") for c in state)]
    done: list[DataFrame] = []
    for _ in range(deepest):
        sizes = held.groupBy(*keep, *state).agg(F.count(F.lit(1)).alias("_many"))
        large = cut_lineage(joined(here, sizes, at_cell).filter(F.col("_many") > most).drop("_many"), "polygon-large")
        if large.isEmpty():
            break
        done.append((here.alias("l").join(large.alias("r"), at_cell, "left_anti"), held.alias("l").join(large.alias("r"), at_cell, "left_anti")))
        quarters = "explode(array(struct(0 AS i, 0 AS j), struct(1 AS i, 0 AS j), struct(0 AS i, 1 AS j), struct(1 AS i, 1 AS j))) AS _q"
        child = ["_level - 1 AS _level", "2 * _cx + _q.i AS _cx", "2 * _cy + _q.j AS _cy"]
        corner = [f"_cx * {s} AS _ox", f"_cy * {s} AS _oy"]
        below = large.selectExpr(*keep, *state, "_inside", quarters).selectExpr(*keep, "_inside AS _up", *corner, *child)
        # Edges of a cell on the way from its corner to the corners of its quarters.
        inner = joined(held, large.drop("_inside"), at_cell).selectExpr(*keep, *state, *EDGE, quarters).selectExpr(*keep, *corner, *child, *EDGE)
        way = inner.groupBy(*keep, *state).agg(counted)
        here = cut_lineage(joined(below, way, at_cell, "left").selectExpr(*keep, *state, "_up <> (coalesce(_n, 0) % 2 = 1) AS _inside"), "polygon-cells")
        held = cut_lineage(inner.filter(F.expr(_touches())).select(*keep, *state, *EDGE), "polygon-edges")
    done.append((here, held))
    parts = []
    for areas, lines in done:
        listed = lines.groupBy(*keep, *state).agg(F.collect_list(F.struct(*EDGE)).alias("_edges"))
        parts.append(joined(areas, listed, at_cell, "left").filter("_inside OR _edges IS NOT NULL").selectExpr(
            *keep, *state, "_inside", "coalesce(_edges, array()) AS _edges"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def thinned(index: DataFrame, keep: Sequence[str], on: Sequence[str] = (), crowd: int = CROWD) -> DataFrame:
    """``on, _level, _cx, _cy, _inside, _edges, _rec``: the index as far as a smallest record needs it.

    A polygon that holds a whole cell hides all larger records there. Cells that leave more than
    ``crowd`` border polygons to go through are quartered, so that more of the cell is held by some
    polygon; this ends where it makes too many rows of few.
    """
    at = [*dict.fromkeys([*on, "_level", "_cx", "_cy"])]
    rows = index.selectExpr(*at, "_inside", "_edges", f"struct({', '.join(keep)}) AS _rec")

    def crowded(of: DataFrame) -> DataFrame:
        return of.filter("size(_edges) > 0").groupBy(*at).agg(F.count(F.lit(1)).alias("_many")).filter(F.col("_many") > crowd)

    large = cut_lineage(crowded(rows), "crowded")
    if large.isEmpty():
        return rows
    # Copies of a polygon stay copies in every cell.
    rows, first, step, done = rows.groupBy(*at, "_inside", "_edges").agg(F.min("_rec").alias("_rec")), 0, 0, None
    while True:
        rows = cut_lineage(rows, "cells")
        held = cut_lineage(rows.filter("size(_edges) = 0").groupBy(*at).agg(F.min("_rec").alias("_least")), "held")
        border = rows.filter("size(_edges) > 0").join(held, at, "left").filter("_least IS NULL OR _rec < _least").drop("_least")
        whole = held.selectExpr(*at, "true AS _inside", "cast(array() AS array<struct<x1: double, y1: double, x2: double, y2: double>>) AS _edges", "_least AS _rec")
        rows = cut_lineage(border.select(*rows.columns).unionByName(whole), "thinned")
        large = cut_lineage(crowded(rows), "crowded")
        n = large.agg(F.sum("_many")).first()[0] or 0
        first = first or n
        if not n or n > GROWN * first or step == QUARTERED:
            return rows if done is None else done.unionByName(rows)
        fine = rows.join(large, at, "left_anti")
        done = fine if done is None else done.unionByName(fine)
        rows, step = _quarters(rows.join(large.drop("_many"), at, "left_semi")), step + 1




def levels(index: DataFrame) -> list[int]:
    """Levels in use; at most as many as a double has exponents."""
    return sorted(r["_level"] for r in index.select("_level").distinct().collect())


def containing(
    points: DataFrame, index: DataFrame, key: str, keep: Sequence[str], x: str = "lon", y: str = "lat", on: Sequence[str] = (),
    strict: bool = True,
) -> DataFrame:
    """``key, _hit``: the smallest ``keep`` record among the polygons strictly around the point.

    Without ``strict`` a point on an edge goes by the even-odd count of the edges to its right in
    its row, so that of two polygons with a common edge one holds it.
    """
    index_ = thinned(index, keep, on)
    used = levels(index_)
    if not used:
        return points.limit(0).selectExpr(key, *[f"CAST(NULL AS {t}) AS {c}" for c, t in index.select(*keep).dtypes]).selectExpr(key, f"struct({', '.join(keep)}) AS _hit")
    numbers = f"explode(array({', '.join(map(str, used))})) AS _level"
    keyed = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).selectExpr(
        *dict.fromkeys([key, *on]), f"cast({x} AS double) AS _px", f"cast({y} AS double) AS _py", numbers
    ).selectExpr("*", f"floor(_px / {_side()}) AS _cx", f"floor(_py / {_side()}) AS _cy")
    s = _side()
    # Along the point's own row, so that an edge is left or right of it as in a count over all edges.
    count = f"aggregate(_edges, 0, (n, e) -> n + {crossings('_px', '_py', f'(_cx * {s})', f'(_cy * {s})', 'e')})"
    on_edge = (
        "exists(_edges, e -> (e.x2 - e.x1) * (_py - e.y1) - (e.y2 - e.y1) * (_px - e.x1) = 0 AND "
        "_px BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2) AND _py BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2))"
    )
    return (
        keyed.join(index_, [*on, "_level", "_cx", "_cy"])
        .filter(f"(_inside <> ({count} % 2 = 1))" + (f" AND NOT {on_edge}" if strict else ""))
        .groupBy(key).agg(F.min("_rec").alias("_hit"))
    )


def point_in_polygon(
    points: DataFrame, polygons: DataFrame, key: str, keep: Sequence[str], x: str = "lon", y: str = "lat", how: str = "left", most: int = MOST,
    strict: bool = True,
) -> DataFrame:
    """Attach the containing polygon's ``keep`` columns; the smallest wins on overlap.

    ``how='left_semi'`` keeps only contained points, adding no columns.
    """
    hits = containing(points, cells(polygons, keep, most), key, keep, x, y, strict=strict)
    if how != "left":
        return points.join(hits.select(key), key, how)
    return points.join(hits, key, "left").selectExpr("*", *[f"_hit.{c} AS {c}" for c in keep]).drop("_hit")


def _inside_parts(x1: float, y1: float, x2: float, y2: float, side: float, cx: int, cy: int, inside: bool, edges: list[dict]) -> list[tuple[float, float]]:
    """Parts (from, to) of a segment's run 0..1 that lie in one cell and in the polygon."""
    dx, dy = x2 - x1, y2 - y1
    low, high = 0.0, 1.0
    for start, step, edge in ((x1, dx, cx * side), (y1, dy, cy * side)):
        if step:
            a, b = sorted(((edge - start) / step, (edge + side - start) / step))
            low, high = max(low, a), min(high, b)
        elif not edge <= start < edge + side:
            return []
    if low >= high:
        return []
    cuts = {low, high}
    for e in edges:
        ex, ey = e["x2"] - e["x1"], e["y2"] - e["y1"]
        turn = dx * ey - dy * ex
        if turn:
            t = ((e["x1"] - x1) * ey - (e["y1"] - y1) * ex) / turn
            u = ((e["x1"] - x1) * dy - (e["y1"] - y1) * dx) / turn
            if low < t < high and -1e-12 <= u <= 1 + 1e-12:
                cuts.add(t)
    ordered = sorted(cuts)
    parts: list[tuple[float, float]] = []
    ox, oy = cx * side, cy * side
    for a, b in zip(ordered, ordered[1:]):
        px, py = x1 + (a + b) / 2 * dx, y1 + (a + b) / 2 * dy
        odd = inside
        for e in edges:
            if (e["y1"] > oy) != (e["y2"] > oy) and min(ox, px) < e["x1"] + (oy - e["y1"]) / (e["y2"] - e["y1"]) * (e["x2"] - e["x1"]) <= max(ox, px):
                odd = not odd
            if (e["x1"] > px) != (e["x2"] > px) and min(oy, py) < e["y1"] + (px - e["x1"]) / (e["x2"] - e["x1"]) * (e["y2"] - e["y1"]) <= max(oy, py):
                odd = not odd
        if odd:
            if parts and parts[-1][1] == a:
                parts[-1] = parts[-1][0], b
            else:
                parts.append((a, b))
    return parts


def clip_lines(lines: DataFrame, index: DataFrame, key: str, keep: Sequence[str], on: Sequence[str] = ()) -> DataFrame:
    """``key, keep, part, path``: what lies in each polygon of ``lines(key, path array<struct<x, y>>)``.

    A line is cut segment by segment, a segment in every cell it touches by the cell's edges;
    parts that follow on each other are joined again. ``part`` numbers the pieces along the line.
    """
    keep, on = list(keep), list(on)
    used = levels(index)
    kinds = dict(lines.dtypes) | dict(index.dtypes)
    names = list(dict.fromkeys([key, *on]))
    segments = lines.selectExpr(*names, "path", "explode(sequence(0, size(path) - 2)) AS _i").filter("size(path) > 1").selectExpr(
        *names, "_i", "cast(path[_i].x AS double) AS x1", "cast(path[_i].y AS double) AS y1",
        "cast(path[_i + 1].x AS double) AS x2", "cast(path[_i + 1].y AS double) AS y2",
    ).filter("x1 <> x2 OR y1 <> y2")
    s = _side()
    numbers = f"explode(array({', '.join(map(str, used)) or 'cast(null AS int)'})) AS _level"
    # Row by row, the cells between the segment's entry and exit: as many as it touches.
    row = f"explode(sequence(floor(least(y1, y2) / {s}), floor(greatest(y1, y2) / {s}))) AS _cy"
    at = "if(y1 = y2, {0}, x1 + (least(greatest({1}, least(y1, y2)), greatest(y1, y2)) - y1) / nullif(y2 - y1, 0D) * (x2 - x1))"
    a, b = at.format("x1", f"_cy * {s}"), at.format("x2", f"(_cy + 1) * {s}")
    column = f"explode(sequence(floor(least({a}, {b}) / {s} - 1e-9D), floor(greatest({a}, {b}) / {s} + 1e-9D))) AS _cx"
    touched = segments.selectExpr("*", numbers).selectExpr("*", row).selectExpr("*", column)
    own = [c for c in keep if c not in on]
    met = touched.join(index.select(*on, *own, "_level", "_cx", "_cy", "_inside", "_edges"), [*on, "_level", "_cx", "_cy"])
    out_names = list(dict.fromkeys([key, *on, *own]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, place = [], []
            for i, r in enumerate(batch.select([*EDGE, "_i", "_level", "_cx", "_cy", "_inside", "_edges"]).to_pylist()):
                side = math.ldexp(1.0, r["_level"])
                for low, high in _inside_parts(r["x1"], r["y1"], r["x2"], r["y2"], side, r["_cx"], r["_cy"], r["_inside"], r["_edges"]):
                    rows.append((r["_i"], low, high))
                    place.append(i)
            kept = batch.take(pa.array(place, pa.int64()))
            columns = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [*(kept.column(c) for c in out_names), *(kept.column(c) for c in EDGE),
                 pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.float64())],
                [*out_names, *EDGE, "_i", "_a", "_b"],
            )

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in out_names), *(f"{c} double" for c in EDGE), "_i int, _a double, _b double"])
    parts = met.selectExpr(*out_names, *EDGE, "cast(_i AS int) AS _i", "_level", "cast(_cx AS long) AS _cx", "cast(_cy AS long) AS _cy", "_inside", "_edges").mapInArrow(cut, schema)
    # A line's parts in order; each begins where the one before ends, or starts a new piece.
    listed = parts.groupBy(*out_names).agg(F.array_sort(F.collect_list(F.struct(
        (F.col("_i") + F.col("_a")).alias("t0"), (F.col("_i") + F.col("_b")).alias("t1"),
        F.expr("struct(x1 + _a * (x2 - x1) AS x, y1 + _a * (y2 - y1) AS y)").alias("p"),
        F.expr("struct(x1 + _b * (x2 - x1) AS x, y1 + _b * (y2 - y1) AS y)").alias("q"), F.col("_b").alias("b"),
    ))).alias("_parts"))
    joined_parts = F.expr(
        "aggregate(_parts, cast(array() AS array<struct<t1: double, path: array<struct<x: double, y: double>>>>), (acc, e) -> "
        "if(size(acc) > 0 AND abs(element_at(acc, -1).t1 - e.t0) < 1e-9D, "
        "concat(slice(acc, 1, size(acc) - 1), array(struct(e.t1 AS t1, concat(element_at(acc, -1).path, array(e.q)) AS path))), "
        "concat(acc, array(struct(e.t1 AS t1, array(e.p, e.q) AS path)))))"
    )
    return listed.select(*out_names, F.posexplode(joined_parts).alias("part", "_piece")).select(*out_names, "part", F.col("_piece.path").alias("path"))
