"""Geometry as column expressions.

Coordinates are stored as WGS84 degrees and measured in a transverse Mercator plane.
Rings are arrays of ``struct<x, y>``; nothing here needs a geometry type or a UDF.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# WGS84 ellipsoid and the public transverse Mercator parameters
# (scale 0.9996, false easting 500 km; central meridian 90 E, or 87 E / 93 E for the
# two UTM zones used as a fallback).
WGS84_A = 6378137.0
WGS84_F = 1.0 / 298.257223563
SCALE = 0.9996
FALSE_EASTING = 500000.0
MERIDIANS = {9680: 90.0, 32645: 87.0, 32646: 93.0}
METRES_PER_DEG_LAT = 110574.0
METRES_PER_DEG_LON = 111320.0

_n = WGS84_F / (2.0 - WGS84_F)
ECC = 2.0 * math.sqrt(_n) / (1.0 + _n)
RECTIFYING = WGS84_A / (1.0 + _n) * (1.0 + _n**2 / 4.0 + _n**4 / 64.0)
# Krueger series, order four.
ALPHA = (
    _n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16 + 41 * _n**4 / 180,
    13 * _n**2 / 48 - 3 * _n**3 / 5 + 557 * _n**4 / 1440,
    61 * _n**3 / 240 - 103 * _n**4 / 140,
    49561 * _n**4 / 161280,
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tm_forward(lat: str, lon: str, epsg: int = 9680) -> Column:
    """Projected position of two columns as ``struct<x, y>``; nulls give null fields.

    The two one-element ``transform`` steps bind intermediate values to a name. Plain
    nested columns would be copied wherever a filter or join key on ``x`` is pushed down,
    and the expression grows past what one generated method may hold.
    """
    dlon = f"radians(`{lon}` - {MERIDIANS[epsg]}D)"
    phi = f"radians(`{lat}`)"
    e = f"{ECC!r}D"
    conformal = f"sinh(atanh(sin({phi})) - {e} * atanh({e} * sin({phi})))"
    sphere = (
        f"transform(array({conformal}), t -> named_struct("
        f"'xi', atan2(t, cos({dlon})), 'eta', atanh(sin({dlon}) / sqrt(1D + t * t))))"
    )
    east, north = "v.eta", "v.xi"
    for j, a in enumerate(ALPHA, start=1):
        east += f" + {a!r}D * cos({2 * j}D * v.xi) * sinh({2 * j}D * v.eta)"
        north += f" + {a!r}D * sin({2 * j}D * v.xi) * cosh({2 * j}D * v.eta)"
    k = f"{SCALE * RECTIFYING!r}D"
    return F.expr(
        f"transform({sphere}, v -> named_struct("
        f"'x', {FALSE_EASTING!r}D + {k} * ({east}), 'y', {k} * ({north})))[0]"
    )


def project(
    df: DataFrame,
    lat: str = "lat",
    lon: str = "lon",
    x: str = "x",
    y: str = "y",
    epsg: int = 9680,
) -> DataFrame:
    """Add projected metres ``x, y``."""
    placed = df.withColumn("_xy", tm_forward(lat, lon, epsg))
    return placed.withColumns({x: F.col("_xy.x"), y: F.col("_xy.y")}).drop("_xy")


def project_point(lat: float, lon: float, epsg: int = 9680) -> tuple[float, float]:
    """The same projection for one literal search origin."""
    phi, dlon = math.radians(lat), math.radians(lon - MERIDIANS[epsg])
    t = math.sinh(math.atanh(math.sin(phi)) - ECC * math.atanh(ECC * math.sin(phi)))
    xi, eta = math.atan2(t, math.cos(dlon)), math.atanh(math.sin(dlon) / math.sqrt(1 + t * t))
    east = eta + sum(
        a * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, a in enumerate(ALPHA, 1)
    )
    north = xi + sum(
        a * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, a in enumerate(ALPHA, 1)
    )
    return FALSE_EASTING + SCALE * RECTIFYING * east, SCALE * RECTIFYING * north


def utm_code(lon: Column | str) -> Column:
    """EPSG code of the fallback zone, split at 90 degrees east."""
    return F.when(_col(lon) < F.lit(90.0), F.lit(32645)).otherwise(F.lit(32646))


def planar_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x1 - x2, y1 - y2
    return F.sqrt(dx * dx + dy * dy)


def chebyshev(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.greatest(F.abs(x1 - x2), F.abs(y1 - y2))


def segment_distance(
    px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column
) -> Column:
    """Distance from a point to a segment; a zero-length segment is a point."""
    dx, dy = x2 - x1, y2 - y1
    squared = dx * dx + dy * dy
    along = F.when(
        squared > 0, ((px - x1) * dx + (py - y1) * dy) / squared
    ).otherwise(F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    return planar_distance(px, py, x1 + t * dx, y1 + t * dy)


def edges_of(ring: Column) -> Column:
    """Closed ring as an array of ``struct<x1, y1, x2, y2>``; zero-length edges dropped."""
    n = F.size(ring)
    pairs = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(
            ring[i]["x"].alias("x1"),
            ring[i]["y"].alias("y1"),
            ring[(i + 1) % n]["x"].alias("x2"),
            ring[(i + 1) % n]["y"].alias("y2"),
        ),
    )
    return F.filter(pairs, lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def signed_area(ring: Column) -> Column:
    return _sum(F.transform(edges_of(ring), lambda e: e["x1"] * e["y2"] - e["x2"] * e["y1"])) / 2.0


def ring_area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    """Area centroid of a simple ring, taken relative to its first vertex for accuracy."""
    ox, oy = ring[0]["x"], ring[0]["y"]
    edges = edges_of(ring)

    def moment(weight):
        return _sum(
            F.transform(
                edges,
                lambda e: weight(e)
                * ((e["x1"] - ox) * (e["y2"] - oy) - (e["x2"] - ox) * (e["y1"] - oy)),
            )
        )

    twice = moment(lambda e: F.lit(1.0))
    return (
        ox + F.try_divide(moment(lambda e: (e["x1"] - ox) + (e["x2"] - ox)), F.lit(3.0) * twice),
        oy + F.try_divide(moment(lambda e: (e["y1"] - oy) + (e["y2"] - oy)), F.lit(3.0) * twice),
    )


def _quad_edges(xy: str) -> list[tuple[str, str, str, str]]:
    return [tuple(f"{xy}[{(2 * i + k) % 8}]" for k in range(4)) for i in range(4)]


def quad_area(xy: str) -> Column:
    """``ring_area`` of a column of four corners ``x, y, x, y, ...``, without a loop over a list."""
    return F.expr("abs(" + " + ".join(f"({a} * {d} - {c} * {b})" for a, b, c, d in _quad_edges(xy)) + ") / 2D")


def quad_centroid(xy: str) -> tuple[Column, Column]:
    """``ring_centroid`` of a column of four corners, without a loop over a list."""
    edges = [(f"({a} - {xy}[0])", f"({b} - {xy}[1])", f"({c} - {xy}[0])", f"({d} - {xy}[1])") for a, b, c, d in _quad_edges(xy)]
    cross = [f"({a} * {d} - {c} * {b})" for a, b, c, d in edges]
    twice = f"({' + '.join(cross)})"
    x, y = (" + ".join(f"({e[k]} + {e[k + 2]}) * {w}" for e, w in zip(edges, cross)) for k in (0, 1))
    return tuple(F.expr(f"{xy}[{k}] + try_divide({top}, 3D * {twice})") for k, top in enumerate((x, y)))


def ring_bounds(ring: Column) -> tuple[Column, Column, Column, Column]:
    """``west, south, east, north`` of a ring."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def crossings(edges: Column, px: Column, py: Column) -> Column:
    """Number of edges a ray going east from the point crosses; odd means inside."""
    hit = F.filter(
        edges,
        lambda e: ((e["y1"] > py) != (e["y2"] > py))
        & (px < e["x1"] + (py - e["y1"]) / (e["y2"] - e["y1"]) * (e["x2"] - e["x1"])),
    )
    return F.size(hit)


def bbox_area_km2(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Approximate area of a degree box, from the mid-latitude scale."""
    width = (east - west) * F.lit(111.32) * F.cos(F.radians((south + north) / 2.0))
    height = (north - south) * F.lit(110.574)
    return F.abs(width * height)


def radius_box(lat: Column, lon: Column, radius_m: float) -> tuple[Column, Column, Column, Column]:
    """``south, west, north, east`` around a point, for fitting a view."""
    d_lat = F.lit(radius_m / METRES_PER_DEG_LAT)
    scale = F.greatest(F.cos(F.radians(lat)), F.lit(0.01))
    d_lon = F.lit(radius_m) / (F.lit(METRES_PER_DEG_LON) * scale)
    return lat - d_lat, lon - d_lon, lat + d_lat, lon + d_lon


def pixel_to_geo(col: Column, row: Column, transform: Column) -> tuple[Column, Column]:
    """Apply a six-value affine ``[a, b, c, d, e, f]``."""
    return (
        transform[2] + col * transform[0] + row * transform[1],
        transform[5] + col * transform[3] + row * transform[4],
    )


def tile_starts(length: Column, chip: int, stride: int) -> Column:
    """Tile origins along one axis, the last one aligned to the far edge."""
    far = F.greatest(length - F.lit(chip), F.lit(0))
    return F.array_union(F.sequence(F.lit(0).cast("int"), far.cast("int"), F.lit(stride)), F.array(far.cast("int")))
