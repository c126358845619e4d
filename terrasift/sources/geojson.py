"""GeoJSON boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_boundaries(spark: SparkSession, path: str, name: str = "shapeName") -> DataFrame:
    """Features as ``shapeName, rings``: Polygon and MultiPolygon, all rings together.

    Each file is one JSON document, so large boundary sets are best kept in several files.
    """
    schema = (
        "features array<struct<properties: map<string, string>, "
        "geometry: struct<type: string, coordinates: string>>>"
    )
    docs = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = docs.selectExpr("explode(features) AS f").selectExpr(
        f"f.properties['{name}'] AS shapeName", "f.geometry.type AS kind", "f.geometry.coordinates AS c"
    )
    single = "from_json(c, 'array<array<array<double>>>')"
    multi = "flatten(from_json(c, 'array<array<array<array<double>>>>'))"
    return rows.filter("kind IN ('Polygon', 'MultiPolygon')").selectExpr(
        "shapeName", f"CASE kind WHEN 'Polygon' THEN {single} ELSE {multi} END AS raw"
    ).selectExpr(
        "shapeName",
        "transform(raw, r -> transform(slice(r, 1, size(r) - 1), p -> named_struct('x', p[0], 'y', p[1]))) AS rings",
    )
