"""Places, boundaries, layers, labels and survey matches attached to sites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift import config
from terrasift.functions import geo
from terrasift.functions.text import fold_name, tokens
from terrasift.operators import polygons as areas
from terrasift.operators import spatial
from terrasift.operators.serving import KNOWN_STATUS, NEW_STATUS


def nearest_place(sites: DataFrame, places: DataFrame, key: str, reach: float = 2000.0) -> DataFrame:
    """Nearest place within ``reach``; equal distances take the smallest name."""
    out = spatial.nearest(sites, places, key, ["name", "place_type"], reach=reach, distance="nearest_place_dist_m")
    return out.withColumnsRenamed({"name": "nearest_place", "place_type": "nearest_place_type"})


def closure_matches(closures: DataFrame, sites: DataFrame, key: str, reach: float = 5000.0) -> DataFrame:
    """Nearest site of every closure record, null beyond ``reach``."""
    out = spatial.nearest(closures, sites, key, ["kiln_id", "class", "confidence"], reach=reach)
    return out.withColumn("distance", F.round("distance", 1)).withColumnsRenamed(
        {"distance": "nearest_detection_m", "class": "nearest_class", "confidence": "nearest_confidence"}
    )


def survey_status(sites: DataFrame, centres: DataFrame, key: str, reach: float = 200.0) -> DataFrame:
    """Known when a surveyed centre is closer than ``reach``, else new."""
    known = spatial.nearest_best(sites, centres, [key], reach=reach).filter(f"_best.d < {reach!r}D").selectExpr(key, "true AS _k")
    return sites.join(known, key, "left").selectExpr(
        "*", f"CASE WHEN _k THEN '{KNOWN_STATUS}' ELSE '{NEW_STATUS}' END AS detection_status"
    ).drop("_k")


def attach_labels(sites: DataFrame, labels: DataFrame, key: str, reach: float = 0.001) -> DataFrame:
    """Labels go to the nearest site in degree space (closer than ``reach``); the last wins."""
    hits = matched_labels(sites, labels, key, reach)
    last = hits.groupBy(key).agg(F.expr("max_by(label, label_id) AS label"))
    return sites.join(last, key, "left").selectExpr(
        "*", "CASE label WHEN 'TP' THEN 'Verified kiln' WHEN 'FP' THEN 'False positive' ELSE 'Unreviewed' END AS verified"
    )


def matched_labels(sites: DataFrame, labels: DataFrame, key: str, reach: float = 0.001) -> DataFrame:
    degrees = sites.selectExpr(key, "lat AS x", "lon AS y")
    asked = labels.selectExpr("*", "lat AS x", "lon AS y")
    return spatial.nearest(asked, degrees, "label_id", [key], reach=reach).filter(f"distance < {reach!r}D")


def negative_points(
    spark: SparkSession, polygon: DataFrame, box: Sequence[float], sites: DataFrame, n: int, apart: float,
    seed: int = 42,
) -> DataFrame:
    """``n`` hashed random points inside the polygon, at least ``apart`` from every site.

    Candidates come in growing rounds until enough survive, so no share is assumed. Where the
    sites leave hardly any room, the points found among the ``4096 * n`` candidates of the last
    round come back, fewer than ``n`` or none.
    """
    west, south, east, north = box
    size = 4 * n
    while True:
        unit = "(pmod(xxhash64({0}, {1}, id), 1000000007L) + 0.5D) / 1000000007D"
        drawn = spark.range(size).selectExpr(
            "id", f"{south}D + {unit.format(seed, 1)} * {north - south}D AS lat", f"{west}D + {unit.format(seed, 2)} * {east - west}D AS lon"
        )
        inside = geo.project(areas.point_in_polygon(drawn, polygon, "id", ["name"], how="left_semi"))
        free = spatial.within(inside, sites, "id", apart, strict=True, how="left_anti")
        picked = free.orderBy("id").limit(n)
        found = picked.count()
        if found >= n or size >= 4096 * n:
            return picked
        size *= 4


def has_tags(layer: str, column: str = "tags") -> str:
    """Layer membership: any key whose tag value is listed."""
    tests = []
    for key, values in config.LAYER_TAGS[layer].items():
        listed = ", ".join(f"'{v}'" for v in values)
        tests.append(f"coalesce(try_element_at({column}, '{key}') IN ({listed}), false)")
    return "(" + " OR ".join(tests) + ")"


def with_provenance(df: DataFrame, layer: str, url: str, accessed_at: str) -> DataFrame:
    known = {
        "source_layer_id": f"openstreetmap:{layer}", "source_authority": "OpenStreetMap contributors", "source_url": url,
        "source_accessed_at": accessed_at, "source_version_date": None,
        "geometry_provenance": "mapped geometry, clipped to the configured district; not a legally controlling boundary",
    }
    return df.select("*", *[F.lit(value).cast("string").alias(name) for name, value in known.items()])


def first_readable(sources: Sequence[DataFrame], key: str) -> DataFrame:
    """Union of sources by priority: rows of the first source that has any."""
    tagged = None
    for i, df in enumerate(sources):
        part = df.withColumn("_source", F.lit(i))
        tagged = part if tagged is None else tagged.unionByName(part)
    first = tagged.agg(F.min("_source").alias("s")).scalar()
    return tagged.filter(F.col("_source") == first).drop("_source")


def one_boundary(boundaries: DataFrame, name: str) -> DataFrame:
    """The boundary of that name, ignoring case; anything but one match fails the job."""
    found = boundaries.filter(F.lower("shapeName") == name.lower())
    n = found.agg(F.expr("count(1) AS n")).scalar()
    return found.withColumn("_n", n).filter(
        F.expr("CASE WHEN _n <> 1 THEN raise_error('Expected exactly one boundary') ELSE true END")
    ).drop("_n")


def boundary_by_alias(asked: DataFrame, boundaries: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Left join on folded names after replacing known aliases; null when nothing matches."""
    folded = keyed = asked.withColumn("_f", fold_name("name"))
    if aliases:
        known = F.create_map(*[F.lit(v) for pair in aliases.items() for v in pair])
        keyed = folded.withColumn("_f", F.coalesce(F.try_element_at(known, F.col("_f")), "_f"))
    return keyed.join(boundaries.withColumn("_f", fold_name("shapeName")), "_f", "left").drop("_f")


def merge_districts(parts: Sequence[DataFrame]) -> DataFrame:
    """District tables together; a row without a district fails the job."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.filter(
        F.expr("CASE WHEN coalesce(trim(district), '') = '' THEN raise_error('Row without district') ELSE true END")
    )


def explode_lines(df: DataFrame, lines: str = "lines") -> DataFrame:
    """Multi-lines as single lines with at least two vertices."""
    return df.selectExpr(*[c for c in df.columns if c != lines], f"explode({lines}) AS line").filter("size(line) >= 2")


def layer_completeness(features: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Feature count and count per km2 for every district and layer; null per km2 without a boundary."""
    area = (
        "abs((east - west) * 111.32D * cos(radians((south + north) / 2)) * (north - south) * 110.574D) AS km2"
    )
    counts = features.groupBy("district", "layer").agg(F.expr("count(1) AS n"))
    return counts.join(boundaries.selectExpr("shapeName AS district", area), "district", "left").selectExpr(
        "district", "layer", "n", "n / km2 AS per_km2"
    )


def best_text_match(asked: DataFrame, candidates: DataFrame, floor: float = 0.34) -> DataFrame:
    """Best candidate by token F1 (``id, text`` against ``cand, text``); null under ``floor``.

    Texts meet through shared tokens. Two shared tokens are needed unless the query has one.
    """
    q = asked.selectExpr("id", f"{tokens('text')} AS t").selectExpr("id", "size(t) AS nq", "explode(t) AS w")
    c = candidates.selectExpr("cand", f"{tokens('text')} AS t").selectExpr("cand", "size(t) AS nc", "explode(t) AS w")
    shared = q.join(c, "w").groupBy("id", "cand", "nq", "nc").agg(F.expr("count(1) AS k")).filter("k >= 2 OR nq = 1")
    scored = shared.selectExpr("id", "cand", "2D * k / (nq + nc) AS score").filter(f"score >= {floor}D")
    best = scored.groupBy("id").agg(F.expr("max_by(struct(cand, score), named_struct('s', score, 'c', -cand)) AS b"))
    return asked.select("id").join(best, "id", "left").selectExpr("id", "b.cand AS cand", "b.score AS score")


def districts_in_names(files: DataFrame, districts: DataFrame) -> DataFrame:
    """District named by a token of the file name, when exactly one matches."""
    words = files.selectExpr("file", "explode(array_distinct(split(lower(file), '[^a-z0-9]+'))) AS w")
    hits = words.join(districts.select("district", fold_name("district").alias("w")), "w")
    return hits.groupBy("file").agg(F.expr("min(district) AS district"), F.expr("count(DISTINCT district) AS n")).filter("n = 1").drop("n")


def mean_longitude(df: DataFrame) -> DataFrame:
    """Mean longitude of a point table, used to choose the projected zone."""
    return df.selectExpr("avg(lon) AS lon").filter(
        F.expr("CASE WHEN lon NOT BETWEEN -180 AND 180 THEN raise_error('Longitude out of range') ELSE true END")
    )
