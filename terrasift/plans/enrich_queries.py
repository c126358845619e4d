"""Enrichment joins, boundaries, layers, geometry functions, imagery, boxes and metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.functions import geo, text
from terrasift.operators import boxes, enrich, imagery, metrics, polygons, spatial
from terrasift.plans.registry import query
from terrasift.plans.screening import m_sql
from terrasift.plans.serving_queries import simple
from terrasift.plans.tables import Tables
from terrasift.session import cut_lineage, scratch_dir
from terrasift.sources import fingerprint, geojson

_D = "sqrt((s.x - p.x) * (s.x - p.x) + (s.y - p.y) * (s.y - p.y))"


@query("nearest_place_within", f"""SELECT s.kiln_id, m.name AS nearest_place, {m_sql('m.d')} AS dist_m FROM sites_xy s LEFT JOIN (
SELECT s.kiln_id, min({_D}) AS d, arg_min(p.name, ({_D}, p.name)) AS name FROM sites_xy s JOIN places_xy p ON {_D} <= 2000 GROUP BY 1) m USING (kiln_id)""")
def place(t: Tables) -> DataFrame:
    out = enrich.nearest_place(cut_lineage(t.sites_xy().select("kiln_id", "x", "y"), "s"), t.places_xy(), "kiln_id")
    return out.selectExpr("kiln_id", "nearest_place", f"{m_sql('nearest_place_dist_m')} AS dist_m")


_IN = "lon > west AND lon < east AND lat > south AND lat < north"


@query("point_in_polygon", f'SELECT kiln_id, "shapeName" AS upazila FROM sites LEFT JOIN boundaries ON {_IN}')
def upazila(t: Tables) -> DataFrame:
    return polygons.point_in_polygon(t.sites(), t.boundaries(), "kiln_id", ["shapeName"]).selectExpr("kiln_id", "shapeName AS upazila")


@query("clip_points_to_district", f'SELECT feature_id, layer FROM features JOIN boundaries ON "shapeName" = district AND {_IN}')
def clip(t: Tables) -> DataFrame:
    index = polygons.cells(t.boundaries().withColumnRenamed("shapeName", "district"), ["district"])
    inside = polygons.containing(t.features(), index, "feature_id", ["district"], on=["district"])
    return t.features().join(inside.select("feature_id"), "feature_id", "left_semi").select("feature_id", "layer")


_BOX_RUN = " ".join("""lo AS (SELECT *, greatest(0e0, least((west - lon) / nullif(lon2 - lon, 0), (east - lon) / nullif(lon2 - lon, 0)),
least((south - lat) / nullif(lat2 - lat, 0), (north - lat) / nullif(lat2 - lat, 0))) AS a, least(1e0, greatest((west - lon) / nullif(lon2 - lon, 0), (east - lon) / nullif(lon2 - lon, 0)),
greatest((south - lat) / nullif(lat2 - lat, 0), (north - lat) / nullif(lat2 - lat, 0))) AS b FROM rail_segments JOIN boundaries ON "shapeName" = district
WHERE (lon2 <> lon OR (lon > west AND lon < east)) AND (lat2 <> lat OR (lat > south AND lat < north)) AND (lon2 <> lon OR lat2 <> lat))""".split())


@query("clip_lines_to_district", f"""WITH {_BOX_RUN} SELECT feature_id, {m_sql('lon + a * (lon2 - lon)', 9)} AS from_lon, {m_sql('lat + a * (lat2 - lat)', 9)} AS from_lat,
{m_sql('lon + b * (lon2 - lon)', 9)} AS to_lon, {m_sql('lat + b * (lat2 - lat)', 9)} AS to_lat FROM lo WHERE a < b""")
def clip_lines(t: Tables) -> DataFrame:
    """What of each railway lies in its district."""
    lines = t.rail_segments().selectExpr("feature_id", "district", "array(struct(lon AS x, lat AS y), struct(lon2 AS x, lat2 AS y)) AS path")
    index = polygons.cells(t.boundaries().withColumnRenamed("shapeName", "district"), ["district"])
    cut = polygons.clip_lines(lines, index, "feature_id", ["district"], ["district"])
    ends = {"from_lon": "path[0].x", "from_lat": "path[0].y", "to_lon": "element_at(path, -1).x", "to_lat": "element_at(path, -1).y"}
    return cut.selectExpr("feature_id", *[f"{m_sql(e, 9)} AS {n}" for n, e in ends.items()])


@query("closure_to_nearest_site", f"""SELECT place_id, round(min({_D}), 1) AS nearest_detection_m, arg_min(s.kiln_id, ({_D}, s.kiln_id)) AS kiln_id
FROM places_xy p JOIN sites_xy s ON {_D} <= 500 GROUP BY 1 UNION ALL SELECT place_id, NULL, NULL FROM places_xy p WHERE NOT EXISTS (SELECT 1 FROM sites_xy s WHERE {_D} <= 500)""")
def closures(t: Tables) -> DataFrame:
    out = enrich.closure_matches(t.places_xy().select("place_id", "x", "y"), t.sites_xy(), "place_id", 500.0)
    return out.select("place_id", "nearest_detection_m", "kiln_id")


@query("survey_status", f"""SELECT kiln_id, CASE WHEN EXISTS (SELECT 1 FROM features_xy p WHERE {_D} < 200) THEN 'Known (2023-24 survey)' ELSE 'New candidate (2025-26)' END AS detection_status FROM sites_xy s""")
def survey(t: Tables) -> DataFrame:
    sites = cut_lineage(t.sites_xy().select("kiln_id", "x", "y"), "s")
    return enrich.survey_status(sites, t.features_xy(), "kiln_id").select("kiln_id", "detection_status")


_LABELS = """lab AS (SELECT kiln_id AS label_id, lat + (kiln_id % 3) * 0.0006::DOUBLE AS lat, lon, CASE WHEN kiln_id % 2 = 0 THEN 'TP' ELSE 'FP' END AS label FROM sites),
hit AS (SELECT label_id, label, arg_min(s.kiln_id, (sqrt((s.lat - l.lat) ** 2 + (s.lon - l.lon) ** 2), s.kiln_id)) AS kiln_id FROM lab l JOIN sites s
ON s.lat BETWEEN l.lat - 0.001 AND l.lat + 0.001 AND s.lon BETWEEN l.lon - 0.001 AND l.lon + 0.001 AND sqrt((s.lat - l.lat) ** 2 + (s.lon - l.lon) ** 2) < 0.001 GROUP BY 1, 2)"""


def _labels(t: Tables) -> DataFrame:
    return t.sites().selectExpr("kiln_id AS label_id", "lat + (kiln_id % 3) * 0.0006D AS lat", "lon", "CASE WHEN kiln_id % 2 = 0 THEN 'TP' ELSE 'FP' END AS label")


@query("labels_by_degree_distance", f"""WITH {_LABELS} SELECT kiln_id, CASE l WHEN 'TP' THEN 'Verified kiln' WHEN 'FP' THEN 'False positive' ELSE 'Unreviewed' END AS verified
FROM sites LEFT JOIN (SELECT kiln_id, arg_max(label, label_id) AS l FROM hit GROUP BY 1) USING (kiln_id)""")
def degree_labels(t: Tables) -> DataFrame:
    return enrich.attach_labels(t.sites(), _labels(t), "kiln_id").select("kiln_id", "verified")


@query("precision_of_matched_labels", f"WITH {_LABELS} SELECT count(*) AS n, count(*) FILTER (label = 'TP') AS tp, round(count(*) FILTER (label = 'TP') * 100.0::DOUBLE / count(*), 1) AS pct FROM hit")
def degree_precision(t: Tables) -> DataFrame:
    return enrich.matched_labels(t.sites(), _labels(t), "kiln_id").selectExpr("count(1) AS n", "count_if(label = 'TP') AS tp", "round(count_if(label = 'TP') * 100D / count(1), 1) AS pct")


@query("negative_points")
def negatives(t: Tables) -> DataFrame:
    polygon = t.boundaries().filter("shapeName = 'NATION_12'").withColumnRenamed("shapeName", "name")
    return enrich.negative_points(t.spark, polygon, (89.96, 23.76, 90.04, 23.84), t.sites_xy(), 50, 300.0).select("lat", "lon")


@query("boundary_geojson_scan", 'SELECT "shapeName", 1::INT AS rings, 4::INT AS vertices FROM boundaries')
def geojson_scan(t: Tables) -> DataFrame:
    path = f"{scratch_dir(t.spark)}/boundaries"
    ring = "transform(concat(rings[0], array(rings[0][0])), p -> array(p.x, p.y))"
    feature = f"named_struct('type', 'Feature', 'properties', map('shapeName', shapeName), 'geometry', named_struct('type', 'Polygon', 'coordinates', array({ring})))"
    t.boundaries().selectExpr("'FeatureCollection' AS type", f"array({feature}) AS features").write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)
    return geojson.read_boundaries(t.spark, path).selectExpr("shapeName", "size(rings) AS rings", "size(rings[0]) AS vertices")


@query("boundary_by_name", "SELECT \"shapeName\", west, south, east, north FROM boundaries WHERE lower(\"shapeName\") = 'nation_3'")
def by_name(t: Tables) -> DataFrame:
    return enrich.one_boundary(t.boundaries(), "nation_3").drop("rings")


@query("boundary_by_alias", "SELECT s_suppkey AS id, n_name AS \"shapeName\" FROM supplier LEFT JOIN nation ON n_nationkey = CASE WHEN s_suppkey % 30 = 29 THEN 0 ELSE s_suppkey % 30 END")
def by_alias(t: Tables) -> DataFrame:
    asked = t.raw("supplier").selectExpr("s_suppkey AS id", "CASE s_suppkey % 30 WHEN 29 THEN 'Ol d Náme' ELSE concat('Nation _', s_suppkey % 30) END AS name")
    return enrich.boundary_by_alias(asked, t.boundaries(), {"oldname": "nation_0"}).select("id", "shapeName")


@query("forest_first_source", "SELECT feature_id FROM forests")
def forest_source(t: Tables) -> DataFrame:
    woods = t.forests().select("feature_id")
    return enrich.first_readable([woods.filter("feature_id < 0"), woods, woods.limit(0)], "feature_id")


@query("all_district_layers", "SELECT layer, count(*) AS n, count(DISTINCT district) AS districts FROM features GROUP BY 1")
def all_layers(t: Tables) -> DataFrame:
    path = f"{scratch_dir(t.spark)}/layers"
    t.features().write.mode("overwrite").partitionBy("layer").parquet(path)
    return t.spark.read.parquet(path).groupBy("layer").agg(F.expr("count(1) AS n"), F.expr("count(DISTINCT district) AS districts"))


_TAGS = "map(CASE p_partkey % 3 WHEN 0 THEN 'amenity' WHEN 1 THEN 'natural' ELSE 'landuse' END, CASE p_size % 5 WHEN 0 THEN 'clinic' WHEN 1 THEN 'wetland' WHEN 2 THEN 'reservoir' WHEN 3 THEN 'school' ELSE 'x' END)"


@query("layer_tag_filter", "SELECT p_partkey, p_partkey % 3 = 0 AND p_size % 5 = 0 AS hospital, (p_partkey % 3 = 1 AND p_size % 5 = 1) OR (p_partkey % 3 = 2 AND p_size % 5 = 2) AS water FROM part")
def tags(t: Tables) -> DataFrame:
    df = t.raw("part").selectExpr("p_partkey", f"{_TAGS} AS tags")
    return df.selectExpr("p_partkey", f"{enrich.has_tags('hospitals')} AS hospital", f"{enrich.has_tags('water')} AS water")


@query("feature_provenance", "SELECT feature_id, 'openstreetmap:schools' AS source_layer_id, 'OpenStreetMap contributors' AS source_authority, 'https://example.org/' AS source_url FROM features WHERE layer = 'schools'")
def provenance(t: Tables) -> DataFrame:
    df = enrich.with_provenance(t.features().filter("layer = 'schools'"), "schools", "https://example.org/", "2026-01-01T00:00:00Z")
    return df.select("feature_id", "source_layer_id", "source_authority", "source_url")


@query("merge_district_tables", "SELECT kiln_id, district FROM sites")
def merged(t: Tables) -> DataFrame:
    s = t.sites().select("kiln_id", "district")
    return enrich.merge_districts([s.filter("district < 'NATION_2'"), s.filter("district >= 'NATION_2'")])


@query("append_detections", "SELECT kiln_id, class FROM sites")
def append(t: Tables) -> DataFrame:
    path = f"{scratch_dir(t.spark)}/append-{uuid.uuid4().hex}"
    s = t.sites().select("kiln_id", "class")
    s.filter("class = 'FCBK'").write.mode("overwrite").parquet(path)
    s.filter("class <> 'FCBK'").write.mode("append").parquet(path)
    return t.spark.read.parquet(path)


@query("layer_completeness", f"SELECT district, layer, count(*) AS n, {m_sql('count(*) / any_value(abs((east - west) * 111.32::DOUBLE * cos(radians((south + north) / 2)) * (north - south) * 110.574::DOUBLE))', 6)} AS per_km2 FROM features JOIN boundaries ON \"shapeName\" = district GROUP BY 1, 2")
def completeness(t: Tables) -> DataFrame:
    return enrich.layer_completeness(t.features(), t.boundaries()).selectExpr("district", "layer", "n", f"{m_sql('per_km2', 6)} AS per_km2")


@query("multi_line_explode", "SELECT feature_id, 2::INT AS vertices FROM features WHERE layer = 'railways' UNION ALL SELECT feature_id, 3 FROM features WHERE layer = 'railways' AND feature_id % 2 = 0")
def lines(t: Tables) -> DataFrame:
    a, b = "named_struct('x', lon, 'y', lat)", "named_struct('x', lon + 1, 'y', lat)"
    df = t.features().filter("layer = 'railways'").selectExpr("feature_id", f"array(array({a}, {b}), CASE WHEN feature_id % 2 = 0 THEN array({a}, {b}, {a}) ELSE array({a}) END) AS lines")
    return enrich.explode_lines(df).selectExpr("feature_id", "size(line) AS vertices")


# ---- Geometry and text functions ---------------------------------------------------

@query("pixel_to_geographic", f"SELECT chip, pos, {m_sql('90.0::DOUBLE + (pos % 8) * 0.0001::DOUBLE', 9)} AS lon, {m_sql('24.0::DOUBLE - (pos // 8) * 0.0001::DOUBLE', 9)} AS lat FROM pixels")
def affine(t: Tables) -> DataFrame:
    df = t.pixels().withColumn("m", F.expr("array(0.0001D, 0D, 90.0D, 0D, -0.0001D, 24.0D)"))
    lon, lat = geo.pixel_to_geo(F.expr("pos % 8"), F.expr("floor(pos / 8)"), F.col("m"))
    return df.select("chip", "pos", lon.alias("lon"), lat.alias("lat")).selectExpr("chip", "pos", f"{m_sql('lon', 9)} AS lon", f"{m_sql('lat', 9)} AS lat")


_TILES = "list_distinct(list_concat(range(0, greatest(w - 128, 0) + 1, 98), [greatest(w - 128, 0)]))"


@query("tile_starts_and_count", f"SELECT p_partkey, array_to_string(list_sort({_TILES}), ',') AS starts, len({_TILES})::INT AS n FROM (SELECT p_partkey, (p_size * 37)::INT AS w FROM part)")
def tiles(t: Tables) -> DataFrame:
    df = t.raw("part").selectExpr("p_partkey", "p_size * 37 AS w").withColumn("s", geo.tile_starts(F.col("w"), 128, 98))
    return df.selectExpr("p_partkey", "array_join(array_sort(s), ',') AS starts", "size(s) AS n")


@query("tile_windows", f"SELECT p_partkey, unnest({_TILES}) AS start FROM (SELECT p_partkey, (p_size * 37)::INT AS w FROM part WHERE p_size * 37 >= 64)")
def windows(t: Tables) -> DataFrame:
    df = t.raw("part").selectExpr("p_partkey", "p_size * 37 AS w").withColumn("start", F.explode(geo.tile_starts(F.col("w"), 128, 98)))
    return df.filter("least(128, w - start) >= 64").select("p_partkey", "start")


@query("box_centroids_and_areas", "SELECT scene, box_id, left_x + 3 AS cx, low_y + 3 AS cy, 36.0::DOUBLE AS area FROM detections")
def centroids(t: Tables) -> DataFrame:
    cx, cy = geo.quad_centroid("xy")
    return t.detections().select("scene", "box_id", cx.alias("cx"), cy.alias("cy"), geo.quad_area("xy").alias("area"))


@query("chip_box_centre", "SELECT scene, box_id, (4 * left_x + 12) / 4 AS cx, (4 * low_y + 12) / 4 AS cy FROM detections")
def chip_centre(t: Tables) -> DataFrame:
    mean = "aggregate(filter(xy, (v, i) -> i % 2 = {}), 0D, (a, v) -> a + v) / 4 AS {}"
    return t.detections().selectExpr("scene", "box_id", mean.format(0, "cx"), mean.format(1, "cy"))


@query("boxes_inside_polygon", "SELECT scene, box_id FROM detections WHERE left_x + 3 > 4 AND left_x + 3 < 8 AND low_y + 3 > 2 AND low_y + 3 < 7")
def inside_boxes(t: Tables) -> DataFrame:
    ring = [[(4.0, 2.0), (8.0, 2.0), (8.0, 7.0), (4.0, 7.0)]]
    area = t.spark.createDataFrame([("d", ring)], "name string, rings array<array<struct<x double, y double>>>")
    centred = t.detections().selectExpr("scene", "box_id", "struct(scene, box_id) AS k", "left_x + 3 AS lon", "low_y + 3 AS lat")
    return polygons.point_in_polygon(centred, area, "k", ["name"], how="left_semi").select("scene", "box_id")


@query("radius_box", f"SELECT kiln_id, {m_sql('lat - 1000.0::DOUBLE / 110574', 9)} AS south, {m_sql('lon + 1000.0::DOUBLE / (111320 * cos(radians(lat)))', 9)} AS east FROM sites")
def radius_box(t: Tables) -> DataFrame:
    s, w, n, e = geo.radius_box(F.col("lat"), F.col("lon"), 1000.0)
    return t.sites().select("kiln_id", s.alias("s"), e.alias("e")).selectExpr("kiln_id", f"{m_sql('s', 9)} AS south", f"{m_sql('e', 9)} AS east")


@query("box_area_km2", f"SELECT \"shapeName\", {m_sql('abs((east - west) * 111.32::DOUBLE * cos(radians((south + north) / 2)) * (north - south) * 110.574::DOUBLE)', 6)} AS km2 FROM boundaries")
def box_area(t: Tables) -> DataFrame:
    return t.boundaries().select("shapeName", geo.bbox_area_km2(*[F.col(c) for c in ("west", "south", "east", "north")]).alias("a")).selectExpr("shapeName", f"{m_sql('a', 6)} AS km2")


@query("polygon_bounds", 'SELECT "shapeName", west, south, east, north FROM boundaries')
def bounds(t: Tables) -> DataFrame:
    b = geo.ring_bounds(F.col("rings")[0])
    return t.boundaries().select("shapeName", *[c.alias(n) for c, n in zip(b, ("west", "south", "east", "north"))])


@query("mean_longitude", f"SELECT {m_sql('avg(lon)', 6)} AS lon FROM sites")
def mean_lon(t: Tables) -> DataFrame:
    return enrich.mean_longitude(t.sites()).selectExpr(f"{m_sql('lon', 6)} AS lon")


simple("utm_zone", ["kiln_id", "CASE WHEN lon < 90 THEN 32645 ELSE 32646 END AS epsg"], "SELECT kiln_id, CASE WHEN lon < 90 THEN 32645 ELSE 32646 END AS epsg FROM sites", table="sites")


@query("chebyshev_distance", "SELECT kiln_id, " + m_sql("greatest(abs(x - 500000), abs(y - 2650000))") + " AS d FROM sites_xy")
def cheb(t: Tables) -> DataFrame:
    d = geo.chebyshev(F.col("x"), F.col("y"), F.lit(500000.0), F.lit(2650000.0))
    return t.sites_xy().select("kiln_id", d.alias("v")).selectExpr("kiln_id", f"{m_sql('v')} AS d")


@query("fold_names", "SELECT doc_id, lower(regexp_replace(strip_accents(text), '\\s+', '', 'g')) AS folded FROM documents")
def fold(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", text.fold_name("text").alias("folded"))


@query("fold_alphanumeric", "SELECT page_id, regexp_replace(lower(url), '[^a-z0-9]', '', 'g') AS folded FROM pages")
def fold_alnum(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", text.fold_alphanumeric("url").alias("folded"))


@query("district_from_file_name", "SELECT 'tile ' || s_suppkey || ' lang' || s_suppkey % 30 || '.tif' AS file, 'lang' || s_suppkey % 30 AS district FROM supplier WHERE s_suppkey % 30 < 25")
def file_district(t: Tables) -> DataFrame:
    files = t.raw("supplier").selectExpr("concat('tile ', s_suppkey, ' lang', s_suppkey % 30, '.tif') AS file")
    return enrich.districts_in_names(files, t.raw("nation").selectExpr("concat('lang', n_nationkey) AS district"))


@query("safe_float_cast", "SELECT page_id, try_cast(CASE WHEN page_id % 3 = 0 THEN url ELSE page_id || '.5' END AS DOUBLE) AS v FROM pages")
def safe_cast(t: Tables) -> DataFrame:
    return t.raw("pages").selectExpr("page_id", "try_cast(CASE WHEN page_id % 3 = 0 THEN url ELSE concat(page_id, '.5') END AS double) AS v")


@query("first_non_blank_name", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_type END AS name FROM part")
def first_name(t: Tables) -> DataFrame:
    df = t.raw("part").selectExpr("p_partkey", "CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE ' ' END AS en", "CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS nm", "p_type AS bn")
    return df.selectExpr("p_partkey", "coalesce(nullif(trim(en), ''), nullif(trim(nm), ''), nullif(trim(bn), '')) AS name")


_TOK = "list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: length(w) > 1))"


@query("best_text_match", f"""WITH q AS (SELECT conv_id * 1000 + turn AS id, {_TOK} AS t FROM conversations), c AS (SELECT item_id AS cand, {_TOK} AS t FROM benchmark),
sh AS (SELECT id, cand, len(list_intersect(q.t, c.t)) AS k, len(q.t) AS nq, len(c.t) AS nc FROM q, c), sc AS (SELECT id, cand, 2.0::DOUBLE * k / (nq + nc) AS score FROM sh WHERE k > 0 AND (k >= 2 OR nq = 1))
SELECT q.id, b.cand, b.score FROM q LEFT JOIN (SELECT * FROM sc WHERE score >= 0.34 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, cand) = 1) b USING (id)""")
def text_match(t: Tables) -> DataFrame:
    asked = t.raw("conversations").selectExpr("conv_id * 1000 + turn AS id", "text")
    return enrich.best_text_match(asked, t.raw("benchmark").selectExpr("item_id AS cand", "text"))


# ---- Boxes --------------------------------------------------------------------------

_IOU = "(greatest(0, 6 - abs(a.left_x - b.left_x)) * greatest(0, 6 - abs(a.low_y - b.low_y))) / (72 - greatest(0, 6 - abs(a.left_x - b.left_x)) * greatest(0, 6 - abs(a.low_y - b.low_y)))"


@query("suppress_overlapping_boxes", f"SELECT scene, box_id FROM detections a WHERE NOT EXISTS (SELECT 1 FROM detections b WHERE a.scene = b.scene AND (b.conf > a.conf OR (b.conf = a.conf AND b.box_id < a.box_id)) AND {_IOU} > 0.5)")
def suppress(t: Tables) -> DataFrame:
    return boxes.suppress(t.detections(), 0.5).select("scene", "box_id")


def _matching_sql(rank: str, select: str) -> str:
    """One prediction of every scene after the other, with the list of truths taken so far."""
    return f"""WITH RECURSIVE e AS (SELECT a.scene, a.box_id AS pred, {rank} AS rank, b.box_id AS truth, {_IOU} AS iou
  FROM detections a JOIN truths b ON a.scene = b.scene AND a.class_id = b.class_id AND {_IOU} >= 0.5),
o AS (SELECT scene, pred, row_number() OVER (PARTITION BY scene ORDER BY min(rank), pred) AS k, list(truth ORDER BY iou DESC, truth DESC) AS opts FROM e GROUP BY 1, 2),
st AS (SELECT DISTINCT scene, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS pred, NULL::BIGINT AS truth FROM o
  UNION ALL SELECT scene, k, CASE WHEN truth IS NULL THEN used ELSE list_append(used, truth) END, pred, truth FROM (
    SELECT o.scene, o.k, st.used, o.pred, list_filter(o.opts, lambda t: NOT list_contains(st.used, t))[1] AS truth
    FROM st JOIN o ON o.scene = st.scene AND o.k = st.k + 1))
{select}"""


_MATCHED = "SELECT scene, pred, truth FROM st WHERE truth IS NOT NULL"


@query("best_overlap_matches", _matching_sql("a.box_id", _MATCHED))
def best_overlap(t: Tables) -> DataFrame:
    return boxes.best_overlap(t.detections(), t.truths(), 0.5).select("scene", "pred", "truth")


@query("greedy_box_matching", _matching_sql("-a.conf", _MATCHED))
def greedy(t: Tables) -> DataFrame:
    return boxes.match_greedy(t.detections(), t.truths(), 0.5).select("scene", "pred", "truth")


@query("top_false_positives", _matching_sql("-a.conf", f"""SELECT scene, box_id, conf FROM detections d
WHERE NOT EXISTS (SELECT 1 FROM ({_MATCHED}) m WHERE m.scene = d.scene AND m.pred = d.box_id) ORDER BY conf DESC, scene, box_id LIMIT 20"""))
def top_fp(t: Tables) -> DataFrame:
    matched = boxes.match_greedy(t.detections(), t.truths(), 0.5)
    return boxes.false_positives(t.detections(), matched).orderBy(F.desc("conf"), "scene", "box_id").limit(20).select("scene", "box_id", "conf")


@query("polygon_iou_pairs", f"SELECT a.scene, a.box_id, b.box_id AS truth, {m_sql(_IOU, 9)} AS iou FROM detections a JOIN truths b ON a.scene = b.scene AND a.class_id = b.class_id AND {_IOU} >= 0.3")
def iou_pairs(t: Tables) -> DataFrame:
    pairs = boxes.candidate_pairs(t.detections(), t.truths(), 0.3)
    return pairs.selectExpr("scene", "pred AS box_id", "truth", f"{m_sql('iou', 9)} AS iou")


@query("detections_as_points", "SELECT box_id, scene, CASE class_id WHEN 0 THEN 'FCBK' ELSE 'Zigzag' END AS class_name, conf AS confidence, left_x + 3 AS lon, low_y + 3 AS lat FROM detections")
def as_points(t: Tables) -> DataFrame:
    lon, lat = geo.quad_centroid("xy")
    return t.detections().select("box_id", "scene", F.expr("CASE class_id WHEN 0 THEN 'FCBK' ELSE 'Zigzag' END AS class_name"), F.col("conf").alias("confidence"), lon.alias("lon"), lat.alias("lat"))


# ---- Imagery ------------------------------------------------------------------------

_U8 = "list_transform(px, lambda v: trunc((v - list_min(px)) / (list_max(px) - list_min(px) + 1e-5::DOUBLE) * 255)::INT)"
_PAIR = f"""u AS (SELECT chip, {_U8} AS px FROM patches), pp AS (SELECT a.chip, unnest(range(64)) AS pos, unnest(a.px)::DOUBLE AS a, unnest(b.px)::DOUBLE AS b FROM u a JOIN u b ON b.chip = a.chip + 1)"""


def _stretched(t: Tables) -> DataFrame:
    return t.patches().selectExpr("chip", f"{imagery.minmax_uint8()} AS px")


def _pairs(t: Tables) -> DataFrame:
    u = cut_lineage(_stretched(t), "u8")
    return imagery.pair_pixels(u, u.selectExpr("chip - 1 AS chip", "px"))


@query("minmax_uint8", f"SELECT chip, array_to_string({_U8}, ',') AS px FROM patches")
def uint8(t: Tables) -> DataFrame:
    return _stretched(t).selectExpr("chip", "array_join(px, ',') AS px")


@query("channel_differences", f"""WITH {_PAIR} SELECT chip, {m_sql('avg(b) - avg(a)', 6)} AS mean_difference, {m_sql('stddev_pop(b) - stddev_pop(a)', 6)} AS std_difference,
{m_sql('quantile_cont(b, 0.01) - quantile_cont(a, 0.01)', 6)} AS p1_difference, {m_sql('quantile_cont(b, 0.5) - quantile_cont(a, 0.5)', 6)} AS p50_difference, {m_sql('quantile_cont(b, 0.99) - quantile_cont(a, 0.99)', 6)} AS p99_difference FROM pp GROUP BY 1""")
def channel_diff(t: Tables) -> DataFrame:
    out = imagery.channel_differences(_pairs(t))
    return out.selectExpr("chip", *[f"{m_sql(c, 6)} AS {c}" for c in out.columns if c != "chip"])


@query("suggested_divisor", f"WITH {_PAIR} SELECT {m_sql('median(m)', 9)} AS divisor FROM (SELECT chip, median(a / b) AS m FROM pp WHERE b > 0 GROUP BY 1)")
def divisor(t: Tables) -> DataFrame:
    per_chip = cut_lineage(imagery.suggested_divisors(_pairs(t)), "divisors")
    return imagery.exact_quantile(per_chip, "suggested_divisor", 0.5, "d").selectExpr(f"{m_sql('d', 9)} AS divisor")


@query("raster_statistics", "SELECT pos % 3 AS band, min(v) AS low, max(v) AS high, avg((v = 1000)::INT) AS zero_fraction, count(*) AS n FROM pixels GROUP BY 1")
def raster(t: Tables) -> DataFrame:
    return t.pixels().groupBy(F.expr("pos % 3 AS band")).agg(F.expr("min(v) AS low"), F.expr("max(v) AS high"), F.expr("avg(if(v = 1000, 1, 0)) AS zero_fraction"), F.expr("count(1) AS n"))


@query("masked_tile_fraction", "SELECT avg((len(list_filter(px, lambda v: v = 1000)) > 0)::INT) AS masked FROM patches")
def masked(t: Tables) -> DataFrame:
    return t.patches().selectExpr("avg(if(exists(px, v -> v = 1000), 1, 0)) AS masked")


@query("pearson_per_chip", f"WITH {_PAIR} SELECT chip, {m_sql('corr(a, b)', 6)} AS r FROM pp GROUP BY 1")
def pearson(t: Tables) -> DataFrame:
    return imagery.pearson(_pairs(t)).selectExpr("chip", f"{m_sql('r', 6)} AS r")


@query("histogram_distance", f"WITH {_PAIR}, h AS (SELECT chip, k, sum(d) AS d FROM (SELECT chip, floor(a / 8) AS k, 1 AS d FROM pp UNION ALL SELECT chip, floor(b / 8), -1 FROM pp) GROUP BY 1, 2) SELECT chip, {m_sql('sum(abs(d)) / 128.0::DOUBLE', 6)} AS hist FROM h GROUP BY 1")
def hist(t: Tables) -> DataFrame:
    return imagery.histogram_distance(_pairs(t)).selectExpr("chip", f"{m_sql('hist', 6)} AS hist")


@query("best_pixel_alignment", f"""WITH u AS (SELECT chip, {_U8} AS px FROM patches), p AS (SELECT chip, (unnest(range(64)) % 8) AS x, unnest(range(64)) // 8 AS y, unnest(px)::DOUBLE AS v FROM u),
j AS (SELECT a.chip, dx, dy, a.v AS a, b.v AS b FROM p a, (VALUES (-1), (0), (1)) o(dx), (VALUES (-1), (0), (1)) q(dy), p b WHERE b.chip = a.chip + 1 AND b.x = a.x + dx AND b.y = a.y + dy),
r AS (SELECT chip, dx, dy, corr(a, b) AS r, count(*) AS n FROM j GROUP BY 1, 2, 3), h AS (SELECT chip, dx, dy, sum(abs(d)) AS s FROM (SELECT chip, dx, dy, k, sum(d) AS d FROM (SELECT chip, dx, dy, floor(a / 8) AS k, 1 AS d FROM j UNION ALL SELECT chip, dx, dy, floor(b / 8), -1 FROM j) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)
SELECT chip, dx, dy, n AS compared_pixels FROM r JOIN h USING (chip, dx, dy) QUALIFY row_number() OVER (PARTITION BY chip ORDER BY -round(r, 9), round(s / (2.0::DOUBLE * n), 9), abs(dx) + abs(dy), dy, dx) = 1""")
def alignment(t: Tables) -> DataFrame:
    u = cut_lineage(_stretched(t), "u8")
    return imagery.best_alignment(u, u.selectExpr("chip - 1 AS chip", "px"), 8).select("chip", "dx", "dy", "compared_pixels")


@query("cloud_masked_composite", "SELECT chip % 10 AS tile, pos, median(v) AS v, count(*) AS observations FROM pixels WHERE ((chip * 7 + pos) % 2048) & 1024 = 0 GROUP BY 1, 2")
def composite(t: Tables) -> DataFrame:
    px = t.pixels().selectExpr("chip % 10 AS tile", "pos", "v", "(chip * 7 + pos) % 2048 AS qa")
    return imagery.composite(px, ["tile", "pos"])


@query("scene_catalogue_filter", "SELECT scene_id, scene_date, cloud FROM scenes WHERE lat BETWEEN 23.7 AND 23.9 AND lon BETWEEN 89.9 AND 90.1 AND scene_date >= DATE '1996-01-01' AND scene_date < DATE '1999-01-01' AND cloud < 20")
def catalogue(t: Tables) -> DataFrame:
    near = t.scenes().filter("lat BETWEEN 23.7 AND 23.9 AND lon BETWEEN 89.9 AND 90.1 AND scene_date >= DATE'1996-01-01' AND scene_date < DATE'1999-01-01' AND cloud < 20")
    return near.orderBy("scene_date", "scene_id").select("scene_id", "scene_date", "cloud")


@query("valid_pixel_summary", "SELECT chip, count(*) FILTER ((pos * chip) % 5 <> 0) AS valid_pixels, avg(((pos * chip) % 5 <> 0)::INT) AS valid_fraction, CASE WHEN count(*) FILTER ((pos * chip) % 5 <> 0) = 0 THEN 'no_valid_pixels' ELSE 'ok' END AS status FROM pixels GROUP BY 1")
def valid_pixels(t: Tables) -> DataFrame:
    ok = "(pos * chip) % 5 <> 0"
    return t.pixels().groupBy("chip").agg(F.expr(f"count_if({ok}) AS valid_pixels"), F.expr(f"avg(if({ok}, 1, 0)) AS valid_fraction")).selectExpr("*", "CASE WHEN valid_pixels = 0 THEN 'no_valid_pixels' ELSE 'ok' END AS status")


@query("same_name_file_sets", "SELECT count(*) FILTER (l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL) AS common, count(*) FILTER (d.doc_id IS NULL) AS only_left, count(*) FILTER (l.doc_id IS NULL) AS only_right FROM labels l FULL JOIN documents d ON l.doc_id = d.doc_id")
def file_sets(t: Tables) -> DataFrame:
    a, b = t.raw("labels").selectExpr("doc_id", "1 AS l"), t.raw("documents").selectExpr("doc_id", "1 AS r")
    return a.join(b, "doc_id", "full_outer").selectExpr("count_if(l = 1 AND r = 1) AS common", "count_if(r IS NULL) AS only_left", "count_if(l IS NULL) AS only_right")


# ---- Metrics ------------------------------------------------------------------------

_BEST = "SELECT stage, epoch, map50 FROM epochs QUALIFY row_number() OVER (PARTITION BY stage ORDER BY fitness DESC, epoch) = 1"


@query("best_epoch_metric", _BEST)
def best_epoch(t: Tables) -> DataFrame:
    return metrics.best_epoch(t.epochs())


@query("best_stage", f"SELECT stage, map50 FROM ({_BEST}) ORDER BY map50 DESC, stage LIMIT 1")
def best_stage(t: Tables) -> DataFrame:
    return metrics.best_stage(metrics.best_epoch(t.epochs())).select("stage", "map50")


@query("epoch_windows", 'SELECT stage, epoch, floor((epoch - 1) / 10.0)::BIGINT AS "window" FROM epochs')
def epoch_windows(t: Tables) -> DataFrame:
    return metrics.epoch_windows(t.epochs(), 10).select("stage", "epoch", "window")


@query("archived_epoch_windows", 'SELECT stage, w AS "window", count(*) AS n FROM (SELECT stage, floor((epoch - 1) / 10.0)::INT AS w FROM epochs) GROUP BY 1, 2 HAVING count(*) = 10')
def archived(t: Tables) -> DataFrame:
    path = f"{scratch_dir(t.spark)}/epochs-{uuid.uuid4().hex}"
    rows = cut_lineage(t.epochs(), "epochs")
    metrics.archive_windows(rows, path, 10)
    metrics.archive_windows(rows, path, 10)
    return t.spark.read.parquet(path).groupBy("stage", "window").agg(F.expr("count(1) AS n"))


@query("metric_csv_scan", "SELECT stage, epoch, map50 FROM epochs")
def metric_csv(t: Tables) -> DataFrame:
    path = f"{scratch_dir(t.spark)}/metrics_csv"
    t.epochs().selectExpr("stage", "epoch AS ` epoch`", "map50 AS `map50 `").write.mode("overwrite").csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    raw = t.spark.read.csv(path, header=True)
    clean = raw.toDF(*[c.strip().lstrip("﻿") for c in raw.columns])
    return clean.selectExpr("stage", "cast(epoch AS int) AS epoch", "cast(map50 AS double) AS map50")


@query("dataset_fingerprint")
def fingerprint_of_files(t: Tables) -> DataFrame:
    return fingerprint.dataset_fingerprint(fingerprint.file_digests(t.spark, t.dir, "*.parquet"))
