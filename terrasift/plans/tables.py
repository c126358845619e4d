"""Logical tables derived from the shared star schema, in Spark and in SQL.

The source tables carry no coordinates, so positions, classes and labels are derived from
keys with integer arithmetic that both engines compute identically.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.functions import geo

SOUTH, WEST, SPAN = 23.6, 89.8, 0.4
CHIP_SOUTH, CHIP_WEST, CHIP_SPAN = 23.0, 89.5, 0.7
LAYERS = ("schools", "hospitals", "settlements", "railways", "water", "government_forest")
PLACE_TYPES = ("city", "town", "suburb", "village", "hamlet", "locality")
BOX_SIDE = 0.08
SERVED_DISTANCES = (("schools", 31), ("hospitals", 97), ("settlements", 57), ("railways", 71), ("water", 43), ("government_forest", 83))
SERVED_SIGNALS = (("schools", "near_school"), ("hospitals", "near_hospital"), ("water", "near_wetland"))


def _at(key: str, mult: int, mod: int, low: float, span: float) -> Column:
    part = F.pmod(F.col(key) * F.lit(mult), F.lit(mod).cast("long")).cast("double")
    return F.lit(low) + part / F.lit(float(mod)) * F.lit(span)


def _at_sql(key: str, mult: int, mod: int, low: float, span: float) -> str:
    return f"{low}::DOUBLE + (({key} * {mult}) % {mod})::DOUBLE / {mod}.0::DOUBLE * {span}::DOUBLE"


def _pick(key: Column, values) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def _pick_sql(key: str, values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][({key}) % {len(values)} + 1]"


class Tables:
    """The logical tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _nations(self) -> DataFrame:
        return self.raw("nation").select("n_nationkey", F.col("n_name").alias("district"))

    def sites(self, *more: str) -> DataFrame:
        """The sites; ``more`` names further columns of their source, so that it is scanned once."""
        c = self.raw("customer").select("c_custkey", "c_nationkey", "c_mktsegment", *more)
        joined = c.join(self._nations(), F.col("c_nationkey") == F.col("n_nationkey"))
        return joined.select(
            F.col("c_custkey").alias("kiln_id"),
            _at("c_custkey", 7919, 10007, SOUTH, SPAN).alias("lat"),
            _at("c_custkey", 104729, 10009, WEST, SPAN).alias("lon"),
            "district",
            F.concat("district", F.lit("-U"), F.pmod("c_custkey", F.lit(7))).alias("upazila"),
            F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "FCBK").otherwise("Zigzag").alias("class"),
            (F.pmod(F.col("c_custkey") * 31, F.lit(1000)) / F.lit(1000.0)).alias("confidence"),
            *more,
        )

    def sites_xy(self) -> DataFrame:
        return geo.project(self.sites())

    def features(self) -> DataFrame:
        p = self.raw("part").select("p_partkey", "p_size", "p_name")
        near = self._nations()
        slot = F.pmod(F.floor(F.col("p_partkey") / 6), F.lit(25))
        return p.withColumn("_slot", slot).join(near, F.col("_slot") == F.col("n_nationkey")).select(
            F.col("p_partkey").alias("feature_id"),
            _at("p_partkey", 6151, 10037, SOUTH, SPAN).alias("lat"),
            _at("p_partkey", 7411, 10039, WEST, SPAN).alias("lon"),
            _pick(F.col("p_partkey"), LAYERS).alias("layer"),
            "district",
            F.col("p_name").alias("name"),
            F.col("p_size").alias("size"),
        )

    def features_xy(self) -> DataFrame:
        return geo.project(self.features())

    def rail_segments(self) -> DataFrame:
        """Railway features as short segments around their position."""
        half = F.pmod("feature_id", F.lit(7)) - 3
        side = F.pmod("feature_id", F.lit(5)) - 2
        rails = self.features().filter("layer = 'railways'").withColumns(
            {"lat2": F.col("lat") + half * F.lit(0.001), "lon2": F.col("lon") + side * F.lit(0.001)}
        )
        return geo.project(
            geo.project(rails, x="x1", y="y1"), lat="lat2", lon="lon2", x="x2", y="y2"
        )

    def _square_rings(self, layer: str, half: Column) -> DataFrame:
        f = self.features().filter(F.col("layer") == layer).withColumn("h", half)
        corners = [(-1, -1), (1, -1), (1, 1), (-1, 1)]
        for i, (sx, sy) in enumerate(corners):
            f = f.withColumns(
                {f"_a{i}": F.col("lat") + F.lit(float(sy)) * F.col("h"), f"_o{i}": F.col("lon") + F.lit(float(sx)) * F.col("h")}
            )
            f = geo.project(f, lat=f"_a{i}", lon=f"_o{i}", x=f"_x{i}", y=f"_y{i}")
        ring = F.array(*[F.struct(F.col(f"_x{i}").alias("x"), F.col(f"_y{i}").alias("y")) for i in range(4)])
        return f.select("feature_id", "district", "layer", "name", "lat", "lon", "h", ring.alias("ring"))

    def forests(self) -> DataFrame:
        """Forest polygons (squares in degrees), projected rings."""
        squares = self._square_rings("government_forest", (F.pmod("feature_id", F.lit(5)) + 1) * F.lit(0.001))
        return squares.withColumn("rings", F.array("ring"))

    def settlement_polygons(self) -> DataFrame:
        return self._square_rings("settlements", (F.pmod("feature_id", F.lit(4)) + 1) * F.lit(0.0015))

    def places(self) -> DataFrame:
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("place_id"),
            F.col("s_name").alias("name"),
            _pick(F.col("s_suppkey"), PLACE_TYPES).alias("place_type"),
            _at("s_suppkey", 3571, 10061, SOUTH, SPAN).alias("lat"),
            _at("s_suppkey", 2903, 10067, WEST, SPAN).alias("lon"),
        )

    def places_xy(self) -> DataFrame:
        return geo.project(self.places())

    def boundaries(self) -> DataFrame:
        """One square per nation on a 5 x 5 grid over the site area."""
        n = self.raw("nation")
        west = F.lit(WEST) + F.pmod("n_nationkey", F.lit(5)) * F.lit(BOX_SIDE)
        south = F.lit(SOUTH) + F.floor(F.col("n_nationkey") / 5) * F.lit(BOX_SIDE)
        east, north = west + F.lit(BOX_SIDE), south + F.lit(BOX_SIDE)
        ring = F.array(
            *[F.struct(x.alias("x"), y.alias("y")) for x, y in ((west, south), (east, south), (east, north), (west, north))]
        )
        return n.select(
            F.col("n_name").alias("shapeName"), west.alias("west"), south.alias("south"),
            east.alias("east"), north.alias("north"), F.array(ring).alias("rings"),
        )

    def chips(self) -> DataFrame:
        lat = _at("p_partkey", 7919, 10007, CHIP_SOUTH, CHIP_SPAN)
        lon = _at("p_partkey", 104729, 10009, CHIP_WEST, CHIP_SPAN)
        line = F.transform(
            F.filter(F.sequence(F.lit(0), F.lit(2)), lambda i: i < F.col("p_size") % 4),
            lambda i: F.concat(((F.col("p_size") + i) % 3).cast("string"), F.lit(" 0.10 0.20 0.30 0.20 0.30 0.40 0.10 0.40")),
        )
        return self.raw("part").select(
            F.col("p_partkey").alias("chip_id"),
            F.concat(F.round(lat, 5).cast("decimal(12,5)"), F.lit("_"), F.round(lon, 5).cast("decimal(12,5)"), F.lit(".png")).alias("image_name"),
            _pick(F.col("p_partkey"), ("train", "val", "test")).alias("split"),
            line.alias("labels"),
        )

    def served(self) -> DataFrame:
        """Sites as the serving layer sees them: ranks, bands, statuses, distances, nulls."""
        return self.sites("c_acctbal").selectExpr(
            "kiln_id", "lat", "lon", "district",
            "CASE WHEN kiln_id % 13 = 0 THEN ' ' ELSE upazila END AS upazila", "class",
            "CASE WHEN kiln_id % 3 <> 0 THEN class END AS class_name", "confidence",
            "CASE WHEN kiln_id % 17 <> 0 THEN c_acctbal END AS priority",
            "CASE WHEN kiln_id % 19 <> 0 THEN (kiln_id * 37) % 2001 + 1 END AS priority_rank",
            "CASE WHEN kiln_id % 23 = 0 THEN NULL WHEN kiln_id % 5 = 0 THEN 'High' WHEN kiln_id % 5 <= 2 THEN 'Medium' ELSE 'Low' END AS priority_band",
            "CASE WHEN kiln_id % 4 = 0 THEN 'New candidate (2025-26)' ELSE 'Known (2023-24 survey)' END AS detection_status",
            "CASE kiln_id % 9 WHEN 0 THEN 'False positive' WHEN 1 THEN 'Verified kiln' ELSE 'Unreviewed' END AS verified",
            *[f"CASE WHEN kiln_id % {29 + 2 * i} <> 0 THEN (kiln_id * {m}) % 5000 / 2D END AS dist_{n}_m" for i, (n, m) in enumerate(SERVED_DISTANCES)],
        ).selectExpr("*", "array_compact(array(" + ", ".join(f"CASE WHEN dist_{n}_m < 1000D THEN '{r}' END" for n, r in SERVED_SIGNALS) + ")) AS breached_rules")

    def _boxes(self, shift: Column) -> DataFrame:
        l = self.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_tax")
        x = (F.pmod("l_partkey", F.lit(8)) + shift).cast("double")
        y = F.pmod("l_suppkey", F.lit(6)).cast("double")
        return l.select(
            F.col("l_orderkey").alias("scene"),
            (F.col("l_linenumber") * F.lit(10**12) + F.col("l_partkey") * F.lit(10**6) + F.col("l_suppkey")).alias("box_id"),
            F.pmod("l_partkey", F.lit(2)).cast("int").alias("class_id"),
            F.array(x, y, x + 6.0, y, x + 6.0, y + 6.0, x, y + 6.0).alias("xy"),
            (F.round(F.col("l_discount") * 100) * 9 + F.round(F.col("l_tax") * 100)).alias("conf"),
            x.alias("left_x"), y.alias("low_y"),
        )

    def detections(self) -> DataFrame:
        return self._boxes(F.lit(0))

    def truths(self) -> DataFrame:
        return self._boxes(F.pmod("l_suppkey", F.lit(3)))

    def audit(self) -> DataFrame:
        """Two raters' labels per document, with confidence, district and class."""
        d = self.raw("documents").select("doc_id", "lang", "source", "n_chars")
        skip = F.pmod("doc_id", F.lit(11)) == 0
        return self.raw("labels").join(d, "doc_id").select(
            "doc_id", F.col("lang").alias("district"), F.col("source").alias("kiln_class"),
            F.when(skip, "SKIP").when(F.col("quality") == 1, "TP").otherwise("FP").alias("label_a"),
            F.when(skip, "SKIP").when(F.col("toxic") == 0, "TP").otherwise("FP").alias("label_b"),
            (F.pmod(F.col("n_chars") * 37, F.lit(1000)) / F.lit(1000.0)).alias("confidence"),
        ).withColumn("band", F.when(F.col("confidence") < 0.25, "low").when(F.col("confidence") < 0.45, "mid").otherwise("high"))

    def reference_counts(self) -> DataFrame:
        s = self.raw("supplier").join(self._nations(), F.col("s_nationkey") == F.col("n_nationkey"))
        return s.groupBy("district").agg((F.count(F.lit(1)) * 10).alias("reported_count"))

    def reports(self) -> DataFrame:
        e = self.raw("events")
        return e.select(
            F.col("event_id").alias("id"), F.col("user_id").alias("session"), F.col("ts").alias("created_at"),
            F.col("event_type").alias("kind"),
            _at("event_id", 4561, 10079, SOUTH - 0.1, SPAN + 0.2).alias("lat"),
            _at("event_id", 5563, 10091, WEST - 0.1, SPAN + 0.2).alias("lon"),
            F.get_json_object("props", "$.k").cast("int").alias("reason"),
            "value",
        )

    def visits(self) -> DataFrame:
        """Visit updates: one key per user and slot, a status and an assignee."""
        e = self.raw("events")
        k = F.get_json_object("props", "$.k").cast("int")
        return e.select(
            F.col("event_id").alias("seq"), F.col("ts").alias("updated_at"), F.col("user_id").alias("kiln_id"),
            _pick(k, ("planned", "visited", "closed")).alias("status"),
            _pick(F.floor(k / 3), ("amin", "bela")).alias("assignee"),
            F.col("event_type").alias("updated_by"),
        )

    def patches(self) -> DataFrame:
        """Eight-by-eight one-band patches."""
        px = F.transform("embedding", lambda v: F.round(v.cast("double") * 1000) + F.lit(1000.0))
        return self.raw("embeddings").select(F.col("vec_id").alias("chip"), px.alias("px"))

    def pixels(self) -> DataFrame:
        return self.patches().select("chip", F.posexplode("px").alias("pos", "v"))

    def scenes(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("scene_id"), F.to_date("o_orderdate").alias("scene_date"),
            F.pmod("o_orderkey", F.lit(100)).cast("int").alias("cloud"),
            _at("o_custkey", 7919, 10007, SOUTH, SPAN).alias("lat"),
            _at("o_custkey", 104729, 10009, WEST, SPAN).alias("lon"),
        )

    def epochs(self) -> DataFrame:
        """Training metrics: one row per stage and day of the order history."""
        o = self.raw("orders")
        day = F.datediff("o_orderdate", F.lit("1995-01-01"))
        cents = F.round(F.col("o_totalprice") * 100).cast("long")
        return o.groupBy(F.col("o_orderpriority").alias("stage"), day.alias("epoch")).agg(
            F.sum(F.pmod(cents, F.lit(1000))).alias("m"), F.sum(F.pmod(cents, F.lit(97))).alias("f")
        ).select("stage", "epoch", (F.col("m") / F.lit(1000.0)).alias("map50"), F.pmod("f", F.lit(89)).cast("double").alias("fitness"))


def project_sql(source: str, lat: str = "lat", lon: str = "lon", x: str = "x", y: str = "y") -> str:
    """The same projection as a nested SELECT."""
    east, north = "eta_", "xi_"
    for j, a in enumerate(geo.ALPHA, 1):
        east += f" + {a:.17e} * cos({2 * j}.0::DOUBLE * xi_) * sinh({2 * j}.0::DOUBLE * eta_)"
        north += f" + {a:.17e} * sin({2 * j}.0::DOUBLE * xi_) * cosh({2 * j}.0::DOUBLE * eta_)"
    k = geo.SCALE * geo.RECTIFYING
    e = f"{geo.ECC:.17e}"
    return (
        f"SELECT * EXCLUDE (t_, dl_, xi_, eta_), 5e5 + {k:.17e} * ({east}) AS {x}, {k:.17e} * ({north}) AS {y} FROM ("
        f"SELECT *, atan2(t_, cos(dl_)) AS xi_, atanh(sin(dl_) / sqrt(1e0 + t_ * t_)) AS eta_ FROM ("
        f"SELECT *, sinh(atanh(sin(radians({lat}))) - {e} * atanh({e} * sin(radians({lat})))) AS t_, "
        f"radians({lon} - 9e1) AS dl_ FROM {source}))"
    )


def _squares_sql(layer: str, half: str) -> str:
    sql = f"(SELECT *, {half} AS h FROM features WHERE layer = '{layer}')"
    for i, (sx, sy) in enumerate([(-1, -1), (1, -1), (1, 1), (-1, 1)]):
        inner = f"(SELECT *, lat + ({sy}.0::DOUBLE * h) AS a{i}, lon + ({sx}.0::DOUBLE * h) AS o{i} FROM {sql})"
        sql = "(" + project_sql(inner, f"a{i}", f"o{i}", f"x{i}", f"y{i}") + ")"
    return f"SELECT feature_id, district, layer, name, lat, lon, h, x0, y0, x1, y1, x2, y2, x3, y3 FROM {sql}"


def _boxes_sql(shift: str) -> str:
    return f"""SELECT l_orderkey AS scene,
  l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey AS box_id,
  (l_partkey % 2)::INT AS class_id, (l_partkey % 8 + {shift})::DOUBLE AS left_x, (l_suppkey % 6)::DOUBLE AS low_y,
  round(l_discount * 100) * 9 + round(l_tax * 100) AS conf FROM lineitem"""


TABLES_SQL = {
    "sites": f"""SELECT c_custkey AS kiln_id, {_at_sql('c_custkey', 7919, 10007, SOUTH, SPAN)} AS lat,
  {_at_sql('c_custkey', 104729, 10009, WEST, SPAN)} AS lon, n_name AS district,
  n_name || '-U' || (c_custkey % 7) AS upazila,
  CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'FCBK' ELSE 'Zigzag' END AS class,
  ((c_custkey * 31) % 1000) / 1000.0::DOUBLE AS confidence
  FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "sites_xy": project_sql("sites"),
    "features": f"""SELECT p_partkey AS feature_id, {_at_sql('p_partkey', 6151, 10037, SOUTH, SPAN)} AS lat,
  {_at_sql('p_partkey', 7411, 10039, WEST, SPAN)} AS lon, {_pick_sql('p_partkey', LAYERS)} AS layer,
  n_name AS district, p_name AS name, p_size AS size
  FROM part JOIN nation ON (p_partkey // 6) % 25 = n_nationkey""",
    "features_xy": project_sql("features"),
    "rail_segments": project_sql(
        "(" + project_sql(
            "(SELECT *, lat + (feature_id % 7 - 3) * 0.001::DOUBLE AS lat2, "
            "lon + (feature_id % 5 - 2) * 0.001::DOUBLE AS lon2 FROM features WHERE layer = 'railways')",
            x="x1", y="y1",
        ) + ")", "lat2", "lon2", "x2", "y2",
    ),
    "forests": _squares_sql("government_forest", "(feature_id % 5 + 1) * 0.001::DOUBLE"),
    "settlement_polygons": _squares_sql("settlements", "(feature_id % 4 + 1) * 0.0015::DOUBLE"),
    "places": f"""SELECT s_suppkey AS place_id, s_name AS name, {_pick_sql('s_suppkey', PLACE_TYPES)} AS place_type,
  {_at_sql('s_suppkey', 3571, 10061, SOUTH, SPAN)} AS lat, {_at_sql('s_suppkey', 2903, 10067, WEST, SPAN)} AS lon FROM supplier""",
    "places_xy": project_sql("places"),
    "boundaries": f"""SELECT n_name AS "shapeName", {WEST}::DOUBLE + (n_nationkey % 5) * {BOX_SIDE}::DOUBLE AS west,
  {SOUTH}::DOUBLE + (n_nationkey // 5) * {BOX_SIDE}::DOUBLE AS south,
  {WEST}::DOUBLE + (n_nationkey % 5) * {BOX_SIDE}::DOUBLE + {BOX_SIDE}::DOUBLE AS east,
  {SOUTH}::DOUBLE + (n_nationkey // 5) * {BOX_SIDE}::DOUBLE + {BOX_SIDE}::DOUBLE AS north FROM nation""",
    "chips": f"""SELECT p_partkey AS chip_id,
  round({_at_sql('p_partkey', 7919, 10007, CHIP_SOUTH, CHIP_SPAN)}, 5)::DECIMAL(12,5)::VARCHAR || '_' ||
  round({_at_sql('p_partkey', 104729, 10009, CHIP_WEST, CHIP_SPAN)}, 5)::DECIMAL(12,5)::VARCHAR || '.png' AS image_name,
  {_pick_sql('p_partkey', ('train', 'val', 'test'))} AS split,
  list_transform(range(least(p_size % 4, 3)), lambda i: ((p_size + i) % 3)::VARCHAR || ' 0.10 0.20 0.30 0.20 0.30 0.40 0.10 0.40') AS labels
  FROM part""",
    "served": """SELECT *, list_filter([""" + ", ".join(f"CASE WHEN dist_{n}_m < 1000 THEN '{r}' END" for n, r in SERVED_SIGNALS) + """], lambda v: v IS NOT NULL) AS breached_rules
  FROM (SELECT kiln_id, lat, lon, district, CASE WHEN kiln_id % 13 = 0 THEN ' ' ELSE upazila END AS upazila, class,
  CASE WHEN kiln_id % 3 <> 0 THEN class END AS class_name, confidence,
  CASE WHEN kiln_id % 17 <> 0 THEN c_acctbal END AS priority,
  CASE WHEN kiln_id % 19 <> 0 THEN (kiln_id * 37) % 2001 + 1 END AS priority_rank,
  CASE WHEN kiln_id % 23 = 0 THEN NULL WHEN kiln_id % 5 = 0 THEN 'High' WHEN kiln_id % 5 <= 2 THEN 'Medium' ELSE 'Low' END AS priority_band,
  CASE WHEN kiln_id % 4 = 0 THEN 'New candidate (2025-26)' ELSE 'Known (2023-24 survey)' END AS detection_status,
  CASE kiln_id % 9 WHEN 0 THEN 'False positive' WHEN 1 THEN 'Verified kiln' ELSE 'Unreviewed' END AS verified, """ + ", ".join(
        f"CASE WHEN kiln_id % {29 + 2 * i} <> 0 THEN ((kiln_id * {m}) % 5000)::DOUBLE / 2 END AS dist_{n}_m" for i, (n, m) in enumerate(SERVED_DISTANCES)
    ) + " FROM sites JOIN customer ON c_custkey = kiln_id)",
    "chip_pos": """SELECT *, floor(lat / 0.25)::BIGINT AS cell_row, floor(lon / 0.25)::BIGINT AS cell_col FROM (SELECT *,
  regexp_extract(image_name, '^(-?[0-9]+\\.[0-9]+)_(-?[0-9]+\\.[0-9]+)\\.png$', 1)::DOUBLE AS lat,
  regexp_extract(image_name, '^(-?[0-9]+\\.[0-9]+)_(-?[0-9]+\\.[0-9]+)\\.png$', 2)::DOUBLE AS lon FROM chips)""",
    "chip_xy": project_sql("chip_pos"),
    "detections": _boxes_sql("0"),
    "truths": _boxes_sql("(l_suppkey % 3)"),
    "audit": """SELECT *, CASE WHEN confidence < 0.25 THEN 'low' WHEN confidence < 0.45 THEN 'mid' ELSE 'high' END AS band FROM (
  SELECT doc_id, lang AS district, source AS kiln_class,
  CASE WHEN doc_id % 11 = 0 THEN 'SKIP' WHEN quality = 1 THEN 'TP' ELSE 'FP' END AS label_a,
  CASE WHEN doc_id % 11 = 0 THEN 'SKIP' WHEN toxic = 0 THEN 'TP' ELSE 'FP' END AS label_b,
  ((n_chars * 37) % 1000) / 1000.0::DOUBLE AS confidence FROM labels JOIN documents USING (doc_id))""",
    "reference_counts": """SELECT n_name AS district, count(*) * 10 AS reported_count
  FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""",
    "reports": f"""SELECT event_id AS id, user_id AS session, ts AS created_at, event_type AS kind,
  {_at_sql('event_id', 4561, 10079, SOUTH - 0.1, SPAN + 0.2)} AS lat,
  {_at_sql('event_id', 5563, 10091, WEST - 0.1, SPAN + 0.2)} AS lon,
  json_extract_string(props, '$.k')::INT AS reason, value FROM events""",
    "visits": """SELECT event_id AS seq, ts AS updated_at, user_id AS kiln_id,
  ['planned', 'visited', 'closed'][json_extract_string(props, '$.k')::INT % 3 + 1] AS status,
  ['amin', 'bela'][(json_extract_string(props, '$.k')::INT // 3) % 2 + 1] AS assignee,
  event_type AS updated_by FROM events""",
    "patches": "SELECT vec_id AS chip, list_transform(embedding, lambda v: round(v::DOUBLE * 1000) + 1000.0::DOUBLE) AS px FROM embeddings",
    "pixels": "SELECT chip, (generate_subscripts(px, 1) - 1)::INT AS pos, unnest(px) AS v FROM patches",
    "scenes": f"""SELECT o_orderkey AS scene_id, o_orderdate::DATE AS scene_date, (o_orderkey % 100)::INT AS cloud,
  {_at_sql('o_custkey', 7919, 10007, SOUTH, SPAN)} AS lat, {_at_sql('o_custkey', 104729, 10009, WEST, SPAN)} AS lon FROM orders""",
    "epochs": """SELECT o_orderpriority AS stage, date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::INT AS epoch,
  sum(round(o_totalprice * 100)::BIGINT % 1000) / 1000.0::DOUBLE AS map50,
  (sum(round(o_totalprice * 100)::BIGINT % 97) % 89)::DOUBLE AS fitness FROM orders GROUP BY 1, 2""",
}


def with_tables(sql: str) -> str:
    """Prefix ``sql`` with the logical tables it uses, in dependency order."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in TABLES_SQL:
            if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text, re.I) and name not in order:
                visit(TABLES_SQL[name])
                order.append(name)

    visit(sql)
    own = sql.strip()
    head = [f"{n} AS ({TABLES_SQL[n]})" for n in order]
    if own[:14].upper() == "WITH RECURSIVE":
        head.append(own[14:].strip())
        return "WITH RECURSIVE " + ",\n".join(head)
    if own[:4].upper() == "WITH":
        head.append(own[4:].strip())
        return "WITH " + ",\n".join(head)
    return ("WITH " + ",\n".join(head) + "\n" if head else "") + own
