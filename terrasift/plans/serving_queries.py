"""Filters, searches, summaries, lists and exports over the served sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift import config
from terrasift.functions import geo
from terrasift.operators import ranking, rules
from terrasift.operators import serving as S
from terrasift.plans.registry import query
from terrasift.plans.screening import m_sql
from terrasift.plans.tables import Tables
from terrasift.session import scratch_dir

ORIGIN = (23.8, 90.0)
_OX, _OY = geo.project_point(*ORIGIN)
_DIST = f"sqrt((x - {_OX!r}::DOUBLE) * (x - {_OX!r}::DOUBLE) + (y - {_OY!r}::DOUBLE) * (y - {_OY!r}::DOUBLE))"
_XY = "WITH p AS (SELECT v.*, x, y FROM served v JOIN sites_xy USING (kiln_id)) "


def simple(name: str, spark_exprs: list[str], sql: str, where: str | None = None, table: str = "served"):
    """Register a projection (and filter) over one logical table."""

    def build(t: Tables) -> DataFrame:
        df = getattr(t, table)()
        return (df.filter(where) if where else df).selectExpr(*spark_exprs)

    query(name, sql)(build)


def aggregate(name: str, spark_exprs: list[str], sql: str, table: str = "served"):
    query(name, sql)(lambda t: getattr(t, table)().selectExpr(*spark_exprs))


simple("scan_scored_sites", ["kiln_id", "class", "confidence", "round(lat, 6) AS lat"],
       "SELECT kiln_id, class, confidence, round(lat, 6) AS lat FROM served")
simple("serving_load_drops_false_positives", ["kiln_id", "verified"],
       "SELECT kiln_id, verified FROM served WHERE verified IS DISTINCT FROM 'False positive'", "NOT (verified <=> 'False positive')")
simple("confidence_cutoff", ["kiln_id", "confidence"], "SELECT kiln_id, confidence FROM served WHERE confidence >= 0.25 AND confidence BETWEEN 0.2 AND 0.8",
       "confidence >= 0.25 AND confidence BETWEEN 0.2 AND 0.8")
simple("technology_flag", ["kiln_id", f"{rules.technology_flag()} AS technology_flagged"], "SELECT kiln_id, class = 'FCBK' AS technology_flagged FROM served")
simple("siting_predicate", ["kiln_id", *[f"{rules.fires(r)} AS {r.id}" for r in config.RULES]],
       "SELECT kiln_id, " + ", ".join(f"coalesce({r.distance} < {r.buffer_m}, false) AS {r.id}" for r in config.RULES) + " FROM served")


_UNVERIFIED = ", ".join(f"'{r.id}'" for r in config.RULES if not r.verified) or "''"


@query("any_rule_unverified", f"""SELECT kiln_id, len(list_filter(breached_rules, lambda r: r IN ({_UNVERIFIED}))) > 0 OR (class = 'FCBK' AND {not config.TECHNOLOGY.verified}) AS any_unverified FROM served""")
def any_unverified(t: Tables) -> DataFrame:
    """Whether a rule that fired for the site, or its technology, is not verified."""
    return t.served().select("kiln_id", rules.any_unverified().alias("any_unverified"))


_JSON = "CASE kiln_id % 4 WHEN 0 THEN to_json(breached_rules) WHEN 1 THEN array_join(breached_rules, ', ') WHEN 2 THEN ' ' END"
simple("signal_ids_decoded", ["kiln_id", f"array_join(array_sort({S.signal_ids('(' + _JSON + ')')}), ',') AS ids"],
       "SELECT kiln_id, CASE WHEN kiln_id % 4 <= 1 THEN array_to_string(list_sort(breached_rules), ',') ELSE '' END AS ids FROM served")
simple("signal_ids_strict", ["kiln_id", f"array_join({S.signal_ids_strict('(CASE kiln_id % 2 WHEN 0 THEN to_json(breached_rules) END)')}, ',') AS ids"],
       "SELECT kiln_id, CASE WHEN kiln_id % 2 = 0 THEN array_to_string(breached_rules, ',') END AS ids FROM served")


@query("signal_status_tri_state", "SELECT kiln_id, CASE WHEN class = 'FCBK' THEN 'Present' ELSE 'Absent' END AS technology_flagged, " + ", ".join(
    f"CASE WHEN list_contains(breached_rules, '{r.id}') THEN 'Present' WHEN {r.distance} IS NULL THEN 'Unknown / not available' WHEN {r.distance} < {r.buffer_m} THEN 'Present' ELSE 'Absent' END AS {r.id}"
    for r in config.RULES) + " FROM served")
def tri_state(t: Tables) -> DataFrame:
    df = t.served().selectExpr("*", f"{rules.technology_flag()} AS technology_flagged")
    return df.select("kiln_id", rules.technology_status().alias("technology_flagged"), *[rules.signal_status(r).alias(r.id) for r in config.RULES])


@query("multi_filter", """SELECT kiln_id FROM served WHERE district IN ('NATION_1', 'NATION_2', 'NATION_3') AND class IN ('FCBK', 'Zigzag')
AND confidence BETWEEN 0.1 AND 0.9 AND priority_band IN ('High', 'Medium') AND dist_schools_m >= 1000""")
def multi_filter(t: Tables) -> DataFrame:
    absent = rules.signal_status(config.RULES[0]) == "Absent"
    return S.candidate_filter(
        t.served(), ("NATION_1", "NATION_2", "NATION_3"), ("FCBK", "Zigzag"), (0.1, 0.9), ("High", "Medium"), {"near_school": absent}
    ).select("kiln_id")


@query("keyed_filter", "SELECT kiln_id, priority FROM served WHERE district = 'NATION_4' AND class = 'FCBK' AND priority_band IN ('High', 'Low')")
def keyed(t: Tables) -> DataFrame:
    return S.keyed_filter(t.served(), "NATION_4", None, "FCBK", ("High", "Low")).select("kiln_id", "priority")


@query("keyed_filter_without_bands", "SELECT kiln_id FROM served WHERE priority_band IS NULL")
def keyed_unknown(t: Tables) -> DataFrame:
    return S.keyed_filter(t.served().filter("priority_band IS NULL"), bands=("High",)).select("kiln_id")


@query("api_list_filter", """SELECT kiln_id, priority_rank FROM served WHERE district = 'NATION_7' AND class = 'FCBK' AND confidence >= 0.2
ORDER BY priority_rank NULLS LAST, kiln_id LIMIT 10""")
def api_list(t: Tables) -> DataFrame:
    df = S.candidate_filter(t.served(), ("NATION_7",), ("FCBK",)).filter("confidence >= 0.2")
    return df.orderBy(F.asc_nulls_last("priority_rank"), "kiln_id").limit(10).select("kiln_id", "priority_rank")


simple("site_by_id", ["kiln_id", "district", "class"], "SELECT kiln_id, district, class FROM served WHERE kiln_id = 42", "kiln_id = 42")
_FLAG_SQL = "(len(breached_rules) > 0 OR " + " OR ".join(f"coalesce({r.distance} < {r.buffer_m}, false)" for r in config.RULES) + ")"


@query("flagged_for_review", f"SELECT kiln_id, {_FLAG_SQL} AS flagged FROM served")
def flagged(t: Tables) -> DataFrame:
    df = t.served().selectExpr("*", "size(breached_rules) AS rule_signals_count")
    return df.select("kiln_id", rules.flagged_for_review(config.RULES).alias("flagged"))


@query("flagged_count", f"SELECT count(*) FILTER ({_FLAG_SQL}) AS flagged, count(*) AS total FROM served")
def flagged_count(t: Tables) -> DataFrame:
    df = t.served().selectExpr("*", "size(breached_rules) AS rule_signals_count").withColumn("f", rules.flagged_for_review(config.RULES))
    return df.selectExpr("count_if(f) AS flagged", "count(1) AS total")


@query("traffic_light_codes", "SELECT kiln_id, " + " || ".join(
    f"CASE WHEN {r.distance} IS NULL THEN '3' WHEN list_contains(breached_rules, '{r.id}') OR {r.distance} <= {r.buffer_m} THEN '0' WHEN {r.distance} <= {r.buffer_m * 1.5} THEN '1' ELSE '2' END"
    for r in config.RULES) + " AS states, array_to_string([" + ", ".join(f"coalesce(round_even({r.distance}, 0)::BIGINT, -1)" for r in config.RULES) + "], ',') AS metres FROM served")
def traffic(t: Tables) -> DataFrame:
    codes, metres = rules.traffic_light(config.RULES)
    return t.served().select("kiln_id", codes.alias("states"), F.array_join(metres.cast("array<string>"), ",").alias("metres"))


@query("rule_rows_per_site", " UNION ALL ".join(
    f"SELECT kiln_id, '{r.id}' AS rule, {r.distance} AS distance_m, {r.buffer_m}::DOUBLE AS buffer_m, CASE WHEN {r.distance} IS NULL THEN 'unknown' WHEN {r.distance} < {r.buffer_m} THEN 'inside' ELSE 'outside' END AS state FROM served"
    for r in config.RULES))
def rule_rows(t: Tables) -> DataFrame:
    return S.distance_rows(t.served())


simple("coalesce_distance_aliases", ["kiln_id", "coalesce(dist_railways_m, try_cast(concat(kiln_id, '.5') AS double), dist_water_m) AS rail_m"],
       "SELECT kiln_id, coalesce(dist_railways_m, (kiln_id || '.5')::DOUBLE) AS rail_m FROM served")
simple("class_fallback", ["kiln_id", f"{S.site_class()} AS kind"], "SELECT kiln_id, coalesce(class_name, class) AS kind FROM served")
simple("clean_text", ["kiln_id", f"{S.clean('upazila')} AS upazila", S.clean_nullish("(CASE kiln_id % 3 WHEN 0 THEN 'NaN' ELSE district END)") + " AS district"],
       "SELECT kiln_id, nullif(trim(upazila), '') AS upazila, CASE WHEN kiln_id % 3 <> 0 THEN district END AS district FROM served")
simple("area_labels", ["kiln_id", f"coalesce({S.area_label()}, 'unknown area') AS area"],
       "SELECT kiln_id, concat_ws(', ', nullif(trim(upazila), ''), district) AS area FROM served")


@query("label_lookups", "SELECT kiln_id, CASE WHEN class = 'FCBK' THEN 'Fixed chimney' ELSE 'Zigzag' END AS type_label, coalesce(CASE priority_band WHEN 'High' THEN 'Urgent' WHEN 'Medium' THEN 'Watch' WHEN 'Low' THEN 'Routine' END, 'Unclassified') AS band_label FROM served")
def labels(t: Tables) -> DataFrame:
    words = t.spark.createDataFrame([("High", "Urgent"), ("Medium", "Watch"), ("Low", "Routine")], "priority_band string, word string")
    df = t.served().join(F.broadcast(words), "priority_band", "left")  # three rows
    return df.selectExpr("kiln_id", "CASE WHEN class = 'FCBK' THEN 'Fixed chimney' ELSE 'Zigzag' END AS type_label", "coalesce(word, 'Unclassified') AS band_label")


def _dist_text(c: str, buffer: float) -> str:
    return (f"CASE WHEN {c} IS NULL THEN 'no data' ELSE (CASE WHEN {c} >= 1000 THEN format('{{:.1f}} km', {c} / 1000) ELSE round_even({c}, 0)::BIGINT || ' m' END) "
            f"|| CASE WHEN {c} < {buffer} THEN ' !' ELSE '' END END")


simple("distance_text", ["kiln_id", f"{S.distance_text('dist_schools_m', 1000.0)} AS schools"],
       f"SELECT kiln_id, {_dist_text('dist_schools_m', 1000.0)} AS schools FROM served")


@query("priority_list_table", "SELECT kiln_id, concat_ws(', ', nullif(trim(upazila), ''), district) AS area, coalesce(priority_band, '') AS priority, " +
       ", ".join(f"{_dist_text(r.distance, r.buffer_m)} AS {r.feature}" for r in config.RULES) + " FROM served")
def list_table(t: Tables) -> DataFrame:
    return S.list_table(t.served())


simple("reason_text", ["kiln_id", f"{S.reason_text()} AS reasons"], "SELECT kiln_id, coalesce(nullif(concat_ws('; ', " + ", ".join(
    f"CASE WHEN {r.distance} < {r.buffer_m} THEN 'near {r.short_label} (' || round({r.distance})::BIGINT || ' m)' END" for r in config.RULES) + "), ''), 'none') AS reasons FROM served")


@query("public_columns", "SELECT kiln_id, district, upazila, class, detection_status, verified FROM served")
def public(t: Tables) -> DataFrame:
    view = S.public_view(t.served())
    assert not S.leaked_columns(view)
    return view.drop("lat", "lon", "class_name")


@query("display_columns", "SELECT kiln_id, concat_ws(', ', nullif(trim(upazila), ''), district) AS ui_area, CASE WHEN class = 'FCBK' THEN 'Fixed chimney' ELSE 'Zigzag' END AS ui_type, coalesce(priority_band, 'Unclassified') AS ui_priority, detection_status FROM served")
def display(t: Tables) -> DataFrame:
    once = S.with_display(t.served())
    return S.with_display(once).select("kiln_id", "ui_area", "ui_type", "ui_priority", "detection_status")


simple("extent_predicate", ["kiln_id"], "SELECT kiln_id FROM served WHERE lat BETWEEN 23.7 AND 23.9 AND lon BETWEEN 89.9 AND 90.1", "lat BETWEEN 23.7 AND 23.9 AND lon BETWEEN 89.9 AND 90.1")
simple("half_open_dates", ["scene_id"], "SELECT scene_id FROM scenes WHERE scene_date >= DATE '1997-01-01' AND scene_date < DATE '1998-01-01'",
       "scene_date >= DATE'1997-01-01' AND scene_date < DATE'1998-01-01'", "scenes")
simple("map_links", ["kiln_id", "concat('https://www.google.com/maps?q=', cast(cast(lat AS decimal(12,6)) AS string), '%2C', cast(cast(lon AS decimal(12,6)) AS string)) AS link"],
       "SELECT kiln_id, 'https://www.google.com/maps?q=' || lat::DECIMAL(12,6) || '%2C' || lon::DECIMAL(12,6) AS link FROM served")


@query("map_payload_rows", """WITH s AS (SELECT *, CASE WHEN class = 'FCBK' THEN 'Fixed chimney' ELSE 'Zigzag' END AS ui_type, concat_ws(', ', nullif(trim(upazila), ''), district) AS ui_area FROM served),
ty AS (SELECT ui_type, row_number() OVER (ORDER BY min(kiln_id), ui_type) - 1 AS type FROM s GROUP BY 1), ar AS (SELECT ui_area, row_number() OVER (ORDER BY min(kiln_id), ui_area) - 1 AS area FROM s GROUP BY 1)
SELECT kiln_id, round(lat, 5) AS lat, round(lon, 5) AS lon, CASE priority_band WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 WHEN 'Low' THEN 2 ELSE 3 END AS band, type, area FROM s JOIN ty USING (ui_type) JOIN ar USING (ui_area)""")
def payload(t: Tables) -> DataFrame:
    return S.payload_rows(t.served())[0]


@query("api_projection", """SELECT kiln_id::VARCHAR AS id, coalesce(class, class_name, 'Not recorded') AS class, coalesce(priority, 0) AS screening_priority, priority_rank,
CASE WHEN priority_rank IS NULL THEN 'Unknown' WHEN priority_rank <= greatest(1, ceil(n / 3.0)) THEN 'High' WHEN priority_rank <= greatest(1, ceil(n / 3.0), ceil(n * 2.0 / 3.0)) THEN 'Medium' ELSE 'Low' END AS priority_band,
len(breached_rules) AS signal_count FROM served, (SELECT count(*) AS n FROM served)""")
def api_projection(t: Tables) -> DataFrame:
    total = t.served().agg(F.count(F.lit(1)).alias("n")).scalar()
    return t.served().withColumn("_total", total).select(
        F.col("kiln_id").cast("string").alias("id"), F.coalesce("class", "class_name", F.lit("Not recorded")).alias("class"),
        F.coalesce("priority", F.lit(0.0)).alias("screening_priority"), F.col("priority_rank").cast("bigint").alias("priority_rank"),
        ranking.band_from_rank(F.col("priority_rank"), F.col("_total")).alias("priority_band"), F.size("breached_rules").alias("signal_count"),
    )


simple("result_table", ["kiln_id", "coalesce(cast(cast(rint(dist_schools_m) AS bigint) AS string), 'no data') AS distance", f"{S.area_label()} AS area", f"{S.site_class()} AS kind"],
       "SELECT kiln_id, coalesce(round_even(dist_schools_m, 0)::BIGINT::VARCHAR, 'no data') AS distance, concat_ws(', ', nullif(trim(upazila), ''), district) AS area, coalesce(class_name, class) AS kind FROM served")
aggregate("band_summary", S.band_counts(), "SELECT count(*) AS total, count(*) FILTER (priority_band = 'High') AS high, count(*) FILTER (priority_band = 'Medium') AS medium, count(*) FILTER (priority_band = 'Low') AS low, count(*) FILTER (detection_status = 'New candidate (2025-26)') AS new FROM served")


@query("district_stats", "SELECT district, count(*) AS total, count(*) FILTER (priority_band = 'High') AS high, count(*) FILTER (priority_band = 'Medium') AS medium, count(*) FILTER (priority_band = 'Low') AS low FROM served GROUP BY 1")
def district_stats(t: Tables) -> DataFrame:
    return S.district_stats(t.served())


@query("public_district_counts", "SELECT district, count(*) AS total FROM served GROUP BY 1")
def district_counts(t: Tables) -> DataFrame:
    return S.public_view(t.served()).groupBy("district").agg(F.expr("count(1) AS total")).orderBy(F.desc("total"), "district")


@query("top_upazilas", "SELECT upazila, district, count(*) AS total, count(*) FILTER (priority_band = 'High') AS high FROM served WHERE trim(upazila) <> '' GROUP BY 1, 2 ORDER BY total DESC, high DESC, upazila, district LIMIT 10")
def top_upazilas(t: Tables) -> DataFrame:
    return S.top_upazilas(t.served())


@query("type_split", "SELECT class AS kind, count(*) AS n FROM served GROUP BY 1")
def type_split(t: Tables) -> DataFrame:
    return S.type_split(t.served())


aggregate("headline_counts", ["count(1) AS total", "count_if(priority_band = 'High') AS high", "count(DISTINCT district) AS districts", "count_if(class = 'FCBK') AS fcbk", "count_if(class = 'Zigzag') AS zigzag"],
          "SELECT count(*) AS total, count(*) FILTER (priority_band = 'High') AS high, count(DISTINCT district) AS districts, count(*) FILTER (class = 'FCBK') AS fcbk, count(*) FILTER (class = 'Zigzag') AS zigzag FROM served")


@query("places_at_three_grains", f"""WITH s AS (SELECT *, CASE WHEN kiln_id % 2 = 0 THEN 'P' || kiln_id % 5 END AS place FROM served)
SELECT kind, name, district, n, {m_sql('lat', 6)} AS lat, {m_sql('lon', 6)} AS lon FROM (
SELECT 'district' AS kind, district AS name, district, count(*) AS n, avg(lat) AS lat, avg(lon) AS lon FROM s GROUP BY 3
UNION ALL SELECT 'upazila', upazila, district, count(*), avg(lat), avg(lon) FROM s WHERE trim(upazila) <> '' GROUP BY 2, 3
UNION ALL SELECT 'named', place, district, count(*), avg(lat), avg(lon) FROM s WHERE place IS NOT NULL GROUP BY 2, 3)""")
def places(t: Tables) -> DataFrame:
    df = t.served().selectExpr("*", "CASE WHEN kiln_id % 2 = 0 THEN concat('P', kiln_id % 5) END AS nearest_place")
    return S.places(df).selectExpr("kind", "name", "district", "n", f"{m_sql('lat', 6)} AS lat", f"{m_sql('lon', 6)} AS lon")


@query("example_origin", "SELECT district, upazila, count(*) AS n FROM served WHERE trim(upazila) <> '' GROUP BY 1, 2 ORDER BY (district = 'NATION_5' AND upazila = 'NATION_5-U9') DESC, n DESC, district DESC, upazila DESC LIMIT 1")
def example(t: Tables) -> DataFrame:
    return S.example_origin(t.served(), "NATION_5", "NATION_5-U9").select("district", "upazila", "n")


@query("district_summary", """WITH c AS (SELECT district, s, count(*) AS n FROM (SELECT district, unnest(breached_rules) AS s FROM served) GROUP BY 1, 2)
SELECT district, count(*) AS total, count(*) FILTER (priority_band = 'High') AS high, (SELECT s FROM c WHERE c.district = served.district ORDER BY n DESC, s LIMIT 1) AS modal_signal FROM served GROUP BY district""")
def district_summary(t: Tables) -> DataFrame:
    df = t.served()
    return S.district_stats(df).select("district", "total", "high").join(S.modal_signal(df, "district"), "district", "left")


@query("district_hull_area")
def hull(t: Tables) -> DataFrame:
    return S.hull_km2(t.sites_xy().select("district", "x", "y"), "district").selectExpr("district", f"{m_sql('hull_km2', 6)} AS hull_km2")


aggregate("coordinate_extent", ["min(lat) AS south", "min(lon) AS west", "max(lat) AS north", "max(lon) AS east"], "SELECT min(lat) AS south, min(lon) AS west, max(lat) AS north, max(lon) AS east FROM served")


@query("relative_thirds", """WITH k AS (SELECT kiln_id, row_number() OVER (ORDER BY priority_rank, kiln_id) AS o, count(*) OVER () AS n FROM served WHERE priority_rank IS NOT NULL)
SELECT s.kiln_id, CASE WHEN o IS NULL THEN 'Unknown / not available' WHEN o <= ceil(n / 3.0) THEN 'High' WHEN o <= ceil(2.0 * n / 3.0) THEN 'Medium' ELSE 'Low' END AS band FROM served s LEFT JOIN k USING (kiln_id)""")
def thirds(t: Tables) -> DataFrame:
    df = t.served().select("kiln_id", "priority_rank")
    return ranking.relative_thirds(df, [F.col("priority_rank"), F.col("kiln_id")], F.col("priority_rank").isNotNull(), "band").select("kiln_id", "band")


@query("band_from_stored_rank", "SELECT kiln_id, CASE WHEN priority_rank IS NULL THEN 'Unknown' WHEN priority_rank <= greatest(1, ceil(n / 3.0)) THEN 'High' WHEN priority_rank <= greatest(1, ceil(n / 3.0), ceil(n * 2.0 / 3.0)) THEN 'Medium' ELSE 'Low' END AS band FROM served, (SELECT count(*) AS n FROM served)")
def band_from_rank(t: Tables) -> DataFrame:
    df = t.served()
    n = df.agg(F.expr("count(1) AS n")).scalar()
    return df.withColumn("n", n).select("kiln_id", ranking.band_from_rank(F.col("priority_rank"), F.col("n")).alias("band"))


@query("strided_sample", "SELECT kiln_id FROM (SELECT kiln_id, row_number() OVER (ORDER BY kiln_id) AS o, count(*) OVER () AS n FROM served) WHERE (o - 1) % greatest(1, ceil(n / 400.0))::BIGINT = 0")
def strided(t: Tables) -> DataFrame:
    return ranking.strided(t.served().select("kiln_id"), [F.col("kiln_id")], 400)


@query("route_segments", """WITH o AS (SELECT district, kiln_id, row_number() OVER (PARTITION BY district ORDER BY kiln_id) AS i, count(*) OVER (PARTITION BY district) AS n FROM served),
g AS (SELECT district, n, unnest(range(0, greatest(1, (n - 2) // 4 + 1))) AS segment FROM (SELECT DISTINCT district, n FROM o))
SELECT district, segment, segment * 4 + 1 AS first_stop, least(segment * 4 + 5, n) AS last_stop FROM g""")
def routes(t: Tables) -> DataFrame:
    df = t.served().select("district", "kiln_id", "lat", "lon")
    return S.route_segments(df, "district", "kiln_id").select("district", "segment", "first_stop", "last_stop")


@query("sort_rank_first_top", "SELECT kiln_id FROM served ORDER BY priority_rank DESC NULLS LAST, priority DESC NULLS LAST, kiln_id LIMIT 25")
def rank_first(t: Tables) -> DataFrame:
    return t.served().orderBy(F.desc_nulls_last("priority_rank"), F.desc_nulls_last("priority"), "kiln_id").limit(25).select("kiln_id")


@query("priority_order_top", "SELECT kiln_id FROM served ORDER BY priority DESC NULLS LAST, kiln_id LIMIT 30")
def priority_order(t: Tables) -> DataFrame:
    return t.served().orderBy(F.desc_nulls_last("priority"), "kiln_id").limit(30).select("kiln_id")


@query("rank_limit", "SELECT kiln_id, priority_rank FROM served ORDER BY priority_rank NULLS LAST, kiln_id LIMIT 100")
def rank_limit(t: Tables) -> DataFrame:
    return t.served().orderBy(F.asc_nulls_last("priority_rank"), "kiln_id").limit(100).select("kiln_id", "priority_rank")


@query("place_suggestions", "SELECT name FROM places WHERE contains(regexp_replace(lower(name), '[^\\p{L}\\p{N}]', '', 'g'), 'r00000000') ORDER BY NOT starts_with(regexp_replace(lower(name), '[^\\p{L}\\p{N}]', '', 'g'), 'r00000000'), lower(name), name LIMIT 12")
def suggestions(t: Tables) -> DataFrame:
    return S.suggest_places(t.places().select("name"), "name", "R#0000 0000")


@query("cards_by_severity", "SELECT kiln_id, row_number() OVER (ORDER BY CASE priority_band WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 WHEN 'Low' THEN 2 ELSE 3 END, dist_schools_m NULLS FIRST, kiln_id) AS pos FROM served")
def cards(t: Tables) -> DataFrame:
    order = [F.expr("CASE priority_band WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 WHEN 'Low' THEN 2 ELSE 3 END"), F.expr("coalesce(dist_schools_m, -1D)"), F.col("kiln_id")]
    return ranking.ordinal(t.served().select("kiln_id", "priority_band", "dist_schools_m"), order, name="pos").select("kiln_id", "pos")


@query("name_sort", "SELECT place_id, lower(name) AS folded, row_number() OVER (ORDER BY lower(name) NULLS FIRST, place_id) AS pos FROM places")
def name_sort(t: Tables) -> DataFrame:
    folded = t.places().selectExpr("place_id", "lower(name) AS folded")
    return ranking.ordinal(folded, [F.col("folded"), F.col("place_id")], name="pos").select("place_id", "folded", "pos").orderBy("pos")


@query("nearby_search", f"{_XY} SELECT kiln_id, round({_DIST}, 1) AS distance_m FROM p WHERE {_DIST} <= 15000 ORDER BY round({_DIST}, 1), coalesce(priority_rank, 1000000000), kiln_id LIMIT 20")
def nearby(t: Tables) -> DataFrame:
    return S.nearby(t.served(), *ORIGIN, 15000.0, 20).select("kiln_id", "distance_m")


@query("community_radius_search", f"{_XY} SELECT kiln_id, {m_sql(_DIST)} AS distance_m FROM p WHERE {_DIST} <= 10000")
def community(t: Tables) -> DataFrame:
    return S.community_search(t.served(), *ORIGIN, 10000.0).selectExpr("kiln_id", f"{m_sql('distance_m')} AS distance_m")


@query("community_area_search", f"{_XY} SELECT kiln_id, {m_sql(_DIST)} AS distance_m FROM p WHERE district = 'NATION_3'")
def community_area(t: Tables) -> DataFrame:
    return S.community_search(t.served(), *ORIGIN, 1.0, "NATION_3").selectExpr("kiln_id", f"{m_sql('distance_m')} AS distance_m")


@query("community_search_summary", f"{_XY} SELECT count(*) AS total, count(*) FILTER (priority_band = 'High') AS high FROM p WHERE {_DIST} <= 10000")
def community_summary(t: Tables) -> DataFrame:
    return S.community_search(t.served(), *ORIGIN, 10000.0).selectExpr("count(1) AS total", "count_if(priority_band = 'High') AS high")


@query("nearest_row", f"{_XY} SELECT kiln_id, {m_sql(_DIST)} AS distance_m FROM p ORDER BY {_DIST}, kiln_id LIMIT 1")
def nearest_row(t: Tables) -> DataFrame:
    return S.nearest_row(t.served(), *ORIGIN).selectExpr("kiln_id", f"{m_sql('distance_m')} AS distance_m")


@query("covered_district", "SELECT district FROM (SELECT district, min(lat) s, max(lat) n, min(lon) w, max(lon) e, avg(lat) a, avg(lon) o FROM served GROUP BY 1) WHERE 23.8 BETWEEN s - 0.05 AND n + 0.05 AND 90.0 BETWEEN w - 0.05 AND e + 0.05 ORDER BY sqrt((23.8::DOUBLE - a) ** 2 + (90.0::DOUBLE - o) ** 2), district LIMIT 1")
def covered(t: Tables) -> DataFrame:
    return S.covered_district(t.served(), *ORIGIN, 5000.0)


@query("planar_distances_from_point", f"{_XY} SELECT kiln_id, {m_sql(_DIST)} AS distance_m FROM p")
def planar(t: Tables) -> DataFrame:
    return S.with_distance(t.served(), *ORIGIN).selectExpr("kiln_id", f"{m_sql('distance_m')} AS distance_m")


@query("review_csv", "SELECT kiln_id AS \"ID\", CASE WHEN class = 'FCBK' THEN 'Fixed-chimney kiln (flagged for review)' ELSE 'Zigzag kiln' END AS \"Type\", len(breached_rules) AS \"Rule_Signals_Count\", " + _FLAG_SQL + " AS \"Flagged_For_Review\", coalesce(priority_band, 'NaN') AS \"Priority_Band\" FROM served")
def review_csv(t: Tables) -> DataFrame:
    path = f"{scratch_dir(t.spark)}/review_csv"
    export = S.review_export(t.served())
    export.write.mode("overwrite").csv(path, header=True, nullValue="NaN")
    back = t.spark.read.csv(path, header=True, schema=export.schema)
    return back.select("ID", "Type", "Rule_Signals_Count", "Flagged_For_Review", "Priority_Band")


@query("display_csv", "SELECT kiln_id AS \"Candidate\", district AS \"District\", coalesce(class_name, class) AS \"Kiln type\" FROM served")
def display_csv(t: Tables) -> DataFrame:
    path = f"{scratch_dir(t.spark)}/display_csv"
    view = t.served().selectExpr("kiln_id AS Candidate", "district AS District", "coalesce(class_name, class) AS `Kiln type`")
    view.write.mode("overwrite").csv(path, header=True)
    return t.spark.read.csv(path, header=True, schema=view.schema)


@query("advisory_csv", "SELECT 'Screening candidates for human review.' AS advisory_use_notice, kiln_id, class AS detected_class, confidence AS detector_confidence, '[' || array_to_string(list_transform(breached_rules, lambda r: '\"' || r || '\"'), ',') || ']' AS candidate_rule_signals, dist_schools_m AS distance_to_mapped_schools_m FROM served")
def advisory_csv(t: Tables) -> DataFrame:
    out = S.advisory_export(t.served(), "Screening candidates for human review.")
    path = f"{scratch_dir(t.spark)}/advisory_csv"
    out.write.mode("overwrite").csv(path, header=True, escape='"')
    back = t.spark.read.csv(path, header=True, schema=out.schema, escape='"')
    return back.select("advisory_use_notice", "kiln_id", "detected_class", "detector_confidence", "candidate_rule_signals", "distance_to_mapped_schools_m")
