"""Filters, searches, summaries and display columns over scored sites.

Small pieces return SQL text for ``selectExpr``/``filter`` so that Catalyst sees plain
expressions; table-shaped pieces take and return DataFrames.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift import config
from terrasift.config import Rule
from terrasift.functions import geo
from terrasift.operators import ranking

# Bands, statuses, prefixes and labels shown to users.
BANDS = ("High", "Medium", "Low")
NEW_STATUS = "New candidate (2025-26)"
KNOWN_STATUS = "Known (2023-24 survey)"
UNKNOWN_STATUS = "Unknown / not available"
NULLISH = ("", "nan", "none", "<na>", "nat", "null")
STAFF_PREFIXES = ("priority", "breach", "rule", "dist_", "signal_")
STAFF_COLUMNS = (
    "exposure", "n_schools", "n_hospitals", "settlement_area", "technology_flagged",
    "top_rule_signal", "confidence", "ui_priority", "ui_tooltip", "ui_popup_html",
)
EXPORT_RENAMES = {
    "breached_rules": "candidate_rule_signals",
    "breach_count": "candidate_rule_signal_count",
    "breach_score": "screening_score",
    "priority": "screening_priority",
    "priority_rank": "screening_priority_rank",
    "priority_band": "inspection_priority_band",
    "technology_flagged": "technology_candidate_signal",
    "rules_version": "rule_config_version",
    "class": "detected_class",
    "confidence": "detector_confidence",
}


def clean(column: str) -> str:
    """Trimmed text, or null when blank."""
    return f"nullif(trim({column}), '')"


def clean_nullish(column: str) -> str:
    listed = ", ".join(f"'{v}'" for v in NULLISH)
    return f"CASE WHEN lower(trim({column})) NOT IN ({listed}) THEN trim({column}) END"


def site_class() -> str:
    return "coalesce(class_name, class)"


def signal_ids(column: str) -> str:
    """Ids from a JSON list or comma-separated text; empty when missing, duplicates dropped."""
    listed = ", ".join(f"'{v}'" for v in NULLISH)
    parts = f"coalesce(from_json({column}, 'array<string>'), CASE WHEN trim({column}) NOT LIKE '[%' THEN split({column}, ',') END, array())"
    return f"array_distinct(filter(transform({parts}, s -> trim(s)), s -> s IS NOT NULL AND lower(s) NOT IN ({listed})))"


def signal_ids_strict(column: str) -> str:
    """Ids from a JSON list; null when the field is missing or unreadable."""
    return f"from_json({column}, 'array<string>')"


def keyed_filter(
    df: DataFrame, district: str | None = None, upazila: str | None = None,
    kind: str | None = None, bands: Sequence[str] = BANDS,
) -> DataFrame:
    """Area, type and band filter, best priority first.

    When no remaining row has a known band the band filter is skipped rather than showing
    nothing.
    """
    for column, value in (("district", district), ("upazila", upazila), ("class", kind)):
        if value is not None:
            df = df.filter(F.col(column) == value)
    known = F.col("priority_band").isin(*BANDS)
    any_known = df.agg(F.coalesce(F.max(known), F.lit(False)).alias("k")).scalar()
    wanted = F.coalesce(F.col("priority_band").isin(*bands), F.lit(False))
    return df.filter(~any_known | wanted).orderBy(F.desc_nulls_last("priority"), "kiln_id")


def candidate_filter(
    df: DataFrame, districts: Sequence[str] = (), classes: Sequence[str] = (),
    confidence: tuple[float, float] | None = None, bands: Sequence[str] = (), signals: dict[str, Column] | None = None,
) -> DataFrame:
    """Every filter that is set must hold; ``signals`` are ready-made predicates."""
    if districts:
        df = df.filter(F.col("district").isin(*districts))
    if classes:
        df = df.filter(F.col("class").isin(*classes))
    if confidence:
        df = df.filter(F.col("confidence").between(*confidence))
    if bands:
        df = df.filter(F.col("priority_band").isin(*bands))
    for predicate in (signals or {}).values():
        df = df.filter(predicate)
    return df


def with_distance(df: DataFrame, lat: float, lon: float) -> DataFrame:
    """Projected metres to one point; rows without coordinates get null and never match."""
    x, y = geo.project_point(lat, lon)
    placed = geo.project(df, x="_x", y="_y")
    return placed.selectExpr(
        "*", f"sqrt((_x - {x!r}D) * (_x - {x!r}D) + (_y - {y!r}D) * (_y - {y!r}D)) AS distance_m"
    ).drop("_x", "_y")


def within_box(df: DataFrame, lat: float, lon: float, radius_m: float) -> DataFrame:
    """Generous degree box around a circle: a plain range filter that reaches the scan."""
    d_lat = radius_m / 110574.0 * 1.01
    d_lon = radius_m / (111320.0 * max(_cos(abs(lat) + d_lat), 0.01)) * 1.01
    return df.filter(F.col("lat").between(lat - d_lat, lat + d_lat) & F.col("lon").between(lon - d_lon, lon + d_lon))


def _cos(degrees: float) -> float:
    return math.cos(math.radians(degrees))


def nearby(df: DataFrame, lat: float, lon: float, radius_m: float, limit: int = 20) -> DataFrame:
    """Rows within the radius by (rounded distance, rank), first ``limit``."""
    near = with_distance(within_box(df, lat, lon, radius_m), lat, lon).filter(F.col("distance_m") <= radius_m)
    rounded = near.withColumn("distance_m", F.round("distance_m", 1))
    return rounded.orderBy("distance_m", F.coalesce("priority_rank", F.lit(10**9)), "kiln_id").limit(limit)


def community_search(
    df: DataFrame, lat: float, lon: float, radius_m: float | None = None,
    district: str | None = None, upazila: str | None = None,
) -> DataFrame:
    """A whole area (the radius is ignored) or everything within the radius, nearest first."""
    nearest_first = [F.asc_nulls_last("distance_m"), "kiln_id"]
    if district is None:
        near = with_distance(within_box(df, lat, lon, radius_m), lat, lon).filter(F.col("distance_m") <= radius_m)
        return near.orderBy(*nearest_first)
    rows = df.filter(F.expr(clean("district")) == district)
    if upazila is not None:
        rows = rows.filter(F.expr(clean("upazila")) == upazila)
    return with_distance(rows, lat, lon).orderBy(*nearest_first)


def nearest_row(df: DataFrame, lat: float, lon: float, beyond_m: float | None = None) -> DataFrame:
    """The nearest row, or the nearest one further away than ``beyond_m``."""
    far = with_distance(df, lat, lon).filter("distance_m IS NOT NULL")
    if beyond_m is not None:
        far = far.filter(F.col("distance_m") > beyond_m)
    return far.orderBy("distance_m", "kiln_id").limit(1)


def covered_district(df: DataFrame, lat: float, lon: float, margin_m: float) -> DataFrame:
    """District whose extent plus margin holds the point; the nearest mean position wins."""
    d_lat, d_lon = margin_m / 110574.0, margin_m / (111320.0 * max(_cos(lat), 0.01))
    extents = df.groupBy("district").agg(
        F.expr("min(lat) AS s"), F.expr("max(lat) AS n"), F.expr("min(lon) AS w"), F.expr("max(lon) AS e"),
        F.expr("avg(lat) AS mla"), F.expr("avg(lon) AS mlo"),
    )
    holds = f"{lat!r}D BETWEEN s - {d_lat!r}D AND n + {d_lat!r}D AND {lon!r}D BETWEEN w - {d_lon!r}D AND e + {d_lon!r}D"
    gap = f"hypot({lat!r}D - mla, {lon!r}D - mlo)"
    return extents.filter(holds).orderBy(F.expr(gap), "district").limit(1).select("district")


def band_counts() -> list[str]:
    return [
        "count(1) AS total", *[f"count_if(priority_band = '{b}') AS {b.lower()}" for b in BANDS],
        f"count_if(detection_status = '{NEW_STATUS}') AS new",
    ]


def district_stats(df: DataFrame) -> DataFrame:
    rows = df.withColumn("district", F.expr(clean("district"))).filter("district IS NOT NULL")
    return rows.groupBy("district").agg(
        F.expr("count(1) AS total"), *[F.expr(f"count_if(priority_band = '{b}') AS {b.lower()}") for b in BANDS]
    ).orderBy(F.desc("total"), F.desc("high"), "district")


def top_upazilas(df: DataFrame, limit: int = 10) -> DataFrame:
    rows = df.selectExpr(f"{clean('upazila')} AS upazila", f"coalesce({clean('district')}, '') AS district", "priority_band")
    stats = rows.filter("upazila IS NOT NULL").groupBy("upazila", "district").agg(
        F.expr("count(1) AS total"), F.expr("count_if(priority_band = 'High') AS high")
    )
    return stats.orderBy(F.desc("total"), F.desc("high"), "upazila", "district").limit(limit)


def type_split(df: DataFrame) -> DataFrame:
    """Counts in fixed order with an ``other`` remainder; absent types do not appear."""
    kind = "CASE WHEN trim(class) IN ('Zigzag', 'FCBK') THEN trim(class) ELSE 'other' END AS kind"
    counts = df.selectExpr(kind).groupBy("kind").agg(F.expr("count(1) AS n"))
    return counts.orderBy(F.expr("CASE kind WHEN 'Zigzag' THEN 0 WHEN 'FCBK' THEN 1 ELSE 2 END"))


def places(df: DataFrame) -> DataFrame:
    """Origins at three grains in one pass: district, upazila and named place."""
    rows = df.selectExpr(
        "lat", "lon", f"{clean('district')} AS district", f"{clean('upazila')} AS upazila", f"{clean('nearest_place')} AS place"
    ).filter("district IS NOT NULL")
    grains = rows.groupingSets(
        [("district",), ("district", "upazila"), ("district", "place")], "district", "upazila", "place"
    ).agg(F.expr("grouping_id() AS g"), F.expr("count(1) AS n"), F.expr("avg(lat) AS lat"), F.expr("avg(lon) AS lon"))
    # Bits of the grouping id: upazila absent = 2, place absent = 1.
    return grains.filter("g = 3 OR (g = 1 AND upazila IS NOT NULL) OR (g = 2 AND place IS NOT NULL)").selectExpr(
        "CASE g WHEN 3 THEN 'district' WHEN 1 THEN 'upazila' ELSE 'named' END AS kind",
        "CASE g WHEN 3 THEN district WHEN 1 THEN upazila ELSE place END AS name", "district", "n", "lat", "lon",
    )


def example_origin(df: DataFrame, district: str, upazila: str) -> DataFrame:
    """The preferred upazila if it has rows, else the busiest (last key on ties)."""
    stats = df.filter(F.expr(clean("upazila")).isNotNull()).groupBy("district", "upazila").agg(
        F.expr("count(1) AS n"), F.expr("avg(lat) AS lat"), F.expr("avg(lon) AS lon")
    )
    preferred = F.col("district").eqNullSafe(F.lit(district)) & F.col("upazila").eqNullSafe(F.lit(upazila))
    return stats.orderBy(preferred.desc(), F.desc("n"), F.desc("district"), F.desc("upazila")).limit(1)


def hull_km2(df: DataFrame, by: str) -> DataFrame:
    """Convex hull area of the projected points of every group.

    A group is first cut into ``x`` strips whose own hulls are small; a corner of the whole
    hull is a corner of its strip's hull, so only those meet in the final step.
    """
    span = df.groupBy(by).agg(F.expr("min(x) AS lo"), F.expr("max(x) AS hi"))
    strip = "least(1023, floor((x - lo) / greatest(hi - lo, 1e-9D) * 1024)) AS strip"
    # Equal x inside a strip: only the lowest and highest point can be a corner.
    ends = df.join(span, by).selectExpr(by, "x", "y", strip).groupBy(by, "strip", "x").agg(
        F.expr("array_distinct(array(min(y), max(y))) AS ys")
    ).selectExpr(by, "strip", "x", "explode(ys) AS y")
    kind = dict(df.dtypes)[by]
    few = ends.repartition(by, "strip").mapInPandas(_strip_corners, f"{by} {kind}, strip long, x double, y double")
    return few.select(by, "x", "y").groupBy(by).applyInPandas(_hull, f"{by} {kind}, hull_km2 double")


def _corners(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def half(run):
        chain: list[tuple[float, float]] = []
        for p in run:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) <= (
                chain[-1][1] - chain[-2][1]
            ) * (p[0] - chain[-2][0]):
                chain.pop()
            chain.append(p)
        return chain[:-1]

    return half(pts) + half(pts[::-1])


def _strip_corners(batches):
    for pdf in batches:
        names = list(pdf.columns)
        for keys, part in pdf.groupby(names[:2], sort=False):
            kept = _corners(list(zip(part["x"], part["y"])))
            yield pd.DataFrame([(*keys, *p) for p in kept], columns=names)


def _hull(pdf: pd.DataFrame) -> pd.DataFrame:
    ring = _corners(list(zip(pdf["x"], pdf["y"])))
    ox, oy = ring[0]
    twice = sum(
        (a[0] - ox) * (b[1] - oy) - (b[0] - ox) * (a[1] - oy) for a, b in zip(ring, ring[1:] + ring[:1])
    )
    return pd.DataFrame({pdf.columns[0]: [pdf.iloc[0, 0]], "hull_km2": [abs(twice) / 2e6]})


def modal_signal(df: DataFrame, by: str) -> DataFrame:
    """Most frequent signal per group; the smallest id wins ties."""
    counts = df.selectExpr(by, "explode(breached_rules) AS signal").groupBy(by, "signal").agg(F.expr("count(1) AS n"))
    return counts.groupBy(by).agg(F.expr("min_by(signal, named_struct('n', -n, 's', signal)) AS modal_signal"))


def distance_text(column: str, buffer_m: float | None = None) -> str:
    shown = f"CASE WHEN {column} >= 1000 THEN concat(format_number({column} / 1000, 1), ' km') ELSE concat(cast(rint({column}) AS bigint), ' m') END"
    mark = f"CASE WHEN {column} < {buffer_m!r}D THEN ' !' ELSE '' END" if buffer_m is not None else "''"
    return f"CASE WHEN {column} IS NULL THEN 'no data' ELSE concat({shown}, {mark}) END"


def list_table(df: DataFrame, rules: Sequence[Rule] = config.RULES) -> DataFrame:
    """Priority list: area, band and one distance text per rule."""
    return df.selectExpr(
        "kiln_id", f"coalesce({area_label()}, 'unknown area') AS area", "coalesce(priority_band, '') AS priority",
        *[f"{distance_text(r.distance, r.buffer_m)} AS {r.feature}" for r in rules],
    )


def area_label() -> str:
    return f"nullif(concat_ws(', ', {clean('upazila')}, {clean('district')}), '')"


def reason_text(rules: Sequence[Rule] = config.RULES) -> str:
    parts = ", ".join(
        f"CASE WHEN {r.distance} < {r.buffer_m!r}D THEN concat('near {r.short_label} (', cast(cast(round({r.distance}) AS bigint) AS string), ' m)') END"
        for r in rules
    )
    return f"coalesce(nullif(concat_ws('; ', {parts}), ''), 'none')"


def distance_rows(df: DataFrame, rules: Sequence[Rule] = config.RULES) -> DataFrame:
    """One row per site and rule: distance, buffer and inside / outside / unknown."""
    entries = ", ".join(
        f"named_struct('rule', '{r.id}', 'distance_m', {r.distance}, 'buffer_m', {r.buffer_m!r}D)" for r in rules
    )
    return df.selectExpr("kiln_id", f"explode(array({entries})) AS e").selectExpr(
        "kiln_id", "e.rule", "e.distance_m", "e.buffer_m",
        "CASE WHEN e.distance_m IS NULL THEN 'unknown' WHEN e.distance_m < e.buffer_m THEN 'inside' ELSE 'outside' END AS state",
    )


def is_staff_only(name: str) -> bool:
    low = name.lower()
    return name in STAFF_COLUMNS or low.startswith(STAFF_PREFIXES) or low.endswith("_normalized")


def public_view(df: DataFrame) -> DataFrame:
    """The table without any staff-only column."""
    return df.drop(*leaked_columns(df))


def leaked_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if is_staff_only(c)]


def with_display(df: DataFrame) -> DataFrame:
    """Default status and display columns; columns already there are kept."""
    wanted = {
        "detection_status": "'Known'",
        "ui_area": f"coalesce({area_label()}, 'unknown area')",
        "ui_type": f"CASE WHEN {site_class()} = 'FCBK' THEN 'Fixed chimney' ELSE 'Zigzag' END",
        "ui_priority": "coalesce(priority_band, 'Unclassified')",
    }
    return df.selectExpr("*", *[f"{e} AS {n}" for n, e in wanted.items() if n not in df.columns])


def payload_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Map payload rows with dictionary-coded type and area, and the dictionary.

    Codes count labels in first-seen (id) order. Rows without coordinates are left out. The
    payload stays a table: one JSON document of the whole table would not fit one task.
    """
    shown = with_display(df).filter("lat IS NOT NULL AND lon IS NOT NULL")
    labels = shown.selectExpr("kiln_id", "explode(array(named_struct('f', 'type', 'l', ui_type), named_struct('f', 'area', 'l', ui_area))) AS e")
    seen = labels.groupBy("e.f", "e.l").agg(F.expr("min(kiln_id) AS first"))
    codes = ranking.ordinal(seen, [F.col("first"), F.col("l")], ["f"], "pos").selectExpr("f", "l", "pos - 1 AS code")
    band = "CASE priority_band WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 WHEN 'Low' THEN 2 ELSE 3 END AS band"
    rows = shown.selectExpr("kiln_id", "round(lat, 5) AS lat", "round(lon, 5) AS lon", band, "ui_type", "ui_area")
    for field in ("type", "area"):
        part = codes.filter(F.col("f") == field).selectExpr(f"l AS ui_{field}", f"code AS {field}")
        rows = rows.join(part, f"ui_{field}")
    return rows.select("kiln_id", "lat", "lon", "band", "type", "area"), codes


def route_segments(df: DataFrame, by: str, order: str, stops: int = 5) -> DataFrame:
    """Split each ordered stop list into runs of ``stops`` that share their end points."""
    placed = ranking.ordinal(df, [F.col(order)], [by], "_i")
    n = df.groupBy(by).agg(F.expr("count(1) AS _n"))
    step = stops - 1
    # Stop i ends run (i - 2) / step and starts run (i - 1) / step; inside a run they agree.
    runs = (
        f"filter(array_distinct(array(floor((_i - 2) / {step}), floor((_i - 1) / {step}))), "
        f"s -> s >= 0 AND (s * {step} + 1 < _n OR _n = 1))"
    )
    each = placed.join(n, by).selectExpr("*", f"explode({runs}) AS segment")
    return each.groupBy(by, "segment").agg(
        F.expr("min(_i) AS first_stop"), F.expr("max(_i) AS last_stop"),
        F.expr("array_join(transform(array_sort(collect_list(struct(_i, lat, lon))), s -> concat(format_number(s.lat, 4), ' ', format_number(s.lon, 4))), '|') AS stops"),
    )


def suggest_places(df: DataFrame, name: str, query: str, limit: int = 12) -> DataFrame:
    """Names containing the folded query, prefix matches first."""
    fold = "regexp_replace(lower({}), '[^\\\\p{{L}}\\\\p{{N}}]', '')"
    needle = F.lit(query)
    folded = df.withColumns({"_f": F.expr(fold.format(name)), "_q": needle}).withColumn("_q", F.expr(fold.format("_q")))
    return (
        folded.filter("_q <> '' AND contains(_f, _q)")
        .orderBy(F.expr("NOT startswith(_f, _q)"), F.expr(f"lower({name})"), name)
        .limit(limit)
        .select(*df.columns)
    )


def advisory_export(df: DataFrame, notice: str) -> DataFrame:
    """Advisory export: notice first, renamed columns, lists as JSON."""
    out = df.drop("geometry", "rules_verified")
    renamed = {c: EXPORT_RENAMES.get(c, c) for c in out.columns}
    for c in out.columns:
        if c.startswith("dist_") and c.endswith("_m"):
            renamed[c] = f"distance_to_mapped_{c[5:-2]}_m"
    lists = [c for c, dtype in out.dtypes if dtype.startswith("array")]
    exprs = [f"to_json({c}) AS {renamed[c]}" if c in lists else f"{c} AS {renamed[c]}" for c in out.columns]
    return out.select(F.lit(notice).alias("advisory_use_notice"), *map(F.expr, exprs))


def review_export(df: DataFrame, rules: Sequence[Rule] = config.RULES) -> DataFrame:
    """The fixed 20-column review table. Forest comes from ``dist_forests_m`` when present."""
    def distance(feature: str) -> str:
        return f"dist_{feature}_m" if f"dist_{feature}_m" in df.columns else "cast(NULL AS double)"

    flags = " OR ".join(f"coalesce({r.distance} < {r.buffer_m!r}D, false)" for r in rules if r.distance in df.columns)
    return df.selectExpr(
        "kiln_id AS ID", "district AS District",
        "CASE WHEN class = 'FCBK' THEN 'Fixed-chimney kiln (flagged for review)' ELSE 'Zigzag kiln' END AS Type",
        "round(confidence * 100, 1) AS Confidence_Pct", "priority AS Priority_Score", "priority_band AS Priority_Band",
        "coalesce(detection_status, 'Known') AS Detection_Status", "lat AS Latitude", "lon AS Longitude",
        f"{distance('schools')} AS Dist_School_m", f"{distance('hospitals')} AS Dist_Hospital_m",
        f"{distance('railways')} AS Dist_Railway_m", f"{distance('settlements')} AS Dist_Settlement_m",
        f"{distance('forests')} AS Dist_Forest_m", f"{distance('water')} AS Dist_Water_m",
        "size(breached_rules) AS Rule_Signals_Count", f"(size(breached_rules) > 0 OR {flags}) AS Flagged_For_Review",
        "cast(NULL AS string) AS Rule_Data_Notes", "cast(size(breached_rules) AS double) AS Breach_Severity_Score",
        "coalesce(get(breached_rules, 0), 'None') AS Top_Rule_Signal",
    )
