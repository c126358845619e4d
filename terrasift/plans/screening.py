"""Distances, signals, severity, exposure, priority: the screening chain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift import config
from terrasift.functions.overlap import CIRCLE_SIDES
from terrasift.operators import ranking, rules, score, spatial
from terrasift.operators.area import radius_area
from terrasift.plans.registry import query
from terrasift.plans.tables import Tables, project_sql
from terrasift.session import cut_lineage

POINT_LAYERS = ("schools", "hospitals", "settlements", "water")


def metres(c, digits: int = 3):
    scale = 10.0**digits
    return F.floor(c * scale + 0.5) / scale


def m_sql(expr: str, digits: int = 3) -> str:
    return f"floor(({expr}) * 1e{digits} + 0.5) / 1e{digits}"


def layer_edges(t: Tables) -> tuple[DataFrame, DataFrame]:
    """All rule layers as edges, and the polygon layers."""
    points = rules.point_edges(t.features_xy().filter("layer NOT IN ('railways', 'government_forest')"), "district")
    rails = t.rail_segments().selectExpr("layer", "district AS scope", "feature_id", "x1", "y1", "x2", "y2")
    woods = t.forests().selectExpr("layer", "'*' AS scope", "feature_id", "rings")
    edges = points.unionByName(rails).unionByName(spatial.polygon_edges(woods, ["layer", "scope", "feature_id"]))
    return edges, woods


def with_distances(t: Tables) -> DataFrame:
    """Sites with one distance per rule layer and the nearest feature's record."""
    edges, woods = layer_edges(t)
    sites = cut_lineage(t.sites_xy(), "sites")
    return rules.nearest_by_layer(sites, edges, "kiln_id", [r.feature for r in config.RULES], polygons=woods)


def signals(t: Tables) -> DataFrame:
    """Distances rounded to millimetres, then the rule signals and severity."""
    d = with_distances(t)
    rounded = d.withColumns({r.distance: F.expr(m_sql(r.distance)) for r in config.RULES})
    return score.with_severity(rules.with_signals(rounded))


def exposures(t: Tables, radius: float = config.SCORING.exposure_radius_m) -> DataFrame:
    """Counts of schools and hospitals within the radius, over all districts."""
    out = cut_lineage(t.sites_xy(), "sites")
    mapped = cut_lineage(t.features_xy().filter("layer in ('schools', 'hospitals')"), "exposed")
    for layer in ("schools", "hospitals"):
        part = mapped.filter(F.col("layer") == layer)
        out = spatial.radius_count(out, part, "kiln_id", radius, f"n_{layer}")
    return out


def all_components(t: Tables, radius: float = config.SCORING.exposure_radius_m) -> DataFrame:
    """The three raw exposure components of every site; areas to a square metre, as distances go to millimetres."""
    area = radius_area(t.sites_xy(), cut_lineage(t.settlement_polygons(), "homes"), "kiln_id", radius, "settlement_area")
    area = area.select("kiln_id", metres(F.col("settlement_area"), 6).alias("settlement_area"))
    return exposures(t, radius).join(area, "kiln_id").select("kiln_id", *score.COMPONENTS)


def scored(t: Tables) -> DataFrame:
    """The whole chain up to rank and band."""
    return score.prioritise(signals(t).join(all_components(t), "kiln_id"))


# ---- SQL building blocks -------------------------------------------------------------

_D = "sqrt((s.x - f.x) * (s.x - f.x) + (s.y - f.y) * (s.y - f.y))"
_SEG_T = ("greatest(0e0, least(1e0, CASE WHEN ((f.x2 - f.x1) * (f.x2 - f.x1) + (f.y2 - f.y1) * (f.y2 - f.y1)) > 0 THEN "
          "((s.x - f.x1) * (f.x2 - f.x1) + (s.y - f.y1) * (f.y2 - f.y1)) / "
          "((f.x2 - f.x1) * (f.x2 - f.x1) + (f.y2 - f.y1) * (f.y2 - f.y1)) ELSE 0e0 END))")
_SEG = (f"sqrt((s.x - (f.x1 + {_SEG_T} * (f.x2 - f.x1))) * (s.x - (f.x1 + {_SEG_T} * (f.x2 - f.x1))) + "
        f"(s.y - (f.y1 + {_SEG_T} * (f.y2 - f.y1))) * (s.y - (f.y1 + {_SEG_T} * (f.y2 - f.y1))))")

POINT_NEAR_SQL = f"""SELECT s.kiln_id, f.layer, min({_D}) AS d, arg_min(f.feature_id, ({_D}, f.feature_id)) AS feature_id
  FROM sites_xy s JOIN features_xy f ON s.district = f.district
  WHERE f.layer IN ('schools', 'hospitals', 'settlements', 'water') GROUP BY 1, 2"""
RAIL_NEAR_SQL = f"""SELECT s.kiln_id, min({_SEG}) AS d FROM sites_xy s JOIN rail_segments f ON s.district = f.district GROUP BY 1"""
FOREST_EDGES_SQL = """SELECT feature_id, lat, lon, h, x0 AS x1, y0 AS y1, x1 AS x2, y1 AS y2 FROM forests
  UNION ALL SELECT feature_id, lat, lon, h, x1, y1, x2, y2 FROM forests
  UNION ALL SELECT feature_id, lat, lon, h, x2, y2, x3, y3 FROM forests
  UNION ALL SELECT feature_id, lat, lon, h, x3, y3, x0, y0 FROM forests"""
FOREST_NEAR_SQL = f"""SELECT s.kiln_id, min(CASE WHEN abs(s.lat - f.lat) < f.h AND abs(s.lon - f.lon) < f.h THEN 0e0 ELSE {_SEG} END) AS d
  FROM sites_xy s CROSS JOIN forest_edges f GROUP BY 1"""

DIST_CTES = f"""near AS ({POINT_NEAR_SQL}), rail AS ({RAIL_NEAR_SQL}),
forest_edges AS ({FOREST_EDGES_SQL}), wood AS ({FOREST_NEAR_SQL}),
dist AS (SELECT s.*,
  {', '.join(f"{m_sql('n_' + l + '.d')} AS dist_{l}_m" for l in POINT_LAYERS)},
  {m_sql('rail.d')} AS dist_railways_m, {m_sql('wood.d')} AS dist_government_forest_m
  FROM sites_xy s
  {' '.join(f"LEFT JOIN near n_{l} ON n_{l}.kiln_id = s.kiln_id AND n_{l}.layer = '{l}'" for l in POINT_LAYERS)}
  LEFT JOIN rail ON rail.kiln_id = s.kiln_id LEFT JOIN wood ON wood.kiln_id = s.kiln_id)"""

_HIT = {r.id: f"coalesce({r.distance} < {r.buffer_m}, false)" for r in config.RULES}
_LIST = "list_filter([CASE WHEN class = 'FCBK' THEN 'technology_flagged' END, " + ", ".join(
    f"CASE WHEN {_HIT[r.id]} THEN '{r.id}' END" for r in config.RULES) + "], lambda v: v IS NOT NULL)"
_SCORE = "(CASE WHEN class = 'FCBK' THEN 2e0 ELSE 0e0 END" + "".join(
    f" + CASE WHEN {_HIT[r.id]} THEN {r.severity:.1f}::DOUBLE ELSE 0e0 END" for r in config.RULES) + ")"
_NOTES = "concat_ws('; ', " + ", ".join(
    f"CASE WHEN {r.distance} IS NULL THEN '{r.feature}: " +
    ("no readable boundary layer" if r.feature in config.GLOBAL_LAYERS else "no OSM data") + "' END"
    for r in config.RULES) + ")"
_TOP_ORDER = sorted(config.RULES, key=lambda r: -r.severity)
# Strongest first; technology (2) precedes the rules of severity 2 because it is listed first.
_TOP = "CASE " + " ".join(
    f"WHEN {_HIT[r.id]} THEN 'Near {r.short_label} (' || format('{{:,}}', round_even({r.distance}, 0)::BIGINT) || ' m)'"
    for r in _TOP_ORDER if r.severity > 2
) + " WHEN class = 'FCBK' THEN 'FCBK technology' " + " ".join(
    f"WHEN {_HIT[r.id]} THEN 'Near {r.short_label} (' || format('{{:,}}', round_even({r.distance}, 0)::BIGINT) || ' m)'"
    for r in _TOP_ORDER if r.severity <= 2
) + " ELSE 'None' END"
SIGNAL_CTES = DIST_CTES + f""", sig AS (SELECT *, class = 'FCBK' AS technology_flagged, {_LIST} AS breached_rules,
  len({_LIST})::INT AS breach_count, {_SCORE} AS breach_severity_score, {_NOTES} AS rule_data_notes,
  {_TOP} AS top_rule_signal FROM dist)"""

def area_sql(radius: float, n: str = "") -> str:
    """CTE ``area{n}(kiln_id, settlement_area)``: settlement squares cut with a 64-gon, by Green's theorem.

    Every edge of either shape is cut against the half planes of the other.
    """
    turn = f"2e0 * pi() * {{}} / {CIRCLE_SIDES}"
    cut = ("greatest(0e0, max(CASE WHEN f1 > 0 THEN -f0 / f1 END)) AS lo, least(1e0, min(CASE WHEN f1 < 0 THEN -f0 / f1 END)) AS hi, "
           "bool_or(f1 = 0 AND f0 < 0) AS away")
    sides = " UNION ALL ".join(
        f"SELECT feature_id, {e} AS e, x{e} AS ax, y{e} AS ay, x{(e + 1) % 4} AS x_b, y{(e + 1) % 4} AS y_b FROM settlement_polygons" for e in range(4)
    )
    xs, ys = "x0, x1, x2, x3", "y0, y1, y2, y3"
    return f"""ring{n} AS (SELECT k, {radius}::DOUBLE * cos({turn.format('k')}) AS px, {radius}::DOUBLE * sin({turn.format('k')}) AS py,
  {radius}::DOUBLE * cos({turn.format('(k + 1)')}) AS qx, {radius}::DOUBLE * sin({turn.format('(k + 1)')}) AS qy FROM range({CIRCLE_SIDES}) r(k)),
side{n} AS ({sides}),
meet{n} AS (SELECT kiln_id, x, y, feature_id FROM sites_xy JOIN settlement_polygons ON greatest({xs}) >= x - {radius} AND least({xs}) <= x + {radius}
  AND greatest({ys}) >= y - {radius} AND least({ys}) <= y + {radius}),
shape{n} AS (SELECT kiln_id, feature_id, e, k, ax - x AS ax, ay - y AS ay, x_b - x AS x_b, y_b - y AS y_b, px, py, qx, qy FROM meet{n} JOIN side{n} USING (feature_id), ring{n}),
piece{n} AS (SELECT kiln_id, CASE WHEN NOT away AND lo < hi THEN (hi - lo) * (any_value(ax) * any_value(y_b) - any_value(ay) * any_value(x_b)) / 2 ELSE 0e0 END AS a
  FROM (SELECT kiln_id, feature_id, e, any_value(ax) AS ax, any_value(ay) AS ay, any_value(x_b) AS x_b, any_value(y_b) AS y_b, {cut}
    FROM (SELECT *, (qx - px) * (ay - py) - (qy - py) * (ax - px) AS f0, (qx - px) * (y_b - ay) - (qy - py) * (x_b - ax) AS f1 FROM shape{n}) GROUP BY 1, 2, 3) GROUP BY kiln_id, feature_id, e, away, lo, hi
  UNION ALL SELECT kiln_id, CASE WHEN NOT away AND lo < hi THEN (hi - lo) * (px * qy - py * qx) / 2 ELSE 0e0 END
  FROM (SELECT kiln_id, feature_id, k, any_value(px) AS px, any_value(py) AS py, any_value(qx) AS qx, any_value(qy) AS qy, {cut}
    FROM (SELECT *, (x_b - ax) * (py - ay) - (y_b - ay) * (px - ax) AS f0, (x_b - ax) * (qy - py) - (y_b - ay) * (qx - px) AS f1 FROM shape{n}) GROUP BY 1, 2, 3)),
area{n} AS (SELECT s.kiln_id, {m_sql('coalesce(sum(a), 0e0) / 1e6', 6)} AS settlement_area FROM sites_xy s LEFT JOIN piece{n} USING (kiln_id) GROUP BY 1)"""


def exposure_sql(radius: float, n: str = "") -> str:
    return f"""hits{n} AS (SELECT s.kiln_id,
  count(*) FILTER (f.layer = 'schools') AS n_schools, count(*) FILTER (f.layer = 'hospitals') AS n_hospitals
  FROM sites_xy s JOIN features_xy f ON {_D} <= {radius} GROUP BY 1),
expo{n} AS (SELECT s.kiln_id, coalesce(n_schools, 0) AS n_schools, coalesce(n_hospitals, 0) AS n_hospitals
  FROM sites_xy s LEFT JOIN hits{n} USING (kiln_id))"""


EXPOSURE_CTES = exposure_sql(config.SCORING.exposure_radius_m)
AREA_CTES = area_sql(config.SCORING.exposure_radius_m)


def pr_sql(col: str) -> str:
    return (f"CASE WHEN {col} = 0 THEN 0e0 ELSE (rank() OVER (ORDER BY {col}) - 1 + (count(*) OVER (PARTITION BY {col}) + 1) / 2e0) "
            f"/ count(*) OVER () END")


def norm_sql(n: str = "") -> str:
    parts = ", ".join(f"{pr_sql(c)} AS {c}_normalized" for c in score.COMPONENTS)
    return f"norm{n} AS (SELECT *, {parts} FROM sig JOIN expo{n} USING (kiln_id) JOIN area{n} USING (kiln_id))"


def exposure_of(weights: dict[str, float]) -> str:
    return "(0e0" + "".join(f" + {weights[c]!r}::DOUBLE * {c}_normalized" for c in score.COMPONENTS) + ")"


SCORE_CTES = SIGNAL_CTES + ", " + EXPOSURE_CTES + ", " + AREA_CTES + ", " + norm_sql() + f""",
pri AS (SELECT *, {exposure_of(config.SCORING.weights)} AS exposure,
  confidence * breach_severity_score * (1e0 + {exposure_of(config.SCORING.weights)}) AS priority FROM norm),
prio AS (SELECT *, rank() OVER (ORDER BY priority DESC) AS priority_rank,
  CASE WHEN row_number() OVER (ORDER BY priority, kiln_id) <= 1 + (count(*) OVER () - 1) * 0.4::DOUBLE THEN 'Low'
       WHEN row_number() OVER (ORDER BY priority, kiln_id) <= 1 + (count(*) OVER () - 1) * 0.8::DOUBLE THEN 'Medium'
       ELSE 'High' END AS priority_band FROM pri)"""


# ---- Queries -------------------------------------------------------------------------

@query("project_sites", f"SELECT kiln_id, {m_sql('x')} AS x, {m_sql('y')} AS y FROM sites_xy")
def project_sites(t: Tables) -> DataFrame:
    return t.sites_xy().select("kiln_id", metres(F.col("x")).alias("x"), metres(F.col("y")).alias("y"))


@query("nearest_feature_by_district", f"""WITH near AS ({POINT_NEAR_SQL})
SELECT s.kiln_id, {m_sql('d')} AS distance_m, feature_id FROM sites_xy s LEFT JOIN near n ON n.kiln_id = s.kiln_id AND n.layer = 'schools'""")
def nearest_feature(t: Tables) -> DataFrame:
    schools = t.features_xy().filter("layer = 'schools'")
    sites = cut_lineage(t.sites_xy().select("kiln_id", "district", "x", "y"), "sites")
    out = spatial.nearest(sites, schools, "kiln_id", ["feature_id"], ["district"])
    return out.select("kiln_id", metres(F.col("distance")).alias("distance_m"), "feature_id")


def _one_layer(t: Tables, layer: str) -> DataFrame:
    edges, woods = layer_edges(t)
    mapped = edges.filter(F.col("layer") == layer)
    polygons = woods if layer == "government_forest" else None
    sites = cut_lineage(t.sites_xy(), "sites")
    return rules.nearest_by_layer(sites, mapped, "kiln_id", [layer], polygons=polygons).selectExpr(
        "kiln_id", f"{m_sql(f'dist_{layer}_m')} AS distance_m"
    )


@query("nearest_railway_segment", f"""WITH rail AS ({RAIL_NEAR_SQL})
SELECT s.kiln_id, {m_sql('d')} AS distance_m FROM sites_xy s LEFT JOIN rail USING (kiln_id)""")
def nearest_rail(t: Tables) -> DataFrame:
    return _one_layer(t, "railways")


@query("nearest_forest_polygon", f"""WITH forest_edges AS ({FOREST_EDGES_SQL}), wood AS ({FOREST_NEAR_SQL})
SELECT kiln_id, {m_sql('d')} AS distance_m FROM wood""")
def nearest_forest(t: Tables) -> DataFrame:
    return _one_layer(t, "government_forest")


@query("retained_layer_distances", f"""WITH {DIST_CTES} SELECT kiln_id, dist_railways_m, dist_water_m FROM dist""")
def retained(t: Tables) -> DataFrame:
    edges, _ = layer_edges(t)
    kept = rules.nearest_by_layer(
        cut_lineage(t.sites_xy(), "sites"), edges.filter("layer IN ('railways', 'water')"), "kiln_id", ["railways", "water"]
    )
    return kept.selectExpr("kiln_id", *[f"{m_sql(c)} AS {c}" for c in ("dist_railways_m", "dist_water_m")])


@query("rule_signals", f"""WITH {SIGNAL_CTES} SELECT kiln_id, technology_flagged,
array_to_string(breached_rules, ',') AS breached_rules, breach_count, breach_severity_score AS breach_score,
rule_data_notes, false AS rules_verified FROM sig""")
def rule_signals(t: Tables) -> DataFrame:
    return signals(t).select(
        "kiln_id", "technology_flagged", F.array_join("breached_rules", ",").alias("breached_rules"),
        "breach_count", "breach_score", "rule_data_notes", "rules_verified",
    )


@query("severity_and_top_signal", f"WITH {SIGNAL_CTES} SELECT kiln_id, breach_severity_score, top_rule_signal FROM sig")
def severity(t: Tables) -> DataFrame:
    return signals(t).select("kiln_id", "breach_severity_score", "top_rule_signal")


@query("signal_provenance")
def signal_provenance(t: Tables) -> DataFrame:
    d = with_distances(t)
    for r in config.RULES:
        f = f"{r.distance}_feature"
        record = F.struct(
            F.col(f"{f}.feature_id").alias("feature_id"),
            *[F.lit(None).cast("string").alias(n) for n in rules.FEATURE_FIELDS if n != "feature_id"],
        )
        d = d.withColumn(f, record)
    detector = {"detector_model": F.lit("obb"), "detector_version": F.lit("1"), "imagery_date": F.lit(None).cast("string")}
    return d.withColumns(detector).select("kiln_id", rules.provenance().alias("signal_provenance_json"))


@query("provenance_review_states")
def provenance_review(t: Tables) -> DataFrame:
    s = signals(t)
    stored = F.when(
        F.pmod("kiln_id", F.lit(2)) == 0,
        F.to_json(F.transform("breached_rules", lambda b: F.struct(b.alias("signal_id"), F.lit("unverified_candidate").alias("review_state")))),
    )
    parsed = s.withColumn("p", rules.parse_provenance(stored, F.col("breached_rules")))
    return parsed.select("kiln_id", F.explode("p").alias("p")).select("kiln_id", "p.signal_id", "p.review_state", "p.review_notes")


@query("radius_counts", f"WITH {EXPOSURE_CTES} SELECT kiln_id, n_schools, n_hospitals FROM expo")
def radius_counts(t: Tables) -> DataFrame:
    return exposures(t).select("kiln_id", "n_schools", "n_hospitals")


@query("settlement_area_within_radius", f"WITH {AREA_CTES} SELECT kiln_id, settlement_area FROM area")
def settlement_area(t: Tables) -> DataFrame:
    area = radius_area(t.sites_xy(), cut_lineage(t.settlement_polygons(), "homes"), "kiln_id", config.SCORING.exposure_radius_m, "settlement_area")
    return area.select("kiln_id", metres(F.col("settlement_area"), 6).alias("settlement_area"))


@query("screen_ranked_sites", f"""WITH {SCORE_CTES} SELECT kiln_id, district, class,
array_to_string(breached_rules, ',') AS breached_rules, top_rule_signal, n_schools, n_hospitals,
{m_sql('exposure', 6)} AS exposure, {m_sql('priority', 6)} AS priority, priority_rank, priority_band FROM prio""")
def ranked_sites(t: Tables) -> DataFrame:
    return scored(t).select(
        "kiln_id", "district", "class", F.array_join("breached_rules", ",").alias("breached_rules"),
        "top_rule_signal", "n_schools", "n_hospitals", metres(F.col("exposure"), 6).alias("exposure"),
        metres(F.col("priority"), 6).alias("priority"), "priority_rank", "priority_band",
    )


@query("priority_with_settlement_area", f"""WITH {SCORE_CTES} SELECT kiln_id, n_schools, n_hospitals, settlement_area,
{m_sql('exposure', 6)} AS exposure, {m_sql('priority', 6)} AS priority, priority_rank, priority_band FROM prio""")
def full_priority(t: Tables) -> DataFrame:
    return scored(t).select(
        "kiln_id", *score.COMPONENTS, metres(F.col("exposure"), 6).alias("exposure"),
        metres(F.col("priority"), 6).alias("priority"), "priority_rank", "priority_band",
    )


@query("top_20_by_rank", f"WITH {SCORE_CTES} SELECT kiln_id, priority_rank FROM prio ORDER BY priority_rank, kiln_id LIMIT 20")
def top20(t: Tables) -> DataFrame:
    return score.top_k(scored(t)).select("kiln_id", "priority_rank")


def weight_sets() -> dict[str, dict[str, float]]:
    """The configured weights, and each weight doubled in turn (a zero becomes one)."""
    base = config.SCORING.weights
    return {"baseline": base} | {f"{c}_doubled": base | {c: 2 * w if w else 1.0} for c, w in base.items()}


def tops_sql(variants: list[tuple[str, str, dict[str, float]]]) -> str:
    """CTEs ``tops`` and ``common``: the 20 best of each (variant, suffix, weights), and those shared with the first."""
    parts = [f"""(SELECT '{name}' AS variant, kiln_id, row_number() OVER (ORDER BY r, kiln_id) AS pos FROM (
  SELECT kiln_id, rank() OVER (ORDER BY confidence * breach_severity_score * (1e0 + {exposure_of(weights)}) DESC) AS r FROM norm{n})
  QUALIFY pos <= 20)""" for name, n, weights in variants]
    return f"""tops AS ({' UNION ALL '.join(parts)}),
common AS (SELECT v.variant, rank() OVER (PARTITION BY v.variant ORDER BY b.pos) AS ra, rank() OVER (PARTITION BY v.variant ORDER BY v.pos) AS rb
  FROM tops v JOIN tops b ON b.variant = '{variants[0][0]}' AND b.kiln_id = v.kiln_id),
rho AS (SELECT variant, count(*) AS top20_overlap, CASE WHEN count(*) >= 3 THEN {m_sql('corr(ra, rb)', 6)} END AS spearman_rho FROM common GROUP BY 1)"""


def ranked_variants(norm: DataFrame, sets: dict[str, dict[str, float]]) -> dict[str, DataFrame]:
    """The 20 best sites of each weight set, from normalised components."""
    out = {}
    for name, weights in sets.items():
        expo = F.lit(0.0)
        for c in score.COMPONENTS:
            expo = expo + F.lit(weights[c]) * F.col(f"{c}_normalized")
        # Ranks fall with the priority, so its negative puts the sites in the same order.
        ordered = norm.select("kiln_id", (-score.priority(expo)).alias("priority_rank"))
        out[name] = cut_lineage(score.top_k(ordered), "top")
    return out


@query("rank_sensitivity_by_weights", f"WITH {SCORE_CTES}, {tops_sql([(k, '', w) for k, w in weight_sets().items()])} SELECT * FROM rho")
def sensitivity(t: Tables) -> DataFrame:
    raw = cut_lineage(signals(t).select("kiln_id", "confidence", "breach_severity_score").join(all_components(t), "kiln_id"), "raw")
    norm = cut_lineage(score.add_exposure(raw), "norm")
    out = score.rank_sensitivity(ranked_variants(norm, weight_sets()), "baseline")
    return out.withColumn("spearman_rho", metres(F.col("spearman_rho"), 6))


_GRID = [(f"{r:g}:{name}", f"_{i}", w) for i, r in enumerate(config.SCORING.sensitivity_radii_m) for name, w in weight_sets().items()]
_GRID_CTES = ", ".join(
    f"{exposure_sql(r, f'_{i}')}, {area_sql(r, f'_{i}')}, {norm_sql(f'_{i}')}" for i, r in enumerate(config.SCORING.sensitivity_radii_m)
)


@query("rank_sensitivity_by_radius_and_weights", f"""WITH {SIGNAL_CTES}, {_GRID_CTES}, {tops_sql(_GRID)}
SELECT split_part(variant, ':', 1)::DOUBLE AS radius_m, split_part(variant, ':', 2) AS weights, top20_overlap, spearman_rho FROM rho""")
def sensitivity_grid(t: Tables, radii: Sequence[float] = config.SCORING.sensitivity_radii_m) -> DataFrame:
    """Top 20 of every radius and weight set against the first radius with the configured weights."""
    severe = cut_lineage(signals(t).select("kiln_id", "confidence", "breach_severity_score"), "severe")
    tops = {}
    for radius in radii:
        raw = cut_lineage(severe.join(all_components(t, radius), "kiln_id"), "raw")
        found = ranked_variants(cut_lineage(score.add_exposure(raw), "norm"), weight_sets())
        tops |= {f"{radius:g}:{name}": top for name, top in found.items()}
    out = score.rank_sensitivity(tops, next(iter(tops)))
    return out.select(
        F.split_part("variant", F.lit(":"), F.lit(1)).cast("double").alias("radius_m"),
        F.split_part("variant", F.lit(":"), F.lit(2)).alias("weights"),
        "top20_overlap", metres(F.col("spearman_rho"), 6).alias("spearman_rho"),
    )


@query("top_list_intersection", f"""WITH {SCORE_CTES},
a AS (SELECT kiln_id FROM prio ORDER BY priority_rank, kiln_id LIMIT 20),
b AS (SELECT kiln_id FROM prio ORDER BY confidence DESC, kiln_id LIMIT 20)
SELECT kiln_id FROM a INTERSECT SELECT kiln_id FROM b""")
def top_intersection(t: Tables) -> DataFrame:
    s = cut_lineage(scored(t).select("kiln_id", "priority_rank", "confidence"), "ranked")
    a = score.top_k(s).select("kiln_id")
    return a.intersect(s.orderBy(F.desc("confidence"), "kiln_id").limit(20).select("kiln_id"))


@query("percentile_rank_normalised", f"WITH {EXPOSURE_CTES} SELECT kiln_id, {m_sql(pr_sql('n_schools'), 9)} AS n_schools_normalized FROM expo")
def percentile_norm(t: Tables) -> DataFrame:
    df = cut_lineage(exposures(t).select("kiln_id", "n_schools"), "counts")
    out = ranking.normalise(df, "n_schools", "n")
    return out.select("kiln_id", metres(F.col("n"), 9).alias("n_schools_normalized"))


@query("minmax_normalised", """SELECT c_custkey AS kiln_id, floor((c_acctbal - min(c_acctbal) OVER ()) /
(max(c_acctbal) OVER () - min(c_acctbal) OVER ()) * 1e9 + 0.5) / 1e9 AS scaled FROM customer""")
def minmax_norm(t: Tables) -> DataFrame:
    df = t.raw("customer").select(F.col("c_custkey").alias("kiln_id"), "c_acctbal")
    return ranking.normalise(df, "c_acctbal", "s", "minmax").select("kiln_id", metres(F.col("s"), 9).alias("scaled"))


@query("priority_rank_and_bands", """SELECT c_custkey AS kiln_id, rank() OVER (ORDER BY c_acctbal DESC) AS priority_rank,
CASE WHEN row_number() OVER (ORDER BY c_acctbal, c_custkey) <= 1 + (count(*) OVER () - 1) * 0.4::DOUBLE THEN 'Low'
WHEN row_number() OVER (ORDER BY c_acctbal, c_custkey) <= 1 + (count(*) OVER () - 1) * 0.8::DOUBLE THEN 'Medium' ELSE 'High' END AS priority_band FROM customer""")
def rank_and_bands(t: Tables) -> DataFrame:
    df = t.raw("customer").select(F.col("c_custkey").alias("kiln_id"), F.col("c_acctbal").alias("priority"))
    ranked = ranking.rank_descending(df, "priority", "priority_rank")
    return ranking.priority_bands(ranked, "priority", "kiln_id").drop("priority")


@query("carry_over_annotation", """SELECT kiln_id, 'seen ' || n AS detection_status FROM sites LEFT JOIN
(SELECT o_custkey AS kiln_id, min(o_orderpriority) AS n FROM orders GROUP BY 1) USING (kiln_id)""")
def carry_over(t: Tables) -> DataFrame:
    earlier = t.raw("orders").select(F.col("o_custkey").alias("kiln_id"), F.concat(F.lit("seen "), "o_orderpriority").alias("detection_status"))
    return score.keep_annotation(t.sites(), earlier, "kiln_id", "detection_status").select("kiln_id", "detection_status")
