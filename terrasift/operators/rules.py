"""Rule signals: distances to mapped layers, breached rules and their provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift import config
from terrasift.config import Rule, Technology
from terrasift.operators import polygons as areas
from terrasift.operators import spatial
from terrasift.session import cut_lineage

FEATURE_FIELDS = (
    "feature_id", "source_layer_id", "source_authority", "source_url",
    "source_version_date", "source_accessed_at", "geometry_provenance",
)


def nearest_by_layer(
    sites: DataFrame, edges: DataFrame, key: str, layers: Sequence[str], payload: Sequence[str] = ("feature_id",),
    polygons: DataFrame | None = None, global_layers: Sequence[str] = config.GLOBAL_LAYERS,
) -> DataFrame:
    """Add ``dist_<layer>_m`` and ``dist_<layer>_m_feature`` for every layer in one pass.

    ``edges`` is ``layer, scope, x1, y1, x2, y2`` plus the payload (a point is a zero-length
    edge); ``scope`` is the district, or ``*`` for layers searched everywhere. Inside a
    polygon of ``polygons`` (``layer, scope, rings``) the distance is 0, and the smallest payload
    of those around the site is taken. Groups without features stay null.
    """
    listed = ", ".join(f"'{n}'" for n in layers)
    everywhere = ", ".join(f"'{n}'" for n in global_layers) or "''"
    asked = sites.selectExpr(key, "district", "x", "y", f"explode(array({listed})) AS layer").selectExpr(
        key, "layer", f"CASE WHEN layer IN ({everywhere}) THEN '*' ELSE district END AS scope", "x", "y"
    )
    if polygons is None:
        best = spatial.nearest_best(asked, edges, [key, "layer"], payload, ["scope", "layer"], shape="segment")
    else:
        index = areas.cells(polygons, ["scope", "layer", *payload])
        drawn = ", ".join(f"'{r.layer}'" for r in index.select("layer").distinct().collect()) or "''"
        inside = areas.containing(
            asked.filter(f"layer IN ({drawn})").withColumn("_ask", F.expr(f"struct({key}, layer)")), index, "_ask", list(payload), "x", "y", ["scope", "layer"],
        ).selectExpr(f"_ask.{key} AS {key}", "_ask.layer AS layer", "named_struct('d', 0D, 'pay', _hit) AS _best")
        # Nothing is nearer than 0, so what lies inside has no need of a search among the edges.
        inside = cut_lineage(inside, "inside")
        outside = spatial.met(asked, inside.select(key, "layer"), [key, "layer"], "left_anti")
        best = spatial.nearest_best(outside, edges, [key, "layer"], payload, ["scope", "layer"], shape="segment").unionByName(inside)
    wide = best.groupBy(key).agg(*[F.expr(f"max(_best) FILTER (WHERE layer = '{n}') AS `{n}`") for n in layers])
    out = [e for n in layers for e in (f"`{n}`.d AS dist_{n}_m", f"`{n}`.pay AS dist_{n}_m_feature")]
    return spatial.met(sites, wide, [key], "left").selectExpr("*", *out).drop(*layers)


def point_edges(points: DataFrame, scope: str, payload: Sequence[str] = ("feature_id",)) -> DataFrame:
    return points.selectExpr("layer", f"{scope} AS scope", *payload, "x AS x1", "y AS y1", "x AS x2", "y AS y2")


def fires(rule: Rule) -> str:
    """A rule fires strictly inside its buffer; an unknown distance never fires."""
    return f"coalesce({rule.distance} < {rule.buffer_m!r}D, false)"


def technology_flag(technology: Technology = config.TECHNOLOGY, column: str = "class") -> str:
    names = ", ".join(f"'{c}'" for c in technology.flagged_classes)
    return f"coalesce({column} IN ({names}), false)"


def with_signals(
    df: DataFrame, rules: Sequence[Rule] = config.RULES, technology: Technology = config.TECHNOLOGY
) -> DataFrame:
    """Add the signal columns; technology comes first, then the rules as configured."""
    flagged = technology_flag(technology)
    hits = [f"CASE WHEN {flagged} THEN '{config.TECHNOLOGY_SIGNAL}' END"]
    score = [f"CASE WHEN {flagged} THEN {technology.severity!r}D ELSE 0D END"]
    notes = []
    for r in rules:
        hits.append(f"CASE WHEN {fires(r)} THEN '{r.id}' END")
        score.append(f"CASE WHEN {fires(r)} THEN {r.severity!r}D ELSE 0D END")
        missing = "no readable boundary layer" if r.feature in config.GLOBAL_LAYERS else "no OSM data"
        notes.append(f"CASE WHEN {r.distance} IS NULL THEN '{r.feature}: {missing}' END")
    verified = str(not config.any_unverified(rules, technology)).lower()
    return df.selectExpr(
        "*", f"{flagged} AS technology_flagged", f"array_compact(array({', '.join(hits)})) AS breached_rules",
        f"{' + '.join(score)} AS breach_score", f"concat_ws('; ', {', '.join(notes)}) AS rule_data_notes",
        f"'{config.RULES_VERSION}' AS rules_version", f"{verified} AS rules_verified",
    ).selectExpr("*", "size(breached_rules) AS breach_count", "size(breached_rules) AS rule_signals_count")


def provenance(
    rules: Sequence[Rule] = config.RULES, technology: Technology = config.TECHNOLOGY, evidence: Sequence[str] = (),
) -> Column:
    """One record per signal as JSON: the rule, the nearest feature and the detector.

    Every field of ``config.PROVENANCE_FIELDS`` is written, unknown ones as null; ``evidence``
    lists the caller's references.
    """
    def text(name: str) -> Column:
        return F.nullif(F.trim(F.col(name).cast("string")), F.lit(""))

    model, version = text("detector_model"), text("detector_version")
    detector = {
        "detector_model": model, "detector_version": version,
        "detector_model_version": F.nullif(F.concat_ws(" / ", model, version), F.lit("")),
        "detector_confidence": F.col("confidence").cast("double"), "imagery_date": text("imagery_date"),
    }

    def record(values: dict[str, Column]) -> Column:
        known = {
            "review_state": F.lit(config.UNREVIEWED), "rule_config_version": F.lit(config.RULES_VERSION),
            "evidence_references": F.array(*map(F.lit, evidence)).cast("array<string>"), **detector, **values,
        }
        return F.struct(*[
            known.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in config.PROVENANCE_FIELDS
        ])

    parts = [F.when(F.expr(technology_flag(technology)), record({
        "signal_id": F.lit(config.TECHNOLOGY_SIGNAL), "rule_config_reference": F.lit("technology"),
        "review_notes": F.lit(config.TECHNOLOGY_NOTE), "measurement_method": F.lit(config.TECHNOLOGY_METHOD),
    }))]
    for r in rules:
        feature = F.col(f"{r.distance}_feature")
        source = {f: F.nullif(F.trim(feature[f].cast("string")), F.lit("")) for f in FEATURE_FIELDS}
        for name, default in config.SOURCE_DEFAULTS.items():
            source[name] = F.coalesce(source.get(name, F.lit(None).cast("string")), F.lit(default.format(layer=r.feature)))
        parts.append(F.when(F.expr(fires(r)), record({
            "signal_id": F.lit(r.id), "rule_config_reference": F.lit(f"siting_rules.{r.id}"),
            "review_notes": F.lit(config.FEATURE_NOTE), "distance_m": F.col(r.distance),
            "measurement_method": F.lit(config.FEATURE_METHOD), **source,
        })))
    return F.to_json(F.filter(F.array(*parts), lambda p: p.isNotNull()), {"ignoreNullFields": "false"})


PROVENANCE_SCHEMA = "array<struct<" + ", ".join(f"{name}: {kind}" for name, kind in config.PROVENANCE_FIELDS) + ">>"


def review_states_today(json_text: Column) -> Column:
    """Stored provenance text with today's name of the review state; all other keys stay as they are."""
    old = rf'("review_state"\s*:\s*)"{config.UNREVIEWED_BEFORE}"'
    return F.regexp_replace(json_text, old, f'$1"{config.UNREVIEWED}"')


def parse_provenance(json_text: Column, signals: Column) -> Column:
    """Stored provenance with today's review state; rows from before it was stored get one
    placeholder per signal."""
    parsed = F.from_json(review_states_today(json_text), PROVENANCE_SCHEMA)

    def placeholder(signal: Column) -> Column:
        known = {"signal_id": signal, "review_state": F.lit(config.UNREVIEWED), "review_notes": F.lit("not recorded")}
        return F.struct(*[
            known.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in config.PROVENANCE_FIELDS
        ])

    present = F.coalesce(F.size(parsed) > 0, F.lit(False))
    return F.when(present, parsed).otherwise(F.transform(signals, placeholder))


def signal_status(rule: Rule) -> Column:
    """Present, absent or unknown; unknown coverage is never read as absence."""
    listed = F.coalesce(F.array_contains("breached_rules", F.lit(rule.id)), F.lit(False))
    return (
        F.when(listed, F.lit("Present"))
        .when(F.col(rule.distance).isNull(), F.lit("Unknown / not available"))
        .when(F.col(rule.distance) < rule.buffer_m, F.lit("Present"))
        .otherwise(F.lit("Absent"))
    )


def technology_status() -> Column:
    listed = F.coalesce(
        F.array_contains("breached_rules", F.lit(config.TECHNOLOGY_SIGNAL)), F.lit(False)
    )
    return (
        F.when(listed | F.col("technology_flagged"), F.lit("Present"))
        .when(F.col("technology_flagged").isNull(), F.lit("Unknown / not available"))
        .otherwise(F.lit("Absent"))
    )


def traffic_light(rules: Sequence[Rule], near_factor: float = 1.5) -> tuple[Column, Column]:
    """Code per rule (0 inside or flagged, 1 near, 2 outside, 3 no data) and rounded metres."""
    codes, metres = [], []
    for r in rules:
        d = F.col(r.distance)
        listed = F.coalesce(F.array_contains("breached_rules", F.lit(r.id)), F.lit(False))
        codes.append(
            F.when(d.isNull(), F.lit("3"))
            .when(listed | (d <= r.buffer_m), F.lit("0"))
            .when(d <= r.buffer_m * near_factor, F.lit("1"))
            .otherwise(F.lit("2"))
        )
        metres.append(F.coalesce(F.rint(d).cast("long"), F.lit(-1).cast("long")))
    return F.concat(*codes), F.array(*metres)


def flagged_for_review(rules: Sequence[Rule], count: str = "rule_signals_count") -> Column:
    flag = F.coalesce(F.col(count), F.lit(0)) > 0
    for r in rules:
        flag = flag | F.expr(fires(r))
    return flag


def any_unverified(
    breached: str = "breached_rules", kind: str = "class", rules: Sequence[Rule] = config.RULES, technology: Technology = config.TECHNOLOGY
) -> Column:
    """Whether any rule that fired, or the flagged technology, has not been verified."""
    open_rules = [r.id for r in rules if not r.verified]
    fired = F.exists(breached, lambda r: r.isin(open_rules)) if open_rules else F.lit(False)
    flagged = F.lit(not technology.verified) & F.col(kind).isin(*technology.flagged_classes)
    return F.coalesce(fired, F.lit(False)) | F.coalesce(flagged, F.lit(False))
