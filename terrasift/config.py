"""Screening configuration as data; add a rule by adding a row.

Fixed values: thresholds, severities, weights and layer tags that results must agree on.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Rule:
    id: str
    feature: str
    buffer_m: float
    severity: float
    verified: bool
    label: str = ""

    @property
    def distance(self) -> str:
        return f"dist_{self.feature}_m"

    @property
    def short_label(self) -> str:
        return self.label or self.feature.rstrip("s")


@dataclass(frozen=True)
class Technology:
    flagged_classes: tuple[str, ...]
    severity: float
    verified: bool


@dataclass(frozen=True)
class Scoring:
    exposure_radius_m: float = 1000.0
    sensitivity_radii_m: tuple[float, ...] = (500.0, 750.0, 1000.0, 1500.0, 2000.0)
    normalization: str = "percentile_rank"
    weights: dict[str, float] = field(
        default_factory=lambda: {"n_schools": 1.0, "n_hospitals": 1.0, "settlement_area": 1.0}
    )


RULES = (
    Rule("near_school", "schools", 1000.0, 3.0, False),
    Rule("near_hospital", "hospitals", 1000.0, 3.0, False),
    Rule("near_settlement", "settlements", 1000.0, 2.0, False),
    Rule("near_railway", "railways", 1000.0, 3.0, True),
    Rule("near_wetland", "water", 1000.0, 2.0, False),
    Rule("near_government_forest", "government_forest", 2000.0, 3.0, False),
)
TECHNOLOGY = Technology(("FCBK",), 2.0, False)
TECHNOLOGY_SIGNAL = "technology_flagged"
RULES_VERSION = "draft-1"
SCORING = Scoring()

# Layers that are searched in every district, not only in the site's own.
GLOBAL_LAYERS = ("government_forest",)
# Layers whose distance is kept although no rule uses them.
RETAINED_LAYERS = ("railways", "forests", "water")

LAYER_TAGS: dict[str, dict[str, tuple[str, ...]]] = {
    "schools": {"amenity": ("school",)},
    "hospitals": {"amenity": ("hospital", "clinic", "doctors")},
    "settlements": {"landuse": ("residential",), "place": ("village", "hamlet")},
    "forests": {"landuse": ("forest",), "natural": ("wood",)},
    "water": {
        "natural": ("water", "wetland", "marsh", "swamp", "bog"),
        "waterway": ("river",),
        "landuse": ("reservoir",),
    },
    "railways": {"railway": ("rail", "narrow_gauge", "light_rail")},
}


def any_unverified(rules=RULES, technology: Technology | None = TECHNOLOGY) -> bool:
    """One unverified rule marks every output row as unverified."""
    return (technology is not None and not technology.verified) or any(
        not r.verified for r in rules
    )


# The provenance record of a signal.
PROVENANCE_FIELDS = (
    ("signal_id", "string"),
    ("review_state", "string"),
    ("reviewer", "string"),
    ("reviewed_at", "string"),
    ("evidence_references", "array<string>"),
    ("review_notes", "string"),
    ("rule_config_version", "string"),
    ("rule_config_reference", "string"),
    ("source_layer_id", "string"),
    ("source_authority", "string"),
    ("source_url", "string"),
    ("source_version_date", "string"),
    ("source_accessed_at", "string"),
    ("instrument_id", "string"),
    ("effective_dates", "string"),
    ("feature_id", "string"),
    ("geometry_provenance", "string"),
    ("distance_m", "double"),
    ("measurement_method", "string"),
    ("detector_model", "string"),
    ("detector_version", "string"),
    ("detector_model_version", "string"),
    ("detector_confidence", "double"),
    ("imagery_date", "string"),
)
UNREVIEWED, UNREVIEWED_BEFORE = "unscreened_candidate", "unverified_candidate"
TECHNOLOGY_NOTE = "Model class signal only; no technology or legal status is established."
TECHNOLOGY_METHOD = "detector class label; no GIS/legal conclusion"
FEATURE_NOTE = "Mapped-feature screening signal; legal instrument mapping and applicability are unresolved."
FEATURE_METHOD = "nearest geometry distance from the detection to the mapped feature in projected metres"
SOURCE_DEFAULTS = {
    "source_layer_id": "openstreetmap:{layer}",
    "source_authority": "OpenStreetMap contributors",
    "source_url": "https://www.openstreetmap.org/",
    "geometry_provenance": "Geometry provenance not recorded on this cached feature",
}
