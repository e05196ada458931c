"""Table schemas and ingestion profiles."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

LINES = "group_id string, source string, variant string, page int, line int, text string, confidence float"
PROFILE = "struct<kind: string, allow_duplicate_positions: boolean, normalize_whitespace: boolean, normalize_case: boolean, unicode_normalize: boolean, min_confidence: double, similarity_threshold: double>"
CLUSTERS = "array<struct<text: string, total_weight: float, count: int>>"
GROUPS = "map<int, map<int, array<array<string>>>>"
EVENTS = "id string, schema_version int, timestamp bigint, source string, payload string, confidence float"
SNAPSHOTS = f"snapshot_id string, document_id string, created_at timestamp, lines array<struct<page: int, line: int, text: string>>, content_hash string, confidence float, iterations int, rehydration struct<source: string, cluster_groups: {GROUPS}>, schema_version int"
RAW_OBSERVATIONS = f"observation_id string, document_id string, source string, variant string, created_at timestamp, raw_text string, normalized_text string, profile_used {PROFILE}"
OBSERVATIONS = "id string, document_id string, page int, field string, value string, confidence float, iterations int, status string, severity string, reason_code string, note string, created_at timestamp"
ROIS = "group_id string, page int, line int, reason string"


@dataclass(frozen=True)
class Profile:
    """How a source is read: which normalizations apply, what is too uncertain, how alike texts must be to be one."""

    kind: str
    allow_duplicate_positions: bool
    min_confidence: float
    similarity_threshold: float
    normalize_whitespace: bool = True
    normalize_case: bool = False
    unicode_normalize: bool = True

    def as_dict(self) -> dict:
        return asdict(self)

    def with_(self, **changes) -> Profile:
        return replace(self, **changes)


#: The named profiles.
PROFILES = {
    "tesseract": Profile("tesseract", True, 0.55, 0.90),
    "carbo": Profile("carbo", False, 0.80, 0.95),
    "legacy_import": Profile("legacy_import", True, 0.0, 0.90),
    "strict": Profile("strict", False, 0.95, 0.95),
}
DEFAULT = PROFILES["tesseract"]


def profile(name: str) -> Profile:
    """A profile by its name in any case; legacy is short for legacy_import. Unknown names are an error."""
    key = name.lower()
    key = "legacy_import" if key == "legacy" else key
    if key not in PROFILES:
        raise ValueError(f"unknown profile {name!r} (valid: {', '.join(PROFILES)})")
    return PROFILES[key]
