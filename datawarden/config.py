"""Constants, enums and the tunable settings, with the argument checks that guard them."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace
from typing import Any

# ---------------------------------------------------------------------------
# Fixed values. Results depend on every one of them.
# ---------------------------------------------------------------------------
DATA_TYPES = ("STRING", "INTEGER", "FLOAT", "BOOLEAN", "DATE", "DATETIME", "UNKNOWN")
PII_CATEGORIES = (
    "EMAIL", "PHONE", "ID_NUMBER", "CREDIT_CARD", "DATE_OF_BIRTH",
    "NAME", "ADDRESS", "IP_ADDRESS", "POSTAL_CODE", "NONE", "OTHER",
)
SENSITIVITIES = ("NONE", "LOW", "MEDIUM", "HIGH")  # ascending rank
TAG_SOURCES = ("AUTO_REGEX", "AUTO_AI", "MANUAL")
ACCESS_TYPES = ("VIEW", "DETAIL_VIEW", "DOWNLOAD")
STATUSES = ("PROCESSING", "READY", "FAILED")
RECOMMENDATIONS = ("KEEP", "OPTIMIZE", "ARCHIVE", "RETIRE")
STRUCTURAL_ISSUES = ("DUPLICATE_HEADER", "BLANK_HEADER", "RAGGED_ROWS")

QUALITY_WEIGHTS = {"completeness": 0.40, "validity": 0.30, "uniqueness": 0.30}
TRUST_WEIGHTS = {"quality": 0.45, "consistency": 0.30, "classification_coverage": 0.25}
VALUE_WEIGHTS = {"frequency": 0.45, "recency": 0.35, "trend": 0.20}
RECOMMEND_CUTOFFS = {"retire_below": 15.0, "archive_below": 35.0, "optimize_below": 60.0}
CLASSIFY_THRESHOLD = 0.70
FREQ_CAP = 50
HALF_LIFE_DAYS = 30.0
TREND_BASELINE_MIN = 5
RECENCY_MIN_ACCESSES = 3
STRUCTURAL_PENALTY_PER_ISSUE = 0.05
STRUCTURAL_PENALTY_CAP = 0.20
SENSITIVITY_BY_CATEGORY = {
    "EMAIL": "HIGH",
    "PHONE": "HIGH",
    "ID_NUMBER": "HIGH",
    "CREDIT_CARD": "HIGH",
    "DATE_OF_BIRTH": "HIGH",
    "NAME": "MEDIUM",
    "ADDRESS": "MEDIUM",
    "IP_ADDRESS": "MEDIUM",
    "POSTAL_CODE": "LOW",
    "OTHER": "LOW",
    "NONE": "NONE",
}
HEADER_CONFIDENCE = 0.60
AMBIGUOUS_MIN = 0.30
SAMPLE_VALUES = 10
PREVIEW_ROWS = 50
SAMPLE_CHARS = 256
MAX_FILE_BYTES = 100 * 1024 * 1024
DATASET_NAME_CHARS = 255
# Bounds of the settings, ends included, and how far a block's weights may sum from 1.
WEIGHT_RANGE = (0, 1)
WEIGHT_TOLERANCE = 0.001
THRESHOLD_RANGE = (0, 1)
FREQ_CAP_RANGE = (1, 100_000)
HALF_LIFE_RANGE = (0.5, 3650)
CUTOFF_RANGE = (0, 100)
# ---------------------------------------------------------------------------


class SettingsError(ValueError):
    """An override that would make a score meaningless."""


def _check_weights(name: str, given: dict[str, float], expected: dict[str, float]) -> None:
    if set(given) != set(expected):
        raise SettingsError(f"{name}: expected exactly the keys {sorted(expected)}")
    for key, weight in given.items():
        _check_range(f"{name}.{key}", weight, WEIGHT_RANGE)
    if abs(sum(given.values()) - 1) > WEIGHT_TOLERANCE:
        raise SettingsError(f"{name}: weights must sum to 1.0 (tolerance {WEIGHT_TOLERANCE})")


def _check_range(name: str, value: float, bounds: tuple[float, float]) -> None:
    low, high = bounds
    if isinstance(value, bool) or not low <= value <= high:
        raise SettingsError(f"{name}: must lie in [{low}, {high}]")


@dataclass(frozen=True)
class Settings:
    """The eight run-time tunables. An override replaces a top-level key as a whole."""

    quality: dict[str, float] = field(default_factory=lambda: dict(QUALITY_WEIGHTS))
    trust: dict[str, float] = field(default_factory=lambda: dict(TRUST_WEIGHTS))
    value: dict[str, float] = field(default_factory=lambda: dict(VALUE_WEIGHTS))
    classify_threshold: float = CLASSIFY_THRESHOLD
    freq_cap: int = FREQ_CAP
    half_life_days: float = HALF_LIFE_DAYS
    recommend: dict[str, float] = field(default_factory=lambda: dict(RECOMMEND_CUTOFFS))
    sensitivity: dict[str, str] = field(default_factory=lambda: dict(SENSITIVITY_BY_CATEGORY))

    def __post_init__(self) -> None:
        _check_weights("quality", self.quality, QUALITY_WEIGHTS)
        _check_weights("trust", self.trust, TRUST_WEIGHTS)
        _check_weights("value", self.value, VALUE_WEIGHTS)
        _check_range("classify_threshold", self.classify_threshold, THRESHOLD_RANGE)
        _check_range("freq_cap", self.freq_cap, FREQ_CAP_RANGE)
        if int(self.freq_cap) != self.freq_cap:
            raise SettingsError("freq_cap: must be a whole number")
        _check_range("half_life_days", self.half_life_days, HALF_LIFE_RANGE)
        if set(self.recommend) != set(RECOMMEND_CUTOFFS):
            raise SettingsError(f"recommend: expected exactly the keys {sorted(RECOMMEND_CUTOFFS)}")
        for key, cutoff in self.recommend.items():
            _check_range(f"recommend.{key}", cutoff, CUTOFF_RANGE)
        r = self.recommend
        if not r["retire_below"] <= r["archive_below"] <= r["optimize_below"]:
            raise SettingsError("recommend: cutoffs must ascend")
        if set(self.sensitivity) != set(PII_CATEGORIES):
            raise SettingsError("sensitivity: every category needs a level")
        if not set(self.sensitivity.values()) <= set(SENSITIVITIES):
            raise SettingsError(f"sensitivity: levels are {SENSITIVITIES}")

    @classmethod
    def keys(cls) -> tuple[str, ...]:
        return tuple(f.name for f in fields(cls))

    def with_overrides(self, overrides: dict[str, Any]) -> Settings:
        unknown = set(overrides) - set(self.keys())
        if unknown:
            raise SettingsError(f"unknown settings: {sorted(unknown)}")
        return replace(self, **overrides)

    def as_json(self) -> dict[str, str]:
        """Each top-level key with its value as canonical JSON text."""
        return {k: json.dumps(v, sort_keys=True) for k, v in asdict(self).items()}
