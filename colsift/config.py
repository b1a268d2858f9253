"""Thresholds, weights and limits, as frozen values that become literals."""

from __future__ import annotations

from dataclasses import dataclass, field


class AuditError(ValueError):
    """An input or argument the audit cannot work with; ``code`` names it."""

    def __init__(self, message: str, code: str) -> None:
        super().__init__(message)
        self.code = code


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def _ascending(values, low: float = 0.0, high: float = 100.0) -> bool:
    chain = (low, *values, high)
    return all(a <= b for a, b in zip(chain, chain[1:]))


@dataclass(frozen=True)
class CheckConfig:
    """Thresholds of the nine checks. All shares are percentages."""

    # The default thresholds.
    # upper ends of LOW, MEDIUM and HIGH; above the last is CRITICAL
    missing_bands: tuple[float, float, float] = (5.0, 20.0, 40.0)
    duplicate_bands: tuple[float, float, float] = (1.0, 5.0, 10.0)
    outlier_bands: tuple[float, float, float] = (1.0, 5.0, 10.0)
    # upper ends of LOW and MEDIUM; above the last is HIGH
    category_bands: tuple[float, float] = (5.0, 20.0)

    near_constant_share: float = 95.0
    near_constant_high_share: float = 99.0

    identifier_text_share: float = 95.0
    identifier_name_share: float = 80.0

    cardinality_count: int = 20
    cardinality_share: float = 20.0
    cardinality_high_share: float = 80.0

    iqr_multiplier: float = 1.5
    # quartiles from sketches of this size in one pass, within a stated rank error; exact where it is None
    approx_quartiles: int | None = None

    numeric_text_share: float = 90.0
    date_text_share: float = 80.0
    mixed_date_formats: int = 2

    # lengths of the example lists
    duplicate_examples: int = 10
    outlier_examples: int = 5
    variant_examples: int = 10
    invalid_examples: int = 5

    def __post_init__(self) -> None:
        for name in ("missing", "duplicate", "outlier", "category"):
            bands = getattr(self, f"{name}_bands")
            _require(_ascending(bands), f"{name}_bands must ascend within 0..100")
        for name in (
            "near_constant_share", "near_constant_high_share",
            "identifier_text_share", "identifier_name_share",
            "cardinality_share", "cardinality_high_share",
            "numeric_text_share", "date_text_share",
        ):
            _require(0 <= getattr(self, name) <= 100, f"{name} must lie within 0..100")
        _require(self.near_constant_share <= self.near_constant_high_share,
                 "near_constant_high_share must not be below near_constant_share")
        _require(self.cardinality_share <= self.cardinality_high_share,
                 "cardinality_high_share must not be below cardinality_share")
        _require(self.cardinality_count >= 2, "cardinality_count must be at least 2")
        _require(self.approx_quartiles is None or 8 <= self.approx_quartiles <= 65535, "approx_quartiles must lie within 8..65535")
        _require(self.iqr_multiplier > 0, "iqr_multiplier must be positive")
        _require(self.mixed_date_formats >= 2, "mixed_date_formats must be at least 2")
        _require(self.variant_examples >= 2, "variant_examples must be at least 2")
        _require(min(self.duplicate_examples, self.outlier_examples,
                     self.invalid_examples) >= 0, "example counts cannot be negative")


COMPONENTS = (
    "completeness",
    "duplicate_free",
    "schema_usability",
    "categorical_consistency",
    "outlier_risk",
)


@dataclass(frozen=True)
class ScoreConfig:
    """Component weights, severity penalties and score bands."""

    # The default weights, penalties and bands.
    weights: dict[str, float] = field(default_factory=lambda: dict(
        completeness=0.35, duplicate_free=0.20, schema_usability=0.15,
        categorical_consistency=0.15, outlier_risk=0.15))
    penalties: dict[str, float] = field(default_factory=lambda: dict(
        PASS=0.0, LOW=10.0, MEDIUM=25.0, HIGH=50.0, CRITICAL=100.0))
    ready_score: float = 85.0
    cleaning_score: float = 70.0
    significant_score: float = 50.0
    gates: bool = True

    def __post_init__(self) -> None:
        _require(set(self.weights) == set(COMPONENTS), "weights must name every component")
        _require(min(self.weights.values()) >= 0, "weights cannot be negative")
        _require(abs(sum(self.weights.values()) - 1.0) <= 1e-9, "weights must sum to 1")
        steps = [self.penalties[s] for s in ("PASS", "LOW", "MEDIUM", "HIGH", "CRITICAL")]
        _require(_ascending(steps), "penalties must ascend within 0..100")
        _require(_ascending((self.significant_score, self.cleaning_score, self.ready_score)),
                 "score bands must ascend within 0..100")


@dataclass(frozen=True)
class ReportConfig:
    version: str = "1.0"
    max_recommendations: int = 10
    include_check_results: bool = False

    def __post_init__(self) -> None:
        _require(bool(self.version.strip()), "version cannot be empty")
        _require(self.max_recommendations >= 0, "max_recommendations cannot be negative")


@dataclass(frozen=True)
class IntakeConfig:
    """Optional file limits (off by default) and accepted formats."""

    max_bytes: int | None = None
    max_rows: int | None = None
    max_columns: int | None = None
    delimiters: tuple[str, ...] = (",", ";", "\t", "|")
    encodings: tuple[str, ...] = ("utf-8-sig", "cp1252", "latin-1")
