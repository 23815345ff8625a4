"""Frozen parameter sets of the workflow."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Fixed values of the input product.
FILL_VALUE = -999999999999.0
EPOCH_2000_UNIX = 946684800
COLLECTION_TAGS = {"SWOT_L2_HR_LakeSP_2.0": "vC", "SWOT_L2_HR_LakeSP_D": "vD"}

DAY = 86400.0
METRICS = ("wse_std", "wse_u", "xtrk_dist")
RULE_WORDS = ("ice-free", "ice-covered", "both", "not apply")
DEFAULT_RULES = ("ice-free", "ice-free", "not apply")
FILTER_TYPES = ("lowess", "wavelet", "savgol", "kalman", "spline", "median", "hampel")


@dataclass(frozen=True)
class Grouping:
    """Per-metric stratification of the calibration (std, u, xtrk)."""

    by_version: tuple[bool, bool, bool] = (False, False, False)
    by_pass: tuple[bool, bool, bool] = (False, False, True)
    by_ice: tuple[bool, bool, bool] = (True, True, True)
    # True reproduces the observed fallback (two-key levels only, pool of all
    # rows); False follows the documented one (all levels, "both" pool apart).
    compat: bool = False


@dataclass(frozen=True)
class Bounds:
    """Clip ranges, ice floors and threshold-choice rules."""

    std: tuple[float, float] = (0.0, 3.0)
    u: tuple[float, float] = (0.0, 0.5)
    xtrk: tuple[float, float] = (0.0, 75000.0)
    std_ice_min: float = 3.0
    u_ice_min: float = 0.1
    free_rules: tuple[str, str, str] = DEFAULT_RULES
    ice_rules: tuple[str, str, str] = DEFAULT_RULES

    def __post_init__(self):
        for name in ("free_rules", "ice_rules"):
            rules = getattr(self, name)
            if len(rules) != 3 or any(r not in RULE_WORDS for r in rules):
                raise ValueError(f"{name} needs three of {RULE_WORDS}, got {rules!r}")


@dataclass(frozen=True)
class Attempt:
    """One attempt of the low-pass workflow."""

    name: str
    bounds: Bounds
    allow_major_gap: bool
    max_gap_days: float = 90.0
    min_range_days: float = 365.0

    def __post_init__(self):
        if self.max_gap_days < 1:
            raise ValueError("max_gap_days must be at least one day")

    @property
    def min_rows(self) -> float:
        return self.min_range_days / self.max_gap_days + 1.0


STRICT = Attempt("1_strict", Bounds(), allow_major_gap=False)
LENIENT = Attempt(
    "2_lenient",
    Bounds(std=(0.5, 5.0), u=(0.1, 0.5), std_ice_min=5.0, u_ice_min=0.1),
    allow_major_gap=True,
)


@dataclass(frozen=True)
class FilterConfig:
    strict: Attempt = STRICT
    lenient: Attempt = LENIENT
    filter_type: str = "savgol"
    apply_low_pass: bool = True
    evaluate_full_data: bool = False
    second_round: bool = True
    z_scores: tuple[float, float] = (2.576, 3.5)
    residual_spreads: tuple[float, float] = (0.07, 0.05)
    round1_cap: int = 40
    round2_cap: int = 5
    max_median_distance: float = 150.0
    adjust_cycles: bool = True
    append_trace: bool = False

    def __post_init__(self):
        if self.filter_type not in FILTER_TYPES:
            raise ValueError(f"filter_type must be one of {FILTER_TYPES}")

    def with_(self, **kw) -> "FilterConfig":
        return replace(self, **kw)


@dataclass(frozen=True)
class ValidationConfig:
    zero_residual_tol: float = 1e-7
    min_matched: int = 1
    min_raw_matches: int = 2
    min_daily_span_days: int = 365
    major_gauge_gap_days: int = 90
    reference_selection: str = "strict_plus_gap_checked_lenient"
    reference_min_span_days: int = 365
    reference_max_gap_days: float = 120.0
    summary_percentile: float = 68.27
    start_cycle: int = 1
    end_cycle: int = 32
    # method label -> observation column
    methods: dict = field(
        default_factory=lambda: {
            "Raw": "wse",
            "Stringent": "wse_stringent",
            "Permissive": "wse_permissive",
            "Filtered": "wse_adjusted",
        }
    )
