"""Settings of the jobs, checked when made."""

from __future__ import annotations

from dataclasses import dataclass, field

NUMERIC = ("age", "balance", "day", "campaign", "pdays", "previous")
CATEGORICAL = ("job", "marital", "education", "default", "housing", "loan", "contact", "month", "poutcome")
LEAKAGE = ("duration",)
LABEL = "y"
#: Order of the columns in a raw file.
RAW_COLUMNS = (
    "age", "job", "marital", "education", "default", "balance", "housing", "loan", "contact",
    "day", "month", "duration", "campaign", "pdays", "previous", "poutcome", "y",
)
DENSE_FEATURES = (*NUMERIC, "prior_contact_flag")
MISSING = "__MISSING__"


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class FeatureConfig:
    hash_dimension: int = 1_048_576
    dense_log_transform: bool = True
    include_missing: bool = True
    include_duration: bool = False

    def __post_init__(self):
        _require(self.hash_dimension > 0, "hash_dimension must be positive")

    @property
    def dense_names(self) -> tuple[str, ...]:
        return DENSE_FEATURES + (LEAKAGE if self.include_duration else ())


@dataclass(frozen=True)
class DatasetConfig:
    features: FeatureConfig = field(default_factory=FeatureConfig)
    split_strategy: str = "hash"
    train_ratio: float = 0.8
    validation_ratio: float = 0.1
    test_ratio: float = 0.1
    max_rows: int | None = None
    label_delay_seconds: int = 0
    attribution_window_hours: int = 24
    start: str = "2026-01-01T00:00:00Z"
    seconds_per_row: int = 1
    source_name: str = "bank_full_csv"
    task_context: str = "bank_marketing"
    feature_set_version: str = "bank_marketing_v1"

    def __post_init__(self):
        ratios = (self.train_ratio, self.validation_ratio, self.test_ratio)
        _require(self.split_strategy in ("hash", "contiguous"), "split_strategy must be hash or contiguous")
        _require(abs(sum(ratios) - 1.0) <= 1e-9 and min(ratios) >= 0, "split ratios must not be negative and must sum to one")
        _require(self.max_rows is None or self.max_rows > 0, "max_rows must be positive")
        _require(self.label_delay_seconds >= 0, "label_delay_seconds must not be negative")


@dataclass(frozen=True)
class TrainingConfig:
    loss: str = "cross_entropy"
    optimizer: str = "adagrad"
    learning_rate: float = 0.05
    max_epochs: int = 12
    l1: float = 0.0
    l2: float = 1e-4
    epsilon: float = 1e-8
    class_weighting: bool = True
    oversample: bool = False
    shuffle: bool = True
    seed: int = 13
    patience: int = 3

    def __post_init__(self):
        _require(self.loss in ("cross_entropy", "mse"), "unknown loss")
        _require(self.optimizer in ("adagrad", "sgd"), "unknown optimizer")
        _require(self.learning_rate > 0 and self.max_epochs > 0 and self.epsilon > 0, "rates and epochs must be positive")
        _require(min(self.l1, self.l2, self.patience) >= 0, "penalties and patience must not be negative")


@dataclass(frozen=True)
class RankingConfig:
    k: int = 25
    exploration_rate: float = 0.15
    # What rows and model of the second stage are stamped with.
    feature_set_version: str = "bank_marketing_hybrid_v1"
    task_context: str = "hybrid_ranking"
    reranker: TrainingConfig = TrainingConfig(max_epochs=10, l2=5e-4, seed=31)

    def __post_init__(self):
        _require(self.k > 0, "k must be positive")
        _require(0.0 <= self.exploration_rate <= 1.0, "exploration_rate must lie between 0 and 1")


@dataclass(frozen=True)
class Band:
    """Action for probabilities below ``below`` (None: no upper end) that no earlier band took."""

    below: float | None
    action: str
    reason: str
    threshold: float
    review: bool


@dataclass(frozen=True)
class Policy:
    version: str
    bands: tuple[Band, ...]
    positive_action: str


# Thresholds, actions and reasons of the three decision contexts.
POLICIES = {
    "bank_marketing": Policy(
        "bank_marketing_policy_v1",
        (
            Band(0.08, "suppress", "below_low_propensity", 0.08, False),
            Band(0.22, "nurture", "between_propensity_thresholds", 0.08, False),
            Band(None, "prioritize_contact", "above_high_propensity", 0.22, False),
        ),
        "prioritize_contact",
    ),
    "fraud_policy": Policy(
        "fraud_policy_v1",
        (
            Band(0.15, "approve", "below_manual_review_threshold", 0.15, False),
            Band(0.65, "review", "between_manual_review_and_auto_block", 0.15, True),
            Band(None, "block", "above_auto_block_threshold", 0.65, True),
        ),
        "approve",
    ),
    "loan_policy": Policy(
        "loan_policy_v1",
        (
            Band(0.12, "approve", "below_manual_review_threshold", 0.12, False),
            Band(0.18, "review", "between_manual_review_and_decline", 0.12, True),
            Band(None, "decline", "above_decline_threshold", 0.18, True),
        ),
        "approve",
    ),
}


@dataclass(frozen=True)
class AlertThresholds:
    max_p95_latency_ms: float = 10.0
    max_dense_psi: float = 0.2
    max_sparse_psi: float = 0.2
    max_live_ece: float = 0.03
    max_manual_review_rate: float = 0.85
    max_subgroup_calibration_gap: float = 0.05
    max_approval_rate_gap: float = 0.05
    min_prediction_link_rate: float = 0.99
