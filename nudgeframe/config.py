"""Small frozen settings objects that parameterise the operators."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, replace
from datetime import datetime

# Temporal policies, feature groups and the named recipe families.
TEMPORAL_POLICIES = (
    "pre_issue_only",
    "post_issue_history",
    "safe_history_until_reference",
)
PURCHASE_GROUPS = ("rfm", "basket", "points")
PRODUCT_GROUPS = ("product_category", "diversity")

_BEHAVIOUR = ("demographic", "rfm", "basket", "points")
_SEMANTIC = (*_BEHAVIOUR, "age_buckets", "account_lifecycle", "redeem_behavior")
#: Settings of each family that differ from ``Recipe``'s own.
RECIPE_FAMILIES = {
    "base": {"source_tables": ("clients",)},
    "rfm": {"feature_groups": ("demographic", "rfm")},
    "engagement": {"feature_groups": ("demographic", "points"), "windows_days": (30,)},
    "windowed": {"feature_groups": _BEHAVIOUR, "windows_days": (30,)},
    "rfm_baseline": {"feature_groups": _BEHAVIOUR, "windows_days": (30, 60, 90), "semantic_name": "rfm_baseline"},
    "human_semantic_v1": {
        "feature_groups": _SEMANTIC, "windows_days": (30, 60, 90), "temporal_policy": "post_issue_history",
        "semantic_name": "human_semantic_v1", "builder_version": "v2",
    },
    "hybrid_safe_semantic_v1": {
        "feature_groups": _SEMANTIC, "windows_days": (30, 60, 90), "temporal_policy": "safe_history_until_reference",
        "semantic_name": "hybrid_safe_semantic_v1", "builder_version": "v2",
    },
    "product_category": {
        "source_tables": ("clients", "purchases", "products"), "feature_groups": (*_BEHAVIOUR, "product_category"), "windows_days": (30,),
    },
    "diversity": {
        "source_tables": ("clients", "purchases", "products"), "feature_groups": (*_BEHAVIOUR, "product_category", "diversity"),
        "windows_days": (30,),
    },
}


def stable_hash(payload, length: int = 12) -> str:
    """First hex digits of the SHA-256 of a payload's sorted, compact JSON."""
    text = json.dumps(payload, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode("utf-8")).hexdigest()[:length]


def _canonical(values):
    return tuple(sorted(set(values)))


@dataclass(frozen=True)
class Columns:
    """Names of the semantic columns; the four must differ."""

    entity: str = "client_id"
    treatment: str = "treatment_flg"
    target: str = "target"
    score: str = "uplift"

    def __post_init__(self):
        names = (self.entity, self.treatment, self.target, self.score)
        if len(set(names)) != len(names):
            raise ValueError(f"semantic columns must be distinct: {names}")

    @property
    def labels(self):
        return (self.target, self.treatment)


@dataclass(frozen=True)
class SplitPolicy:
    """Shares of the labelled rows given to train, validation and test."""

    train: float = 0.7
    validation: float = 0.15
    test: float = 0.15
    seed: int = 42
    min_rows_per_partition: int = 2

    def __post_init__(self):
        shares = (self.train, self.validation, self.test)
        if abs(sum(shares) - 1.0) > 1e-9:
            raise ValueError("split shares must sum to 1")
        if min(shares) < 0:
            raise ValueError("split shares must not be negative")
        if self.min_rows_per_partition < 1:
            raise ValueError("min_rows_per_partition must be at least 1")

    @property
    def min_stratum_rows(self) -> int:
        wanted = sum(share > 0 for share in (self.train, self.validation, self.test))
        return self.min_rows_per_partition * wanted


@dataclass(frozen=True)
class EvalPolicy:
    """Targeting cutoffs and cost scenarios used to judge a ranking."""

    cutoffs: tuple = (0.05, 0.10, 0.20, 0.30)
    conversion_value: float = 1.0
    cost_scenarios: dict = field(
        default_factory=lambda: {"zero_cost": 0.0, "low_cost": 0.05, "medium_cost": 0.20}
    )

    def __post_init__(self):
        if not self.cutoffs:
            raise ValueError("at least one cutoff is needed")
        if any(not 0 < cutoff <= 1 for cutoff in self.cutoffs):
            raise ValueError("cutoffs must lie in (0, 1]")


@dataclass(frozen=True)
class Recipe:
    """Which feature blocks to build; list fields are sorted and deduplicated."""

    source_tables: tuple = ("clients", "purchases")
    feature_groups: tuple = ("demographic",)
    windows_days: tuple = ()
    interactions: tuple = ()
    temporal_policy: str = "pre_issue_only"
    semantic_name: str | None = None
    builder_version: str = "v1"
    reference_date: str | None = None

    def __post_init__(self):
        for name in ("source_tables", "feature_groups", "windows_days", "interactions"):
            object.__setattr__(self, name, _canonical(getattr(self, name)))
        if self.temporal_policy not in TEMPORAL_POLICIES:
            raise ValueError(f"unknown temporal policy: {self.temporal_policy}")
        if self.reference_date is not None:
            iso = datetime.fromisoformat(self.reference_date).isoformat()
            object.__setattr__(self, "reference_date", iso)

    def payload(self) -> dict:
        # The keys that enter the recipe's id.
        return {
            "source_tables": list(self.source_tables),
            "feature_groups": list(self.feature_groups),
            "windows_days": list(self.windows_days),
            "interactions": list(self.interactions),
            "temporal_policy": self.temporal_policy,
            "semantic_name": self.semantic_name,
            "builder_version": self.builder_version,
            "reference_date": self.reference_date,
        }

    @property
    def recipe_id(self) -> str:
        return stable_hash(self.payload())

    def artifact_id(self, fingerprint: str) -> str:
        # The keys that enter the artifact's id.
        return stable_hash(
            {
                "feature_recipe_id": self.recipe_id,
                "dataset_fingerprint": fingerprint,
                "builder_version": self.builder_version,
            }
        )

    @property
    def wants_purchases(self) -> bool:
        return bool(set(PURCHASE_GROUPS) & set(self.feature_groups))

    @property
    def wants_products(self) -> bool:
        return bool(set(PRODUCT_GROUPS) & set(self.feature_groups))

    def pinned(self, reference_date: str | None) -> "Recipe":
        return replace(self, reference_date=reference_date)


def recipe_family(name: str, reference_date: str | None = None) -> Recipe:
    return Recipe(**RECIPE_FAMILIES[name], reference_date=reference_date)
