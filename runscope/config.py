"""Constants of the estimation operators. They enter plans as literals."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class EstimationConfig:
    # fixed values: weights of the confidence parts
    weight_sample: float = 0.4
    weight_recency: float = 0.3
    weight_consistency: float = 0.2
    weight_coverage: float = 0.1
    max_confidence: float = 0.9
    # fixed values: variance multipliers where there is no observed variance
    multipliers: dict = field(default_factory=lambda: {"single_sample": 0.3, "exact_thread": 0.2, "pooled_thread": 0.3, "size_scaled": 0.25, "combination": 0.2, "relaxed_combination": 0.5, "fuzzy": 0.4, "global": 0.5})
    half_life_logs: float = 10.0
    half_life_days: float = 7.0
    min_samples: int = 3
    min_pairs_for_size: int = 3
    size_clamp_low: float = 0.5
    size_clamp_high: float = 2.0
    size_confidence: float = 0.3
    predictive_threshold: float = 0.05
    recent_days: float = 7.0
    consistency_floor: float = 0.3
    default_mean: float = 60.0
    max_rule_distance: int = 3
    bootstrap_low: float = 0.2
    bootstrap_high: float = 3.0
    bootstrap_confidence: float = 0.05
    simple_max_confidence: float = 0.7
    simple_confidence_jobs: float = 20.0
    simple_min_uncertainty: float = 0.3
    sigmas: float = 2.0
    stale_seconds: float = 1800.0


DEFAULT = EstimationConfig()
