"""Analysis options (one frozen value object shared by every stage)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    # --- fixed defaults that decide results (must equal the reference) ---
    max_categories: int = 15          # eligible categorical: 2 <= levels <= this
    top_n: int = 10                   # categories kept per column
    id_unique_ratio: float = 0.9      # id role: distinct / non-null  >  this
    id_min_unique: int = 100          # ... and distinct  >  this
    text_avg_len_threshold: float = 50.0  # text role: mean string length > this

    # --- work caps (ordinal order); None: no cap. REFERENCE_CAPS has the reference's values ---
    max_hist_numeric: int | None = None
    max_bar_categorical: int | None = None
    max_test_numeric: int | None = None
    max_test_categorical: int | None = None
    max_cluster_features: int | None = None
    max_onehot_features: int | None = None
    max_targets: int | None = None
    fallback_targets: int | None = None     # targets when no name is a KPI's; None: every numeric
    max_recommendations: int | None = None

    # --- statistics ---
    alpha: float = 0.05
    min_group_size: int = 5
    normality_rule: str = "jarque_bera"     # any group size; "shapiro": the reference's rule
    shapiro_max_n: int = 2000               # "shapiro" only: larger groups count as normal
    hist_bins: int = 30
    corr_threshold: float = 0.3
    nonlinear_threshold: float = 0.2
    min_model_rows: int = 30

    # --- segmentation ---
    max_k: int = 10
    kmeans_restarts: int = 10
    kmeans_max_iter: int = 300
    seed: int = 42
    k_min: int = 2
    k_max: int = 6


# How many columns, targets and lines the reference looks at, and its normality rule.
REFERENCE_CAPS = Options(max_hist_numeric=12, max_bar_categorical=12, max_test_numeric=8, max_test_categorical=8,
                         max_cluster_features=6, max_onehot_features=20, max_targets=3, fallback_targets=3,
                         max_recommendations=8, normality_rule="shapiro")
