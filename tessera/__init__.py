"""Multi-arm matching and weighting for observational cohorts, on Spark."""

from .functions.scalars import expit, logit
from .operators.balance import auc_mannwhitney, compute_pairwise_treatment_auc, compute_smd_balance, sam_evaluate
from .operators.effects import extract_matched_data, sam_estimate_effects
from .operators.greedy import sam_match
from .operators.linalg import build_group_distance_matrices, get_pooled_covariance, mahalanobis_distance_matrix
from .operators.propensity import estimate_gps_multinom
from .operators.screen import gps_candidate_search
from .operators.threeway import calc_caliper_3way, match_3way
from .operators.weighting import compute_balancing_weights, compute_effective_sample_size, compute_weighted_balance, evaluate_comparator_weighting
from .sources.cohorts import load_sample_3group, load_sample_4group

__version__ = "0.2.0"

__all__ = [
    "__version__", "estimate_gps_multinom", "gps_candidate_search", "sam_match", "sam_evaluate", "extract_matched_data", "sam_estimate_effects",
    "compute_smd_balance", "compute_pairwise_treatment_auc", "get_pooled_covariance", "mahalanobis_distance_matrix", "build_group_distance_matrices",
    "calc_caliper_3way", "match_3way", "compute_balancing_weights", "compute_weighted_balance", "compute_effective_sample_size", "evaluate_comparator_weighting",
    "expit", "logit", "auc_mannwhitney", "load_sample_3group", "load_sample_4group",
]
