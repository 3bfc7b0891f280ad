"""Bias audits of tables and classifiers, as Spark jobs."""

from equiframe.functions.scale import release
from equiframe.operators.charts import (
    box_stats, demographic_counts, density, distributions, group_profile, group_proportions, groupwise,
    histogram, overview,
)
from equiframe.operators.demographics import (
    bin_age, bin_column, demographic_columns, filter_valid_age, merge_onehot, onehot_prefixes,
    onehot_totals, process_age_columns, recommend_demographic, restore_group, top_groups,
)
from equiframe.operators.model import (
    classification_report, confusion_matrix, permutation_importance, roc_auc, roc_curve, train_baseline,
)
from equiframe.operators.outcome import disparities, output_fairness, parity_odds
from equiframe.operators.prepare import (
    apply_plan, dedupe, impute, label_encode, log1p_transform, min_max_scale, one_hot, recommend,
    summarize_categories,
)
from equiframe.operators.profile import (
    column_rules, contingency, groupwise_missing, low_variance, missing_top, profile, table_summary,
    target_candidates, value_counts,
)
from equiframe.operators.representation import (
    distribution_distance, fairness_summary, input_fairness, observed_vs_expected, severity_labels,
    top_disparity,
)
from equiframe.operators.significance import anova, chi_square, ks_pairs, standardized_difference
from equiframe.plans.audit import (
    audit_report, fairness_audit, interactive_audit, model_fairness, report_findings, write_report,
)
from equiframe.sources.benchmark import benchmark_from_json, default_benchmark, observed_benchmark
from equiframe.sources.csv import read_csv, write_csv

__all__ = [name for name in dir() if not name.startswith("_")]
