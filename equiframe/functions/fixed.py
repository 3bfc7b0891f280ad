"""Fixed values.

Everything in this module must equal published or agreed values for results to
be right, so it is stated plainly and kept in one place.
"""

# Text that means "missing" in a CSV: the usual dataframe defaults plus "--".
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null", "--",
)

# Name fragments that mark a demographic column, and the name prefix that does.
DEMOGRAPHIC_KEYWORDS = (
    "gender", "sex", "age", "race", "ethnicity", "income", "education",
    "employment", "disability", "language", "region", "religion",
    "orientation", "marital", "children", "family",
)
DEMOGRAPHIC_PREFIX = "demographics."

# One-hot families rebuilt before demographic columns are recommended.
ONEHOT_FAMILIES = (
    "demographic.gender", "demographic.race", "demographic.ethnicity",
    "demographic.age",
)

# One-hot columns charted as demographic whatever else is in the table.
CHARTED_ONEHOT_COLUMNS = (
    "demographic.gender_female", "demographic.gender_male",
    "demographic.race_white", "demographic.race_black or african american",
    "demographic.race_asian",
    "demographic.race_american indian or alaska native",
    "demographic.race_not reported",
    "demographic.ethnicity_hispanic or latino",
    "demographic.ethnicity_not reported",
)

# Bins, as edges and labels.
AGE_EDGES = (0, 13, 18, 30, 45, 60, 75, 121)
AGE_LABELS = ("child", "teen", "young adult", "adult", "mid-age", "senior", "elder")
CHART_AGE_EDGES = (0, 25, 50, 75, float("inf"))
CHART_AGE_LABELS = ("<25", "25-49", "50-75", ">75")
NUMERIC_EDGES = (0, 20, 40, 60, 80, 100, 120)
NUMERIC_LABELS = ("0-20", "21-40", "41-60", "61-80", "81-100", "100+")
VALID_AGE = (0, 120)

# Words in a column name that suggest a prediction target, and words that rule one out.
TARGET_KEYWORDS = ("status", "diagnosis", "outcome", "recurrence", "death")
NOT_TARGET_KEYWORDS = ("id", "case", "patient", "subject")

# Step names of a preprocessing plan.
DROP_COLUMN = "DropColumn"
ONE_HOT = "OneHotEncoder"
LABEL = "LabelEncoder"
HIGH_CARDINALITY = "⚠️ HighCardinality"
LOG1P = "Log1pTransform"
POWER = "PowerTransform"
MIN_MAX = "MinMaxScaler"
UNKNOWN_TYPE = "UnknownType"
DROP_HIGH_NANS = "DropHighNaNs"
IMPUTE = "ImputeMissing"
CONSIDER_DROPPING = "⚠️ ConsiderDropping"
HIGH_MISSING = "⚠️ HighMissingRate"
STEP_SEPARATOR = " + "

# Fill values of the encoders.
MISSING_LABEL = "missing_label"
MISSING_FALLBACK = "missing_fallback"

# Representation audit.
DEFAULT_BENCHMARK = {
    "Black": 0.36, "White": 0.19, "Hispanic": 0.16, "AIAN": 0.16, "Asian": 0.13,
}
MISSING_EXPECTED = 0.0001
FAIR_RATIO = (0.8, 1.25)
KL_FLOOR = 1e-8

# Severity ladders: (upper bound, label); the last label has no upper bound.
SEVERITY = {
    "kl_divergence": (
        (0.05, "✅ Excellent alignment"), (0.15, "🟢 Good alignment"),
        (0.50, "⚠️ Moderate deviation"), (None, "🚨 Severe deviation"),
    ),
    "wasserstein_distance": (
        (0.05, "✅ Excellent alignment"), (0.15, "🟢 Mild deviation"),
        (0.30, "⚠️ Moderate deviation"), (None, "🚨 Severe deviation"),
    ),
    "total_variation": (
        (0.10, "✅ Excellent alignment"), (0.25, "🟢 Mild deviation"),
        (0.40, "⚠️ Moderate deviation"), (None, "🚨 Severe deviation"),
    ),
}
EFFECT_SIZE = (
    (0.2, "Negligible"), (0.5, "Small"), (0.8, "Medium"), (None, "Large"),
)

# Plain-language names of the outcome metrics.
PLAIN_METRIC_NAMES = {
    "accuracy": "Overall Correctness",
    "precision": "Correctness of Positive Predictions",
    "recall": "Coverage of Actual Positives",
    "f1": "Balance between Precision & Recall",
    "selection_rate": "Group Selection Rate",
}

# Headings of the category summary as the interface shows them.
CATEGORY_HEADINGS = {
    "category": "Data Type (e.g., Diagnoses, Tests)",
    "columns": "Total Columns",
    "drop_recommended": "Columns Suggested for Removal (⚠️ Unused or Empty)",
    "avg_missing": "Average Missing Data (%)",
    "onehot_recommended": "Columns Suggested for Grouping (Group by Category)",
    "numeric_transform": "Columns Suggested for Numeric Adjustment (Adjust Numbers)",
}
