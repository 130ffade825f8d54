"""Default parameters. Functions take them as arguments."""

# Feature and model defaults that results depend on.
LAG_PERIODS = (1, 24, 168)
ROLLING_WINDOWS = (24, 72, 168)
DIFFERENCE_PERIODS = (1, 24)
INTERACTION_PAIRS = (
    ("hour_of_day", "is_weekend"),
    ("is_business_hours", "day_of_week"),
    ("lag_1", "hour_of_day"),
)
MODEL_CALENDAR_FEATURES = (
    "hour_of_day",
    "day_of_week",
    "is_weekend",
    "is_business_hours",
    "is_morning_peak",
    "is_evening_peak",
    "hour_sin",
    "hour_cos",
    "day_sin",
    "day_cos",
)
BASELINE_FEATURES = (
    "hour_of_day",
    "day_of_week",
    "is_weekend",
    "hour_sin",
    "hour_cos",
    "lag_1",
    "lag_24",
    "rmean_24",
)
TEST_SIZE = 0.2
VALIDATION_SIZE = 0.1
MAX_DEPTH = 6
LEARNING_RATE = 0.1
N_ESTIMATORS = 300
BASELINE_ESTIMATORS = 250
RANDOM_STATE = 42
EARLY_STOPPING_ROUNDS = 50
CV_SPLITS = 5
TUNING_SPLITS = 3
TUNING_GRID = {
    "max_depth": (4, 6, 8),
    "learning_rate": (0.05, 0.1),
    "n_estimators": (200, 300),
}
SIGNIFICANCE_LEVEL = 0.05
MIN_DRIFT_SAMPLE = 30
DEGRADATION_THRESHOLD = 0.1
SUMMARY_DAYS = 30
HISTOGRAM_BINS = 30
PEAK_HOURS = 5
TAIL_ROWS = 168
COMPARED_SITES = 3
INTERVAL_MARGIN = 0.1
