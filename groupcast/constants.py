"""Fixed values and defaults.

The values in the first block must equal the original pipeline's for results
to match; they are stated here as plain data, in their original order.
"""

# --- fixed values (must match the original pipeline) -----------------------
CANDIDATE_FEATURES = [
    "dayofweek",
    "month",
    "is_weekend",
    "is_holiday",
    "lag_7",
    "lag_14",
    "lag_28",
    "rolling_mean_7",
    "rolling_std_7",
    "rolling_mean_28",
    "rolling_std_28",
    "price_change_rate",
    "sell_price",
    "week_of_year",
    "is_month_start",
    "is_month_end",
]
SEQ_LEN = 14
TRAIN_RATIO = 0.70
VAL_RATIO = 0.15
FEATURE_TOP_K = 12
FEATURE_ALPHA = 0.10
CLIP_NORM = 0.15
PIPELINE_EPSILON = 30.0
DEFAULT_EPSILON = 10.0
EMA_ALPHA = 0.8
COMPLEXITY_PENALTY = 0.03
SINGLETON_PENALTY = 0.15
ISOLATION_STD_MULTIPLIER = 0.75
MAX_CLUSTERS_PIPELINE = 15
HUBER_DELTA = 1.0
SMAPE_WEIGHT = 0.1
EPS = 1e-8
LEARNING_RATE = 0.001
NUM_ROUNDS = 100
EPOCHS_PER_ROUND = 3
GLOBAL_WARMUP_ROUNDS = 20
HEAD_FINETUNE_EPOCHS = 20
RECLUSTER_INTERVAL = 20
SEED = 42
HISTORY_SCHEMA_VERSION = 3

# --- our own definitions (the original only consumes these columns) -------
# Fixed-date holidays, month-day.
HOLIDAYS_MM_DD = ["01-01", "02-14", "07-04", "10-31", "11-11", "12-24", "12-25", "12-31"]

# Parameter layer names of the linear forecaster: shared body, personal head.
BODY_PREFIX = "body."
HEAD_PREFIX = "head."
