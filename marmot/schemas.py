"""Schemas of the data model and the fixed vocabularies the results depend on."""

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for identical results)
# ---------------------------------------------------------------------------
# Action weights of the live action log (case-sensitive; unknown -> 1.0).
LOG_ACTION_WEIGHTS = {"VIEW": 1.0, "CLICK": 2.0, "ADD_CART": 3.0, "PURCHASE": 5.0}
# Action weights of the generated event table; every action listed is positive.
GENERATOR_ACTION_WEIGHTS = {"view": 1.0, "like": 2.0, "enter": 3.0, "purchase": 5.0}
# Category code -> name (backend codes 1..6).
CATEGORY_NAMES = {1: "식품", 2: "생활/주방", 3: "뷰티/미용", 4: "패션", 5: "건강/운동", 6: "유아"}
CATEGORY_MIN, CATEGORY_MAX = 1, 6
DEFAULT_WEIGHT = 1.0
PURCHASE_WEIGHT = 5.0
# Composite popularity: 0.7 * weight share + 0.3 * user share.
POPULARITY_WEIGHTS = (0.7, 0.3)
# Hybrid blend: 0.6 * ranker + 0.4 * (mf / 10 when mf > 0).
BLEND_RANKER, BLEND_MF, BLEND_MF_SCALE = 0.6, 0.4, 10.0
# Temporal split quantiles and the minimum number of train rows per user.
TRAIN_QUANTILE, VAL_QUANTILE, MIN_TRAIN_ROWS = 0.70, 0.85, 3
# Random split ratios.
SPLIT_RATIOS = (0.7, 0.15, 0.15)
# Serving: candidate depth, result depth for paging, default page size.
CANDIDATE_K, SERVE_DEPTH, DEFAULT_TOP_N = 250, 100, 50
# Evaluation cut-offs.
EVAL_KS = (5, 10, 20)

# ---------------------------------------------------------------------------
# Adapter vocabulary for the given test tables (events.event_type, part.p_type)
# ---------------------------------------------------------------------------
EVENTS_ACTION_WEIGHTS = {"view": 1.0, "click": 2.0, "purchase": 5.0}
PART_TYPE_CATEGORY = {"ECONOMY": 1, "LARGE": 2, "MEDIUM": 3, "PROMO": 4, "SMALL": 5, "STANDARD": 6}

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------
# D1 raw action log (one JSON array of these per file).
LOG_SCHEMA = T.StructType([
    T.StructField("timestamp", T.LongType()),
    T.StructField("item_id", T.LongType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("category_id", T.IntegerType()),
    T.StructField("price", T.DoubleType()),
])
LOG_COLUMNS = [f.name for f in LOG_SCHEMA.fields]

# D4 interaction / training row.
INTERACTION_SCHEMA = T.StructType([
    T.StructField("user_idx", T.StringType()),
    T.StructField("item_idx", T.LongType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("weight", T.DoubleType()),
    T.StructField("price_norm", T.DoubleType()),
    T.StructField("category_idx", T.IntegerType()),
])
TRAINING_COLUMNS = [f.name for f in INTERACTION_SCHEMA.fields]

# D10 request table.
REQUEST_SCHEMA = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("top_n", T.IntegerType()),
    T.StructField("category_id", T.IntegerType()),
    T.StructField("available_items", T.ArrayType(T.LongType())),
    T.StructField("rank", T.IntegerType()),
])

# D13 processed-file ledger.
LEDGER_SCHEMA = T.StructType([
    T.StructField("file_path", T.StringType()),
    T.StructField("state", T.StringType()),  # done, empty or failed: the outcome of one attempt
    T.StructField("processed_at", T.TimestampType()),
])
