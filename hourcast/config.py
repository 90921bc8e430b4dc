"""Domain constants of the hours-estimation workload.

FIXED VALUES: the names, orders and mappings below must equal the source
application's for results to match; they are stated as plain text, in their
natural order, and are not derived from anything.
"""

from __future__ import annotations

# --- FIXED VALUES (must match the source application) -----------------------

# Actual-hours column per operation, in training order.
TARGETS = [
    "me10_actual_hours",
    "me15_actual_hours",
    "me230_actual_hours",
    "ee20_actual_hours",
    "rb30_actual_hours",
    "cp50_actual_hours",
    "bld100_actual_hours",
    "shp150_actual_hours",
    "inst160_actual_hours",
    "trv180_actual_hours",
    "doc190_actual_hours",
    "pm200_actual_hours",
]

# Sales buckets in display order.
SALES_BUCKETS = ["ME", "EE", "PM", "Docs", "Build", "Robot", "Controls", "Install", "Travel"]

# Operation -> sales bucket.
SALES_BUCKET_MAP = {
    "me10": "ME",
    "me15": "ME",
    "me230": "ME",
    "ee20": "EE",
    "rb30": "Robot",
    "cp50": "Controls",
    "bld100": "Build",
    "shp150": "Build",
    "inst160": "Install",
    "trv180": "Travel",
    "doc190": "Docs",
    "pm200": "PM",
}

# Numeric features known at quote time.
QUOTE_NUM_FEATURES = [
    "stations_count",
    "robot_count",
    "fixture_sets",
    "part_types",
    "servo_axes",
    "pneumatic_devices",
    "safety_doors",
    "weldment_perimeter_ft",
    "fence_length_ft",
    "conveyor_length_ft",
    "product_familiarity_score",
    "product_rigidity",
    "is_product_deformable",
    "is_bulk_product",
    "bulk_rigidity_score",
    "has_tricky_packaging",
    "process_uncertainty_score",
    "changeover_time_min",
    "safety_devices_count",
    "custom_pct",
    "duplicate",
    "has_controls",
    "has_robotics",
    "Retrofit",
    "complexity_score_1_5",
    "vision_systems_count",
    "panel_count",
    "drive_count",
    "stations_robot_index",
    "mech_complexity_index",
    "controls_complexity_index",
    "physical_scale_index",
    "log_quoted_materials_cost",
]

# Categorical features known at quote time.
QUOTE_CAT_FEATURES = [
    "industry_segment",
    "system_category",
    "automation_level",
    "plc_family",
    "hmi_family",
    "vision_type",
]

# Columns a training upload must carry.
REQUIRED_TRAINING_COLS = [
    "project_id",
    "include_in_training",
    "dataset_role",
    "industry_segment",
    "system_category",
    "stations_count",
    "robot_count",
    "me10_actual_hours",
]

# Flag columns stored as yes/no/true/false/1/0 text, turned into 0/1 ints.
BOOL_COLS = [
    "has_controls",
    "has_robotics",
    "duplicate",
    "Retrofit",
    "is_product_deformable",
    "is_bulk_product",
    "has_tricky_packaging",
]

# Text accepted as "true" by the flag parser (everything else is 0).
TRUE_TOKENS = ["yes", "true", "1"]
# Values of include_in_training that keep a row.
INCLUDE_TOKENS = ["yes", "1", "true"]
# The dataset_role that marks finished projects.
ACTUALS_ROLE = "actuals"

# Composite indices: name -> (terms, divisor per term).
INDEX_TERMS = {
    "stations_robot_index": [("stations_count", 1.0), ("robot_count", 1.0), ("servo_axes", 1.0)],
    "mech_complexity_index": [
        ("fixture_sets", 1.0),
        ("pneumatic_devices", 1.0),
        ("safety_devices_count", 1.0),
    ],
    "controls_complexity_index": [
        ("servo_axes", 1.0),
        ("vision_systems_count", 1.0),
        ("i_o_points_est", 75.0),
    ],
    "physical_scale_index": [("conveyor_length_ft", 1.0), ("fence_length_ft", 1.0)],
}

# Quote-record defaults for numeric fields (all others default to 0).
QUOTE_DEFAULTS = {"has_controls": 1.0, "has_robotics": 1.0, "complexity_score_1_5": 3.0}

# Confidence thresholds on the relative P10-P90 width (strict "<").
CONF_HIGH_BELOW = 0.3
CONF_MEDIUM_BELOW = 0.6
REL_WIDTH_EPS = 1e-6

# Quoted-vs-model tolerance: max(share * |p50|, floor).
BUCKET_CLOSE_SHARE, BUCKET_CLOSE_FLOOR = 0.1, 5.0
TOTAL_CLOSE_SHARE, TOTAL_CLOSE_FLOOR = 0.1, 10.0

# Training defaults of the source application.
TEST_SIZE = 0.25
SPLIT_SEED = 42
MIN_TRAIN_ROWS = 5
FOREST_TREES = 400
FOREST_SEED = 42
MODEL_VERSION = "v1"
TOP_DRIVERS = 15

# --- END FIXED VALUES --------------------------------------------------------

HOURS_SUFFIX = "_actual_hours"
OPERATIONS = [t[: -len(HOURS_SUFFIX)] for t in TARGETS]
ALL_FEATURES = QUOTE_NUM_FEATURES + QUOTE_CAT_FEATURES
INDEX_COLS = list(INDEX_TERMS)
INDEX_INPUTS = sorted({c for terms in INDEX_TERMS.values() for c, _ in terms})
# Numeric features that are plain measurements (not flags, indices or the log cost).
PLAIN_NUM_FEATURES = [
    c
    for c in QUOTE_NUM_FEATURES
    if c not in BOOL_COLS and c not in INDEX_COLS and c != "log_quoted_materials_cost"
]


def operation_of(target: str) -> str:
    """``me10_actual_hours`` -> ``me10``."""
    return target[: -len(HOURS_SUFFIX)] if target.endswith(HOURS_SUFFIX) else target
