"""Fixed values of the domain: results are only right when these are exactly as given."""

# --- fixed values: calendar ---------------------------------------------------------------
FIRST_WET_MONTHS = (3, 4, 5)
SECOND_WET_MONTHS = (9, 10, 11)
DRY_MONTHS = (1, 2, 6, 7, 8, 12)
MONTHS_PER_CYCLE = 12.0
DAYS_PER_CYCLE = 365.25

# --- fixed values: age bands (right-closed, first edge open) -------------------------------
AGE_EDGES = (-1, 0, 1, 3, 5, 12, 18, 40, 65, 120)
AGE_BAND_EDGES = (-1, 1, 5, 12, 18, 50, 70, 120)
AGE_BAND_LABELS = ("<1", "1-5", "5-12", "12-18", "18-50", "50-70", "70+")

# --- fixed values: place and terrain -------------------------------------------------------
CENTRE_LATITUDE = 0.45
CENTRE_LONGITUDE = 32.5
HIGHLAND_ABOVE = 1300
LOWLAND_BELOW = 1100
CLUSTERS = 6
CLUSTER_RESTARTS = 10
DIVISION_GUARD = 1e-5

# --- fixed values: weather -----------------------------------------------------------------
HEAVY_RAIN_ABOVE = 10.0
HOT_DAY_ABOVE = 30.0
WET_DAY_ABOVE_MM = 1.0
EXTREME_HEAT_ABOVE = 35.0
TRAILING_DAYS = (7, 30, 90)

# --- fixed values: validation --------------------------------------------------------------
FOLDS = 5
SEED = 42
CALIBRATION_SEED = 123
SMOOTHING = 10
F1_WEIGHT = 0.60
AUC_WEIGHT = 0.40
LABEL_THRESHOLD = 0.5
PROBABILITY_CLIP = 1e-6
ENCODED_COLUMNS = ("age_group", "month", "year", "quarter", "spatial_cluster")
SEED_BAG = (42, 100, 2026, 777, 999)
TUNING_SEEDS = (42, 7)

# --- fixed values: pseudo-label thresholds -------------------------------------------------
PSEUDO_THRESHOLD = 0.05
PSEUDO_STUDY = (0.03, 0.05, 0.10, 0.15)
PSEUDO_BLEND_BAND = (0.12, 0.88)  # strict: below / above
PSEUDO_STACK_BAND = (0.06, 0.94)  # inclusive: at or below / at or above

# --- fixed values: blends (weights in model order) -----------------------------------------
BLEND_CANDIDATES = (
    (0.40, 0.30, 0.30),
    (0.34, 0.33, 0.33),
    (0.30, 0.30, 0.40),
    (0.25, 0.25, 0.50),
    (0.50, 0.25, 0.25),
    (0.25, 0.50, 0.25),
    (0.20, 0.20, 0.60),
    (0.40, 0.20, 0.40),
)
FIXED_BLENDS = {
    "leaf35_level35_ordered30": (0.35, 0.35, 0.30),
    "ordered40_leaf35_level25": (0.40, 0.35, 0.25),
    "ordered50_leaf25_level25": (0.50, 0.25, 0.25),
    "ordered35_leaf35_level20_forest10": (0.35, 0.35, 0.20, 0.10),
    "stack50_ordered20_leaf15_level15": (0.50, 0.20, 0.15, 0.15),
}
SIMPLEX_GRID = (0.2, 0.5, 7)  # start, stop, points, per free weight

# --- fixed values: calibration grids (scale start, stop, points, shift start, stop, points) -
CALIBRATION_GRIDS = {
    "nested": (0.5, 2.0, 16, -1.5, 1.5, 31),
    "pseudo": (0.8, 1.8, 21, -0.5, 0.5, 21),
    "stacked": (0.5, 2.5, 41, -2.0, 2.0, 81),
    "fine": (0.6, 2.0, 57, -1.5, 1.5, 121),
    "shift": (1.0, 1.0, 1, -3.0, 3.0, 601),
}
COUNT_SHIFT_GRID = (-0.5, 0.5, 1001)
TARGET_POSITIVES = 712
TARGET_ROWS = 1030

# --- fixed values: tuned settings of the three boosted families ----------------------------
LEAFWISE_TUNED = {
    "n_estimators": 341, "learning_rate": 0.010128940359921752, "num_leaves": 45,
    "max_depth": 3, "min_data_in_leaf": 48, "feature_fraction": 0.5055150782121488,
    "bagging_fraction": 0.63639015076024, "lambda_l1": 0.001374996752144145,
    "lambda_l2": 2.577212543825008, "scale_pos_weight": 1.6217630156300469,
}
LEVELWISE_TUNED = {
    "n_estimators": 281, "learning_rate": 0.013051232685336154, "max_depth": 3,
    "min_child_weight": 9, "subsample": 0.7618942903727399,
    "colsample_bytree": 0.9566487112332043, "reg_alpha": 1.5546826273112857,
    "reg_lambda": 0.21053037325877444, "scale_pos_weight": 1.648167008682644,
}
ORDERED_TUNED = {
    "iterations": 449, "learning_rate": 0.01406941814710441, "depth": 3,
    "l2_leaf_reg": 5.189158692277641, "scale_pos_weight": 1.3382077395509584,
    "bagging_temperature": 0.5235541747075964,
}

# --- fixed values: tuning ranges (low, high, log-uniform?) ---------------------------------
TUNING_RANGES = {
    "leafwise": {"trees": (150, 600, False), "step": (0.01, 0.1, True), "depth": (3, 8, False),
                 "leaf_rows": (5, 60, False), "features": (0.5, 1.0, False),
                 "rows": (0.5, 1.0, False), "positive_weight": (0.7, 3.0, False)},
    "levelwise": {"trees": (150, 600, False), "step": (0.01, 0.1, True), "depth": (3, 8, False),
                  "leaf_rows": (1, 20, False), "features": (0.5, 1.0, False),
                  "rows": (0.5, 1.0, False), "positive_weight": (0.7, 3.0, False)},
    "ordered": {"trees": (150, 600, False), "step": (0.01, 0.12, True), "depth": (3, 8, False),
                "positive_weight": (0.7, 3.0, False)},
}
TUNING_TRIALS = 40
