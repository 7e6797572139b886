"""Labels, thresholds and enumerations results depend on."""

# sources and channel
UCI, SYNTHETIC, ONLINE = "UCI", "SYNTHETIC", "ONLINE"

# transaction types and description sentinel
SALE, RETURN, CANCELLATION, INVALID = "SALE", "RETURN", "CANCELLATION", "INVALID"
UNKNOWN_PRODUCT = "Unknown Product"

# customer segments accepted in the master
SEGMENTS = ("Consumer", "Corporate", "Small Business", "VIP Loyalty")

# daily and weekly feature settings
DAILY_LAGS = (1, 2, 3, 7, 14, 21, 28, 30)
DAILY_WINDOWS = (7, 14, 30)
WEEKLY_LAGS = (1, 2, 4, 7, 13, 26, 52)
WEEKLY_WINDOWS = (4, 8, 13, 26)
WEEKLY_SPANS = (4, 13, 26)
HORIZONS = (1, 3, 7, 14, 30)

# backtest layout (weeks)
BACKTEST_FOLDS, BACKTEST_HORIZON, MIN_HISTORY_WEEKS, MIN_TRAIN_ROWS, SEASON_WEEKS = 5, 8, 52, 13, 52

# intermittent demand
ALPHA, BETA, MIN_ZERO_SHARE = 0.1, 0.1, 0.05

# risk settings
LOOKBACK_DAYS, COVERAGE_DAYS, HOLDING_RATE, REVIEW_DAYS = 30, 45, 0.25, 14
DAILY_FLOOR, MISSING_DEMAND, WEEKLY_FLOOR = 0.05, 0.1, 0.01
SUPPORTED_HORIZON_WEEKS, RISK_HORIZON_WEEKS = 6, 8

# monitoring thresholds
MONITORING = {
    "unseen_category_rate_warn": 5.0,
    "synthetic_zero_pred_rate_min": 50.0,
    "synthetic_zero_pred_rate_max": 75.0,
    "synthetic_zero_fp_warn": 10.0,
    "uci_h1_wape_fold2": 105.0,
    "uci_h1_wape_1p5x": 119.2,
    "synthetic_h1_wape_1p5x": 39.4,
    "psi_warn": 0.20,
}
PSI_STABLE, PSI_WATCH, PSI_DRIFT = 0.10, 0.20, 0.25
WAPE_BASELINE = 13.96

# growth and inventory cells
GROWTH_MIN_OBS, GROWTH_STABLE, UNCERTAINTY_WIDTH, RANK_LABEL_SIZE = 10, 0.05, 0.50, 10

# keys hidden in audit records
REDACTED_KEYS = (
    "api_key", "apikey", "authorization", "password", "secret", "token",
    "x-api-key", "features", "records", "payload",
)

# Reviews by rule, in the order in which rules are tried: priority, review, reason, limit of confidence.
REVIEWS = {
    "stockout": (1, "Review replenishment", "Existing stockout_risk_level is CRITICAL / HIGH.", "1000-row reference extract; not an automatic purchase order."),
    "overstock": (2, "Review inventory exposure", "Existing overstock_risk_level is {}.", "Reference scoring only; no inventory write-back."),
    "reorder": (2, "Review replenishment", "Existing reorder_triggered flag is true.", "Flag is analytical; no PO is sent."),
    "uncertainty": (3, "Review forecast uncertainty", "Relative P10/P90 width meets the documented uncertainty threshold.", "Interval companions are not guaranteed coverage bands."),
    "growth": (3, "Monitor demand growth", "Documented growth rule classified TEST actuals as Growing.", "Held-out TEST split, not live sales velocity."),
    "matrix": (2, "Review replenishment", "Demand-high and inventory-high median split (documented 2x2).", "Median split on the extract, not a new risk model."),
    "none": (4, "No exceptional intervention indicated", "No critical stockout, overstock, reorder, or uncertainty flag on this row.", "Absence of a flag is not proof of operational safety."),
}
