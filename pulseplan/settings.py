"""Fixed values the metrics are defined with; every operator takes them as parameters."""

# --- fixed values: thresholds, dates and horizons of the metric definitions ---
ANALYSIS_DATE = "2026-01-08"
BILLING_THRESHOLD = 16          # active days that make a patient billable
ACTIVE_WEEK_THRESHOLD = 4       # active days per week
ACTIVE_BIWEEK_THRESHOLD = 8     # active days per period
FALL_RISK_THRESHOLD = 70
FALL_RISK_LOOKBACK_DAYS = 7     # closed on both ends: 8 calendar days
FIRST_DATA_WITHIN_DAYS = 7      # closed: offsets 0..7
FIRST_MONTH_DAYS = 30           # half-open: offsets 0..29
CURVE_DAYS = 30                 # closed: offsets 0..30
RETENTION_MAX_DAYS = 30         # thresholds 0..30
RETENTION_MILESTONES = (1, 5, 10, 16, 20, 25, 30)
TOP_DROPOFFS = 5
MIN_BACKGROUND_MINUTES = 10     # active day: minutes >= 10 OR steps >= 300
MIN_STEPS = 300
ROLLING_WINDOWS = (7, 14, 30)
DROPOFF_MIN_DAYS = 3
HISTOGRAM_MAX_DAYS = 32         # bin edges 0..32, the last bin closed
# --- end of fixed values ---

# Partition column of the stored fact table: the first day of the month.
MONTH_PARTITION = "date_month"
