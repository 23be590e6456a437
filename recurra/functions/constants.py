"""Fixed values that must equal the reference application's for equal results.

Everything in this module is a plain statement of those values, in their
natural order. Nothing here is logic.
"""

# --- fixed values: status spellings and their canonical status -------------
STATUS_MAP = {
    "active": "active",
    "Active": "active",
    "ACTIVE": "active",
    "churned": "churned",
    "Churned": "churned",
    "CHURNED": "churned",
    "canceled": "churned",
    "cancelled": "churned",
    "Canceled": "churned",
    "Cancelled": "churned",
    "past_due": "past_due",
    "Past Due": "past_due",
    "PAST_DUE": "past_due",
    "past due": "past_due",
    "payment_failed": "past_due",
    "Payment Failed": "past_due",
    "PAYMENT_FAILED": "past_due",
    "failed": "past_due",
    "Failed": "past_due",
    "FAILED": "past_due",
    "trial": "trial",
    "Trial": "trial",
    "TRIAL": "trial",
}
VALID_STATUSES = ("active", "churned", "past_due", "trial")

# --- fixed values: canonical fields and their column-name synonyms ----------
# Field order is the greedy assignment order (amount, status, customer_id,
# date, currency).
FIELD_SYNONYMS = {
    "amount": [
        "amount", "price", "mrr", "revenue", "subscription_amount",
        "monthly_amount", "charge", "value", "subscription_value",
        "plan_amount", "billing_amount", "total", "amount_usd", "amount_eur",
    ],
    "status": [
        "status", "subscription_status", "state", "plan_status",
        "billing_status", "sub_status",
    ],
    "customer_id": [
        "customer_id", "customerid", "customer", "client_id", "clientid",
        "user_id", "userid", "subscriber_id", "account_id", "accountid", "id",
        "sub_id", "subscription_id",
    ],
    "date": [
        "date", "period", "month", "billing_date", "subscription_date",
        "created_at", "start_date", "invoice_date", "charge_date",
        "payment_date", "period_start", "billing_period",
    ],
    "currency": [
        "currency", "currency_code", "iso_currency", "billing_currency",
        "currency_iso", "curr", "ccy", "cur",
    ],
}
FIELD_ORDER = ["amount", "status", "customer_id", "date", "currency"]
BLOCKLIST = [
    "created_by", "updated_by", "modified_by", "deleted_by", "created_at_by",
    "last_modified_by",
]
FUZZY_THRESHOLD = 75
REQUIRED_FIELDS = ["amount", "status", "customer_id", "date"]

# --- fixed values: billing-source signatures, in detection priority order ---
PRESET_SIGNATURES = [
    ("stripe", {"customer_id": "customer_id", "date": "created", "amount": "amount", "status": "status"}),
    ("paddle", {"customer_id": "customer_id", "date": "created_at", "amount": "amount", "status": "status"}),
    ("gumroad", {"customer_id": "email", "date": "created_at", "amount": "price", "status": "cancelled"}),
    ("lemonsqueezy", {"customer_id": "customer_email", "date": "created_at", "amount": "total", "status": "status"}),
    ("chargebee", {"customer_id": "customer_id", "date": "started_at", "amount": "amount", "status": "status"}),
    ("manual", {"customer_id": "customer_id", "date": "date", "amount": "amount", "status": "status"}),
]

# --- fixed values: pandas' default missing-value strings (read_csv) --------
PANDAS_NA_STRINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# --- fixed values: metric thresholds and horizons ---------------------------
MIN_PAYING_FOR_QUALIFIED_MONTH = 5
REACTIVATION_MIN_ABSENT = 2
REACTIVATION_MAX_ABSENT = 9
ANNUAL_PLAN_ARPU_MULTIPLE = 6
NRR_MIN, NRR_MAX, NRR_WARNING = 0.0, 999.0, 200.0
LTV_CAP_MONTHS = 36
COHORT_MIN_COUNT = 3
COHORT_MAX_SHOWN = 12
COHORT_PDF_SHOWN = 8
FORECAST_MIN_MONTHS = 3
FORECAST_FULL_MONTHS = 6
FORECAST_HORIZON = 12
FORECAST_CHURN_FALLBACK = 0.05
SEASONAL_PERIODS_MAX = 12
SCENARIO_FACTORS = [("pessimistic", 1.20), ("realistic", 1.00), ("optimistic", 0.80)]
SIMULATION_CHURN_FALLBACK_PCT = 5.0
SIMULATION_MONTHS = 12
SIMULATION_RANGES = {
    "churn_reduction": (0.0, 1.0),
    "new_customers_month": (0, 10000),
    "price_increase": (-0.5, 5.0),
}

# --- fixed values: upload guards and plan limits ----------------------------
MAX_FILE_BYTES = 15 * 1024 * 1024
PLAN_ROW_CAPS = {"free": 1000, "starter": 10000, "pro": 50000}
PLAN_RANK = {"free": 0, "starter": 1, "pro": 2}
VALID_PLANS = ["free", "starter", "pro"]

# --- fixed values: session rules --------------------------------------------
SESSION_MAX_AGE_SECONDS = 8 * 3600
SESSION_IDLE_SECONDS = 30 * 60

# --- fixed values: snapshot columns -----------------------------------------
SNAPSHOT_METRIC_KEYS = [
    "mrr", "arr", "arpu", "churn_rate", "nrr", "ltv", "active_subscribers",
    "total_revenue",
]
PERIOD_PATTERN = r"^\d{4}-\d{2}$"

# --- fixed values: privacy patterns, applied in this order ------------------
PII_PATTERNS = [
    (r"[a-zA-Z0-9_.+\-]+@[a-zA-Z0-9\-]+\.[a-zA-Z0-9.\-]+", "[EMAIL REDACTED]"),
    (r"Bearer\s+[A-Za-z0-9\-_\.]+", "Bearer [TOKEN REDACTED]"),
    (r'"(?:access_token|refresh_token|token)"\s*:\s*"[^"]+"', '"token": "[REDACTED]"'),
    (r"(?<![A-Za-z0-9])[A-Za-z0-9_\-]{20,}(?![A-Za-z0-9])", "[KEY REDACTED]"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[IP REDACTED]"),
]
