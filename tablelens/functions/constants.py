"""Fixed values.

Every list below must equal the behaviour being reproduced for results to
match (role synonyms, name candidates, patterns, thresholds). They are kept
verbatim, in their natural order, in this one place.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — do not edit: results depend on them.
# ---------------------------------------------------------------------------

# Personal-data patterns (search semantics; a row hits if any one matches).
EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE_PATTERN = r"\+?\d[\d\-\s()]{7,}\d"
CARD_PATTERN = r"\b(?:\d[ -]*?){13,19}\b"

# Text that a CSV reader treats as missing (the common pandas default set).
NA_STRINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Column-name hints that trigger date parsing at ingest (substring match).
DATE_NAME_HINTS = [
    "date", "dt", "datetime", "timestamp", "order_date", "signup_date",
    "created_at", "updated_at",
]

# Name keys that make a column a datetime candidate in column inference.
DATETIME_NAME_KEYS = [
    "date", "datetime", "timestamp", "ts", "time", "created", "updated",
    "order", "game", "visit",
]

# Ordered candidates for the simple id / timestamp / value guess.
ID_CANDIDATES = [
    "customer_id", "player_id", "patient_id", "user_id", "client_id",
    "account_id", "id", "entity_id", "member_id", "subscriber_id",
]
TS_CANDIDATES = [
    "order_date", "game_date", "visit_date", "date", "datetime", "timestamp",
    "created_at", "updated_at", "event_time", "event_ts", "ts",
]
VALUE_CANDIDATES = [
    "order_value", "amount", "price", "total", "revenue", "sales",
    "claim_amount", "points", "score", "value", "qty", "quantity", "net",
    "gross", "charge",
]

# Canonical semantic roles, in order, and the synonyms scored for each.
ROLES = [
    "entity_id", "event_ts", "value", "quantity", "order_id", "product_id",
    "category", "city", "state", "country", "zip", "email", "phone",
]
ROLE_SYNONYMS = {
    "entity_id": [
        "customer", "client", "user", "account", "member", "subscriber",
        "patient", "player", "device", "lead", "contact", "visitor",
        "session", "person", "employee", "partner", "merchant", "seller",
        "buyer", "provider", "id",
    ],
    "event_ts": [
        "order_date", "purchase", "created", "updated", "date", "datetime",
        "timestamp", "event_time", "event_ts", "time", "game_date",
        "visit_date", "invoice_date", "billing_date", "occurred", "happened",
    ],
    "value": [
        "order_value", "amount", "price", "total", "revenue", "sales", "value",
        "payment_value", "gmv", "net", "gross", "charge", "cost", "premium",
        "fees",
    ],
    "quantity": ["qty", "quantity", "units", "items", "count"],
    "order_id": [
        "order_id", "transaction_id", "invoice_id", "sale_id", "ticket_id",
        "claim_id", "orderid", "txn_id",
    ],
    "product_id": ["product_id", "sku", "item_id", "product", "productcode"],
    "category": [
        "category", "segment", "type", "class", "channel", "payment", "brand",
        "dept", "department",
    ],
    "city": ["city", "town"],
    "state": ["state", "province", "region"],
    "country": ["country", "nation"],
    "zip": ["zip", "zipcode", "postal", "postcode"],
    "email": ["email", "e-mail"],
    "phone": ["phone", "msisdn", "mobile", "tel"],
}

# Roles picked automatically before analysis (top candidate of each).
AUTO_MAP_ROLES = ["entity_id", "event_ts", "value", "quantity", "category"]

# Name fragments that make a column look like an identifier.
ID_NAME_KEYS = ["id", "uuid", "guid", "ssn"]
ID_NAME_KEYS_ML = ["id", "uuid", "guid", "ssn", "iban", "account", "pan"]

# Regression target names, in preference order.
TARGET_CANDIDATES = [
    "value", "amount", "revenue", "sales", "price", "total", "gmv",
    "net_sales", "amt", "subtotal", "grand_total",
]

# Preferred default columns for charts.
CATEGORY_PREFERENCE = ["category", "payment_method", "state", "city"]
TIMESTAMP_PREFERENCE = ["event_ts", "order_date", "timestamp", "created_at", "date"]

# Dimensions examined for recent top drivers, and the id guess of the flow gate.
DRIVER_DIMENSIONS = ["category", "payment_method", "state", "city"]
FLOW_ID_NAMES = ["customer_id", "user_id", "account_id", "id", "entity_id"]

# Thresholds.
GATE_MAX_MISSING = 0.20
GATE_MAX_DUP_EXACT = 0.05
GATE_MAX_DUP_PAIR = 0.02
OUTLIER_Z = 4.0            # |z| > 4, population standard deviation
ANOMALY_Z = 2.0            # |z| >= 2, sample standard deviation
ANOMALY_MIN_WEEKS = 12
CHANGE_MIN_WEEKS = 8
CHANGE_WINDOW_WEEKS = 4
DRIVER_TOP_N = 10
DRIVER_WINDOW_DAYS = 28
WINSOR_UPPER_Q = 0.99
WINSOR_LOWER_Q = 0.0
FILL_TEXT = "UNKNOWN"
RARE_CATEGORY_SHARE = 0.01
HEAVY_MISSING_PCT = 20.0
# ---------------------------------------------------------------------------
