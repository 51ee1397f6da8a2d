"""Code lists, names, limits and formats the results depend on."""

# Results are right only with exactly these.

# Category name -> code.
CATEGORY_CODES = {
    "other": 0,
    "customer service": 1,
    "counseling": 2,
    "mobile/web bank": 3,
    "fees and interest rates": 4,
}

# Category code -> name.
CATEGORY_NAMES = {
    -1: "other",
    0: "other",
    1: "customer service",
    2: "counseling",
    3: "mobile/web bank",
    4: "fees and interest rates",
}

# Danish report labels and the category code each one stands for, in report order.
REPORT_LABELS = [
    ("Andet", 0),
    ("Kundeservice", 1),
    ("Rådgivning", 2),
    ("mobil/net bank", 3),
    ("Gebyrer/renter", 4),
]

# Category code -> Danish label.
CATEGORY_LABELS = {
    -1: "",
    0: "Andet",
    1: "Kundeservice",
    2: "Rådgivning",
    3: "mobil/net bank",
    4: "Gebyrer/renter",
}

STARS = (1, 2, 3, 4, 5)

# Names under which a request asks for a report.
REPORT_RATING_SHARE = "ratings piechart for single company"
REPORT_CATEGORY_STARS = "ratings piecharts by review category for single company"
REPORT_RATING_SERIES = "ratings time series for single company"
REPORT_COMPARE_SERIES = "ratings and review count time series comparing companies"
REPORT_COMPANY_STARS = "ratings distribution comparing companies"

# Actions a request plan may contain.
ACTION_SQL = "SQL"
ACTION_PLOT = "PLOT"
ACTION_ANALYSE = "ANALYSE REVIEWS"

# A span below DAY_SPAN_DAYS is shown by day, below WEEK_SPAN_DAYS by week, else by month.
DAY_SPAN_DAYS = 45
WEEK_SPAN_DAYS = 150

# Sizes.
PAYLOAD_TOKENS = 5000
TOKEN_SAMPLE_ROWS = 300
RETRIEVED_REVIEWS = 150
PREVIEW_ROWS = 20
PAGE_SIZE = 100
VECTOR_DIM = 768
REVIEW_PAGES = 39

# Message of every failing ad-hoc query.
INVALID_SQL = "Invalid SQL query"

# Markers in scraped pages.
JSON_SCRIPT_TYPE = "application/json"
NEXT_PAGE_ELEMENT = "pagination-button-next"

# Text of report labels: company axis (name, mean, count) and bar (percent, count).
AXIS_LABEL = "%s <br> ☆%s <br> #%d"
BAR_LABEL = "%% %s<br># %d"
