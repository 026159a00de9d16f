"""Thresholds, word lists, patterns and message texts that results must carry."""

# Health thresholds.
STALENESS_SLA_HOURS = 12
ANOMALY_RATIO = 0.3
STUCK_RUN_SECONDS = 1800
MESSAGE_CHARS = 140
# Fixed value: pages of a source whose number of pages is not positive.
PAGES = 10
# Fixed value: lines that are read of a log file seen for the first time.
TAIL_LINES = 300

# Patterns that mark a process log line as an error (case-insensitive).
LOG_ERROR_PATTERNS = [
    r"\[ERROR\]",
    r"\[CRITICAL\]",
    r"OperationalError",
    r"NameError",
    r"KeyError",
    r"AttributeError",
    r"Authentication failed",
    r"no password supplied",
    r"ConnectionRefusedError",
    r"Connection refused",
    r"Cloudflare challenge or 403",
]
LOG_BUNDLE_PATTERN = r"bundle[s]?/([a-zA-Z0-9_]+)"
UNKNOWN_BUNDLE = "unknown_bundle"

# Issue texts, in rule order (printf format).
ISSUE_NO_DATA = "No execution data recorded yet for this bundle."
ISSUE_STDOUT = "Dagster process STDOUT error detected: '%s'"
ISSUE_ANOMALY = (
    "High anomaly rate (%d/%d runs returned 0 items, threshold: %d%%). Target HTML selector changed?"
)
ISSUE_FAILURE = (
    "High failure rate (%d/%d runs FAILED, threshold: %d%%). Check error_message / stdout logs."
)
ISSUE_STALE = "Staleness SLA breached! Last successful run was %s hours ago (SLA: %dh)."
ISSUE_NEVER = (
    "No successful run has ever been recorded for '%s' (%d run(s) in the last 24h, none SUCCESS)."
)

# Alert types, one per issue that alerts.
ALERT_STDOUT = "DAGSTER_STDOUT_ERROR"
ALERT_ANOMALY = "ZERO_ROWS_ANOMALY"
ALERT_FAILURE = "EXECUTION_FAILURE_RATE"
ALERT_STALE = "SLA_STALENESS_EXCEEDED"
ALERT_NEVER = "NEVER_SUCCEEDED"

# Crawl locations.
CRAWL_HTTPS_BASE = "https://data.commoncrawl.org"
CRAWL_INDEX_PREFIX = "s3://commoncrawl/cc-index/table/cc-main/warc"
CRAWL_MANIFEST_NAME = "cc-index-table.paths.gz"
DEFAULT_SUBSET = "warc"
CDX_MAX_ROWS = 10_000
CDX_OVERFETCH = 5

# Catalog rule dictionaries and limits.
BRAND_ALIASES = {"apple": "Apple", "samsung": "Samsung", "xiaomi": "Xiaomi"}
COLOR_WORDS = [
    ("black|чёрн|черн", "Black"),
    ("white|бел", "White"),
    ("red|красн", "Red"),
    ("blue|син|голуб", "Blue"),
]
CATEGORY_KEYWORDS = [
    ("phone case", "Accessories > Phone Cases"),
    ("charger", "Electronics > Chargers"),
    ("headphone", "Electronics > Audio"),
    ("shirt", "Apparel > Shirts"),
]
CONFIDENCE_FLOOR = 0.65
PRICE_CEILING = 100_000
FUZZY_THRESHOLD = 90

# Cluster summary defaults.
DEFAULT_HOOK = "Discover the ultimate solution today."
DEFAULT_OVERLAY = "SPECIAL OFFER 50% OFF"
DEFAULT_MEDIA_TYPE = "video"
DEFAULT_SUBJECT = "modern product"

# Fixed value: the code points a Unicode strip removes.
WHITESPACE = "".join(
    map(
        chr,
        (
            *range(0x09, 0x0E),
            *range(0x1C, 0x21),
            0x85,
            0xA0,
            0x1680,
            *range(0x2000, 0x200B),
            0x2028,
            0x2029,
            0x202F,
            0x205F,
            0x3000,
        ),
    )
)
