"""Fixed values the results depend on.

Every literal in this module is a fixed value: it has to be exactly this for results to agree with
the service whose data jobs are re-expressed here.  Nothing else in the package hides such values.
"""

# --- item rules (bytes, not characters) ---------------------------------------------------------
MAX_TITLE_BYTES = 500
MAX_DESCRIPTION_BYTES = 2000
MAX_AUTHOR_BYTES = 100
UNKNOWN_AUTHOR = "Unknown"
ZERO_TIME_TEXT = "0001-01-01T00:00:00Z"

ERR_TITLE_EMPTY = "title cannot be empty"
ERR_TITLE_LONG = "title cannot exceed 500 characters"
ERR_LINK_EMPTY = "link cannot be empty"
ERR_LINK_INVALID = "link must be a valid URL"
ERR_DESCRIPTION_LONG = "description cannot exceed 2000 characters"
ERR_AUTHOR_LONG = "author cannot exceed 100 characters"
ERR_PUB_DATE = "pub_date must be in RFC3339 format"
ERR_PREFIX = "validation failed: "

# Code points of the Unicode white space removed from both ends of every text field.
WHITE_SPACE_POINTS = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
    0x202F, 0x205F, 0x3000,
)
WHITE_SPACE = "".join(map(chr, WHITE_SPACE_POINTS))

# --- paging -------------------------------------------------------------------------------------
DEFAULT_PAGE = 100
MAX_PAGE = 1000
CURSOR_PREFIX = "offset:"
PREFIX_RANGE_END = chr(0xFFFD)

# --- write batches: (largest item count, batch size), then the size beyond the last step ---------
BATCH_STEPS = ((10, 50), (50, 200), (200, 500), (1000, 1000))
BATCH_BEYOND = 2000

# --- retention ----------------------------------------------------------------------------------
RETENTION_DAYS_DEFAULT = 30
RETENTION_DAYS_RANGE = (1, 365)

# --- refresh cadence (microseconds) -------------------------------------------------------------
SECOND_US = 1_000_000
MINUTE_US = 60 * SECOND_US
HOUR_US = 60 * MINUTE_US
DAY_US = 24 * HOUR_US
LONGEST_GAP_US = 7 * DAY_US
DEFAULT_INTERVAL_US = DAY_US
TTL_DEFAULT_US = 15 * MINUTE_US
TTL_HIGH_US = 5 * MINUTE_US
TTL_LOW_US = 60 * MINUTE_US
LARGE_FEED = 100
SMALL_FEED = 10

# --- URL screening ------------------------------------------------------------------------------
MAX_URL_BYTES = 2048
URL_EMPTY = "URL cannot be empty"
URL_TOO_LONG = "URL length exceeds maximum allowed size"
URL_UNPARSABLE = "invalid URL format"
URL_SCHEME = "only HTTP and HTTPS URLs are allowed"
URL_HOST = "URL must have a valid host"
URL_LOCALHOST = "localhost URLs are not allowed"
URL_PRIVATE = "access to private networks and localhost is not allowed"
URL_EXTENSION = "URL contains suspicious file extension"
URL_MALICIOUS = "URL contains potentially malicious content"

LOCALHOST_NAMES = (
    "localhost", "127.0.0.1", "::1", "0.0.0.0", "0:0:0:0:0:0:0:1", "0:0:0:0:0:0:0:0",
)
PRIVATE_SUFFIXES = (
    ".local", ".localhost", ".internal", ".corp", ".home", ".lan", ".priv", ".test", ".dev",
)
SUSPICIOUS_EXTENSIONS = (
    ".exe", ".bat", ".cmd", ".com", ".pif", ".scr", ".vbs", ".js", ".jar", ".php", ".asp", ".aspx",
    ".jsp", ".cgi", ".pl", ".py", ".rb", ".sh", ".ps1", ".psm1", ".psd1", ".wsf", ".wsh",
)
INJECTION_TEXTS = (
    "<script", "javascript:", "vbscript:", "onload=", "onerror=", "eval(", "alert(", "prompt(",
    "confirm(", "document.", "window.", "location.", "cookie",
)
FEED_PATH_TEXTS = ("/rss", "/feed", "/atom", "/xml")
FEED_PATH_ENDINGS = (".rss", ".xml", ".atom")
FEED_QUERY_WORDS = ("rss", "feed", "atom")

# --- feeds offered when no catalog file exists ---------------------------------------------------
FALLBACK_FEEDS = (
    ("TechCrunch", "https://techcrunch.com/feed/"),
    ("BBC News", "http://feeds.bbci.co.uk/news/rss.xml"),
    ("The Verge", "https://www.theverge.com/rss/index.xml"),
    ("CNN Top Stories", "http://rss.cnn.com/rss/edition.rss"),
    ("Hacker News", "https://hnrss.org/frontpage"),
)

# --- origins allowed by default, per environment -------------------------------------------------
DEVELOPMENT_ORIGINS = (
    "http://localhost:3000", "http://localhost:3001", "http://127.0.0.1:3000",
    "http://127.0.0.1:3001", "http://localhost:8080",
)
STAGING_ORIGINS = ("https://staging.yourdomain.com", "https://staging-api.yourdomain.com")
PRODUCTION_ORIGINS = (
    "https://yourdomain.com", "https://www.yourdomain.com", "https://api.yourdomain.com",
)

# --- request log, jobs and queue -----------------------------------------------------------------------
LOGGED_BODY_BELOW = 1024
CLIENT_IDLE_US = 5 * MINUTE_US
JOB_TTL_US = DAY_US
REJECT_THRESHOLD = 0.8
QUEUE_CAPACITY = 50

# --- metrics ----------------------------------------------------------------------------------------
DURATION_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
ITEM_COUNT_BOUNDS = (0.0, 1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0)
FEED_FETCH_TOTAL = "rss_feed_fetch_total"
FEED_FETCH_SECONDS = "rss_feed_fetch_duration_seconds"
FEED_ITEMS = "rss_feed_items_count"
JOBS_TOTAL = "rss_async_jobs_total"
JOB_SECONDS = "rss_async_job_duration_seconds"
QUEUE_SIZE = "rss_async_queue_size"
ACTIVE_WORKERS = "rss_active_workers"
CACHE_HITS_TOTAL = "rss_cache_hits_total"
CACHE_MISSES_TOTAL = "rss_cache_misses_total"
STORE_OPS_TOTAL = "rss_datastore_operations_total"
STORE_OP_SECONDS = "rss_datastore_operation_duration_seconds"
HTTP_TOTAL = "rss_http_requests_total"
HTTP_SECONDS = "rss_http_request_duration_seconds"

# --- alerts -------------------------------------------------------------------------------------------
ALERT_SEVERITIES = ("low", "medium", "high", "critical")
ALERT_TYPES = (
    "feed_failure", "high_latency", "queue_full", "datastore_error", "cache_failure", "worker_down",
    "high_error_rate",
)

# Alerts: title and description
ALERT_FAILURE_RATE = ("High Feed Failure Rate", "High RSS feed failure rate detected", "RSS feed failure rate has exceeded threshold")
ALERT_QUEUE_FULL = ("Async Queue Full", "Async processing queue is full", "The async job queue has reached capacity")
ALERT_STORE_ERRORS = ("Datastore Errors", "Datastore operation failures detected", "Multiple datastore operations have failed")

# Request log messages
LOG_SERVER_ERROR = "Request completed with server error"
LOG_CLIENT_ERROR = "Request completed with client error"
LOG_SUCCESS = "Request completed successfully"
