"""Patterns, word lists and edges that results depend on."""

# Store domains, and what a tenant mention looks like in a line of text.
STORE = r"[A-Za-z0-9-]+\.myshopify\.com"
STORE_SUFFIX = ".myshopify.com"
TENANT = r"""(?i)tenant(?:[ _]?id)?["']?\s*[:=]\s*["']?([A-Za-z0-9][A-Za-z0-9._-]{2,63})"""

# Error lines: what varies between two lines of one kind. Applied in this order.
WORD_BREAKS = r"""\s,;:=()\[\]{}"'|/"""
ERROR_VARIATIONS = [
    (STORE, "<store>"),
    (r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d)?(\.\d+)?Z?", "<time>"),
    (r"""(^|[\s/\[("'])([1-5][0-9][0-9])( [A-Z][a-z])""", "$1§$2§$3"),
    (rf"(^|[{WORD_BREAKS}])([^{WORD_BREAKS}§]*[0-9][^{WORD_BREAKS}]*)", "$1<*>"),
    (r"<\*>(?:[\s,|]*<\*>)+", "<*>"),
    (r"§([1-5][0-9][0-9])§", "$1"),
]
REPEATED_WILDCARD = r"<\*>(?:[\s,|]*<\*>)+"
KEY_WORDS = 8
CELL_CHARS = 1500

# Log columns: searched by free text, counted as facets, and shown first.
TEXT_COLUMNS = ["msg", "body", "raw", "exception", "error_message", "error_code", "error_identifier", "class",
                "method", "logger", "kv_json", "request_uuid", "tenant_id", "web_id", "carrier"]
FACET_COLUMNS = ["level", "service", "host", "exception"]
FIRST_COLUMNS = ["log_time", "level", "service", "msg", "exception", "error_code", "error_message", "status_code",
                 "class", "method", "line", "logger", "host", "instance_id", "container_id", "app", "tenant_id",
                 "request_uuid", "response_time_ms", "body", "raw", "format", "parse_ok", "cluster", "source_file",
                 "log_time_ms", "ingest_time_ms"]

# Access log lines: one token per field, and the documented fields in order (spares absorb new ones).
ACCESS_TOKEN = r'"(?:[^"\\]|\\.)*"|[^ ]+'
ACCESS_FIELDS = [
    "type", "time", "elb", "client", "target", "request_processing_time", "target_processing_time",
    "response_processing_time", "elb_status_code", "target_status_code", "received_bytes", "sent_bytes", "request",
    "user_agent", "ssl_cipher", "ssl_protocol", "target_group_arn", "trace_id", "domain_name", "chosen_cert_arn",
    "matched_rule_priority", "request_creation_time", "actions_executed", "redirect_url", "error_reason",
    "target_port_list", "target_status_code_list", "classification", "classification_reason", "conn_trace_id",
    "transformed_host", "transformed_uri", "request_transform_status", "ip_address", "target_error_code",
    "elb_error_code", "spare1", "spare2", "spare3", "spare4"]
ACCESS_FILE = (r"^(\d{12})_elasticloadbalancing_([a-z0-9-]+)_app\.([A-Za-z0-9-]{1,32})\.([0-9a-f]+)_"
               r"(\d{8}T\d{4}Z)_([0-9A-Fa-f.:]+)_([A-Za-z0-9]+)\.log\.gz$")
CLUSTER_NAME = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"

# Request table and its two roll-ups, in column order.
REQUEST_COLUMNS = [
    "time", "ts_ms", "lb", "tg", "cluster", "domain", "method", "path", "path_group", "query", "url", "protocol",
    "elb_code", "tgt_code", "client_ip", "client_port", "target", "req_t", "tgt_t", "resp_t", "rx", "tx", "user_agent",
    "error_reason", "classification", "classification_reason", "actions", "elb_error_code", "target_error_code",
    "trace_id", "type", "ssl_protocol", "rule_priority", "request_created", "target_list", "target_code_list", "raw"]
MINUTE_KEYS = ["lb", "tg", "cluster", "domain", "elb_code", "tgt_code"]
PATH_KEYS = ["lb", "tg", "cluster", "method", "path_group", "elb_code", "tgt_code"]

# URLs and path groups, in the order they are applied.
URL_AFTER_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
PATH_GROUPS = [
    (r"/[A-Za-z0-9-]+\.myshopify\.com", "/<store>"),
    (r"/[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}", "/<uuid>"),
    (r"/[0-9A-Fa-f]{16,}(/|$)", "/<id>$1"),
    (r"/[0-9]+(/|$)", "/<n>$1"),
    (r"/[0-9]+(/|$)", "/<n>$1"),
]
SHORT_PATH = r"/[0-9a-f-]{8,}|/\d+"

# Target response time bins in ms: bin i holds edge[i] <= t < edge[i + 1], the last is open.
LATENCY_EDGES = [0, 5, 10, 20, 30, 50, 75, 100, 150, 200, 300, 500, 750, 1000, 1500, 2000, 3000, 5000, 7500, 10000,
                 15000, 20000, 30000, 60000]
STATUS_CLASSES = ["2xx", "3xx", "4xx", "5xx"]

# Index names and session IDs.
ORDER_INDEX = r"^(.+?)(?:-(s|jg))?-order-(\d{4})(?:\.(0[1-9]|1[0-2]))?(?:\.(\d{3}))?$"
SKIPPED_VARIANTS = {"s": "-s-", "jg": "-jg-"}
SESSION_INDEX = (r"^(.+?)-(?:session_history|cop-derrh)-\d{4}[.-](?:W?\d{2})(?:[.-]\d{2})?(?:[.-]\d{3,6})?$")
SESSION_UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
KNOWN_SESSION_VALUES = ["NA", "ORDER_LOOKUP_CALL", "xyz123", "novalue"]
GOOD_CATEGORIES = ["total", "valid", "health", "variant"]
PAGE_ORDER = ["PDP", "CART", "COP", "OC"]
CATEGORY_ORDER = ["valid", "NA", "ORDER_LOOKUP_CALL", "xyz123", "novalue", "empty", "missing", "numbers", "uuid",
                  "other", "health"]
ALL = "_all"

# Health and alerting.
BAD_TARGET_STATES = ["unhealthy", "draining", "unavailable", "initial"]
STATUS_RANK = {"down": 0, "degraded": 1, "healthy": 2, "none": 3}
BOARD_RANK = {"red": 0, "amber": 1, "green": 2, "idle": 3}
JUDGE_THRESHOLDS = {"minCalls": 100, "err5xxRedPct": 1.0, "err5xxAmberPct": 0.5, "err4xxTimesLastWeek": 2.0,
                    "err4xxMinPct": 5.0, "p95RedTimes": 2.0, "p95AmberTimes": 1.5, "p95MinMs": 300, "quietPct": 50}
QUIET_MIN_CALLS = 1000
HYSTERESIS = 2
REPEAT_MINUTES = {"warning": 60, "critical": 15}
LB_LAG_MINUTES = 10
DEPLOY_GRACE_MINUTES = 10
USAGE_LINES = {"cpu": {"warning": 70, "critical": 80}, "memory": {"warning": 70, "critical": 80}}
