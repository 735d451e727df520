"""Fixed values the operators must share with any other implementation of the
same rules. Everything here is a default; each operator takes it as a parameter."""

# Chunking.
CHUNK_LEN = 500
CHUNK_OVERLAP = 80
PREVIEW_CHARS = 200

# De-duplication.
SEMANTIC_THRESHOLD = 0.96
SOURCE_PRIORITY = {"UPLOADED_KB": 3, "TENANT_KB": 2, "KB": 1, "URL": 0}

# Retrieval.
TOP_K_BUDGETS = {"KB": 5, "UPLOADED_KB": 3}
FINAL_TOP_K = 6
CONFIDENCE_SCALE = 0.8
CONFIDENCE_WEIGHTS = (0.5, 0.3, 0.2)
CONTEXT_SEPARATOR = "\n---\n"

# Escalation.
MIN_CONFIDENCE = 0.35
MAX_BEST_DISTANCE = 0.55
HARD_INTENTS = ("refund_request", "complaint")
HARD_KEYWORDS = (
    "legal", "lawyer", "lawsuit", "court", "gdpr", "privacy",
    "compliance", "regulation", "chargeback", "bank",
    "payment dispute", "credit card", "refund immediately",
    "cancel immediately", "terminate account", "sue",
)
DISPLAY_REASONS = (
    ("retrieval_confidence", "low_confidence"),
    ("best_distance", "low_confidence"),
    ("keyword", "high_risk_operation"),
    ("hard_intent", "high_risk_operation"),
)

# Intents.
INTENT_LABELS = (
    "refund_request", "order_status", "technical_issue", "complaint", "general_query",
)
DEFAULT_INTENT = "general_query"
EMPATHY_INTENTS = ("complaint", "technical_issue", "refund_request")
SENTIMENT_CHARS = 1000

# Knowledge base admission.
MAX_VECTORS = 20_000
KB_MAX_BYTES = 5 * 1024 * 1024
KB_MIN_CHARS = 100
KB_EXTENSIONS = (".txt", ".pdf", ".json")

# Ticket input.
ATTACHMENT_EXTENSIONS = (".pdf", ".txt")
MAX_ATTACHMENTS = 5
ATTACHMENT_MAX_BYTES = 5 * 1024 * 1024
EMAIL_CHARS = 5000
ATTACHMENT_CHARS = 4000
TOTAL_CHARS = 12000
LONG_EMAIL_CHARS = 3000
PURPOSE_CHARS = 300
KEY_POINTS_CHARS = 1000
MIN_PURPOSE = 5
MIN_QUERY = 5
MAX_QUERY = 200
MAX_KEY_DETAILS = 7
WORKFLOWS = (
    ("support_agent_assistance", "support_agent_assistance"),
    ("internal_ops", "internal_ops"),
    ("financial_ops", "financial_ops"),
    ("compliance_validation", "compliance_validation"),
)

# Request admission.
RATE_WINDOW_SECONDS = 60
RATE_LIMITS = {
    "api_retrieve": 120,
    "api_predict": 60,
    "api_ingest_kb": 10,
    "api_feedback": 30,
    "api_health": 300,
}
ABUSE_WINDOW_SECONDS = 3600
ABUSE_LIMITS = {
    "api_retrieve": 10000,
    "api_predict": 6000,
    "api_feedback": 2000,
    "api_ingest_kb": 850,
}
ENDPOINT_SCOPES = {
    "api_predict": "predict",
    "api_retrieve": "retrieve",
    "api_ingest_kb": "ingest_kb",
    "api_feedback": "feedback",
    "api_health": "health",
}
ADMITTED_KEY_STATUS = ("active", "revoked")
MAX_SKEW_SECONDS = 300
INTERACTION_TTL_HOURS = 2

# Usage, quotas and alerts.
COST_PER_LLM_CALL = 5
MAX_REQUESTS_PER_MONTH = 300_000
MAX_LLM_CALLS_PER_MONTH = 100_000
REQUEST_CAP_REASON = "auto_block_requests_cap_exceeded"
LLM_CAP_REASON = "auto_block_llm_cap_exceeded"
EXPECTED_MONTHLY_LLM_CALLS = 10_000
SPIKE_RATIO = 3.0
GROWTH_RATIO = 2.0
GROWTH_DAYS = 7
BURN_SHARE = 0.4
BURN_TIME_SHARE = 0.25
PROXIMITY_SHARE = 0.75

# Page fetching rules.
PAGE_MAX_BYTES = 2_000_000
PAGE_MAX_REDIRECTS = 3
BLOCKED_HOSTS = ("localhost", "127.0.0.1", "0.0.0.0", "169.254.169.254")

# Characters str.strip() removes in Python: the Unicode whitespace set.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
