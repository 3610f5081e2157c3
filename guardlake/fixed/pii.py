"""PII detector patterns, written in the JavaScript regex dialect.

Listed in registry order; the position is the rule's rank and breaks ties between equal spans.
Each entry is (name, pattern, flags).
"""

PII_PATTERNS = [
    (
        "PRIVATE_KEY",
        r"-----BEGIN (?:RSA |EC |OPENSSH |DSA |ENCRYPTED )?PRIVATE KEY-----[\s\S]*?"
        r"-----END (?:RSA |EC |OPENSSH |DSA |ENCRYPTED )?PRIVATE KEY-----",
        "",
    ),
    ("JWT", r"\beyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]{2,}=*", ""),
    (
        "CONN_STRING",
        r"\b(?:(?:postgres|postgresql|mysql|mongodb(?:\+srv)?|redis|amqp|https?):\/\/)"
        r"[^:\s\/]+:[^@\s\/]+@[^\s]+",
        "i",
    ),
    (
        "API_KEY",
        r"\b(?:sk-ant-[A-Za-z0-9_-]{16,}|sk-proj-[A-Za-z0-9_-]{16,}|sk-[A-Za-z0-9]{16,}"
        r"|sk_live_[A-Za-z0-9]{16,}|sk_test_[A-Za-z0-9]{16,}|pk_live_[A-Za-z0-9]{16,}"
        r"|pk_test_[A-Za-z0-9]{16,}|rk_live_[A-Za-z0-9]{16,}|AKIA[0-9A-Z]{16}"
        r"|AIza[0-9A-Za-z_-]{20,}|github_pat_[A-Za-z0-9_]{20,}|gh[pousr]_[A-Za-z0-9]{20,}"
        r"|npm_[A-Za-z0-9]{20,}|hf_[A-Za-z0-9]{20,}|xox[baprs]-[A-Za-z0-9-]{10,}"
        r"|https:\/\/hooks\.slack\.com\/services\/T[A-Z0-9]+\/B[A-Z0-9]+\/[A-Za-z0-9]+)",
        "",
    ),
    ("BEARER_TOKEN", r"\bBearer\s+[A-Za-z0-9._~+/=-]{16,}", ""),
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", ""),
    (
        "PHONE_US",
        r"(?:\+?1[-.\s]*)?(?:\([2-9]\d{2}\)|[2-9]\d{2})[-.\s]+\d{3}[-.\s]+\d{4}\b",
        "",
    ),
    ("PHONE_IN", r"\+91[-.\s]*[6-9]\d{4}[-.\s]?\d{5}\b", ""),
    ("CREDIT_CARD", r"\b\d(?:[ -]?\d){12,18}\b", ""),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b", ""),
    ("PAN_IN", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", ""),
    ("AADHAAR", r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", ""),
    ("IPV4", r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b", ""),
    (
        "IPV6",
        r"\b(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}\b"
        r"|::(?:[0-9A-Fa-f]{1,4}:){0,5}[0-9A-Fa-f]{1,4}\b",
        "",
    ),
]

# Replacement tokens by direction.
INBOUND_PREFIX = "[REDACTED_PII_"
INBOUND_SUFFIX = "]"
OUTBOUND_TOKEN = "[REDACTED_MOCK_PII]"

# Header of a PEM key, enough to call a text raw without its end marker.
PEM_HEADER = r"-----BEGIN (?:RSA |EC |OPENSSH |DSA |ENCRYPTED )?PRIVATE KEY-----"

# Names accepted into the decision table.
PII_TYPE_SHAPE = r"^[A-Z0-9_]{1,40}$"

# Query parameters that carry credentials, and what replaces their value.
CREDENTIAL_PARAMS = ["key", "api_key", "apikey", "access_token", "token"]
CREDENTIAL_TOKEN = "[REDACTED]"

# First row of the Verhoeff permutation table; the other rows follow by repetition.
VERHOEFF_PERMUTATION = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
