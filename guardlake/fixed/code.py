"""Code-scan categories, messages and patterns (JavaScript dialect), in scan order."""

CODE_CATEGORIES = [
    {
        "category": "sql_injection",
        "message": (
            "SQL query built from concatenated / interpolated input — use parameterized queries "
            "(bound placeholders), never string building."
        ),
        "patterns": [
            (r"""["'`][^"'`]*\b(?:SELECT|INSERT|UPDATE|DELETE|DROP|UNION)\b[^"'`]*["'`]\s*\+""", "i"),
            (r"`[^`]*\b(?:SELECT|INSERT|UPDATE|DELETE|DROP|UNION)\b[^`]*\$\{", "i"),
            (r"""\bf["'][^"']*\b(?:SELECT|INSERT|UPDATE|DELETE|DROP|UNION)\b[^"']*\{""", "i"),
            (r"""["'][^"']*\b(?:SELECT|INSERT|UPDATE|DELETE)\b[^"']*["']\s*(?:%|\.format\s*\()""", "i"),
        ],
    },
    {
        "category": "command_injection",
        "message": (
            "Shell/OS command built from input — avoid a shell string; pass an argv array to "
            "spawn/exec-file and never interpolate user data."
        ),
        "patterns": [
            (r"""\b(?:child_process\.)?(?:exec|execSync)\s*\([^)]*(?:\+|\$\{|`|%|\bf["'])""", "i"),
            (r"""\bos\.system\s*\([^)]*(?:\+|%|\.format\s*\(|\bf["'])""", "i"),
            (r"\bsubprocess\.(?:call|run|Popen)\s*\([^)]*shell\s*=\s*True", "i"),
        ],
    },
    {
        "category": "dangerous_eval",
        "message": (
            "Dynamic code execution (eval / new Function) on runtime input — remove it; parse or "
            "dispatch explicitly instead."
        ),
        "patterns": [(r"\beval\s*\(", ""), (r"\bnew\s+Function\s*\(", "")],
    },
    {
        "category": "weak_crypto",
        "message": (
            "Weak hash (MD5/SHA-1) — use SHA-256+ for integrity and a password KDF "
            "(scrypt/bcrypt/argon2) for passwords."
        ),
        "patterns": [
            (r"""\bcreateHash\s*\(\s*["'](?:md5|sha1)["']""", "i"),
            (r"\bhashlib\.(?:md5|sha1)\s*\(", "i"),
        ],
    },
    {
        "category": "hardcoded_secret",
        "message": (
            "Hardcoded credential/secret in source — read it from an environment variable or a secret "
            "manager instead."
        ),
        "patterns": [
            (
                r"\b(?:api[_-]?key|secret|token|password|passwd|access[_-]?key)\b"
                r"""\s*[:=]\s*["'][^"'\s]{8,}["']""",
                "i",
            ),
            (r"""["'](?:sk-live-|sk-|ghp_|AKIA|xox[baprs]-)[A-Za-z0-9_\-]{6,}["']""", ""),
        ],
    },
    {
        "category": "xss",
        "message": (
            "User input written to the DOM as HTML — sanitize/encode, or set textContent instead of "
            "innerHTML/dangerouslySetInnerHTML."
        ),
        "patterns": [
            (r"\bdangerouslySetInnerHTML\b", ""),
            (r"\.innerHTML\s*=(?!=)", ""),
            (r"\bdocument\.write\s*\(", ""),
        ],
    },
]

# A line that only looks up or fakes a secret is no hardcoded secret.
SECRET_PLACEHOLDER = (
    r"(process\.env|os\.environ|getenv|"
    r"""['"](?:xxx+|your[_-]?\w+|placeholder|changeme|example|test|dummy|redacted)['"])"""
)

PENDING_HEADER = "Regenerate the code you just wrote to fix these security issues, then stop:\n"
