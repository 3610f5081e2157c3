"""Shell command categories, patterns (JavaScript dialect) and messages.

Checked in this order; deny categories stand before the ask category. Patterns are (source, flags).
"""

COMMAND_CATEGORIES = [
    {
        "category": "destructive_fs",
        "permission": "deny",
        "patterns": [
            (r"\brm\s+-[a-z]*r[a-z]*f\b", "i"),
            (r"\brm\s+-[a-z]*f[a-z]*r\b", "i"),
            (r"\brm\s+(?=(?:[^\n]*\s)?-[a-z]*r\b)(?=(?:[^\n]*\s)?-[a-z]*f\b)", "i"),
            (r"\brm\s+[^\n]*--recursive[^\n]*--force", "i"),
            (r"\brm\s+[^\n]*--force[^\n]*--recursive", "i"),
            (r"\bdd\s+[^\n]*\bif=", "i"),
            (r"\bmkfs(?:\.\w+)?\b", "i"),
            (r"(?:>|>>)\s*\/dev\/(?:sd|nvme|hd|disk|vd)\w*", "i"),
            (r"\bchmod\s+-R\s+0*777\b", "i"),
        ],
        "user_message": "Blocked: this command destroys files irreversibly.",
        "agent_message": (
            "Command Guard denied a destructive filesystem command. Do NOT run bulk/recursive deletes, "
            "disk writes, or format commands. If a deletion is genuinely needed, scope it to specific "
            "paths and ask the user to run it themselves."
        ),
    },
    {
        "category": "priv_escalation",
        "permission": "deny",
        "patterns": [
            (r"\bsudo\b", "i"),
            (r"\bsu\s+-(?:\s|$)", "i"),
            (r"\bsu\s+root\b", "i"),
            (r"\bdoas\b", "i"),
        ],
        "user_message": "Blocked: privilege escalation is not allowed from the agent.",
        "agent_message": (
            "Command Guard denied a privilege-escalation command (sudo/su/doas). Do not attempt to run "
            "commands as another/root user; ask the user to perform any privileged step themselves."
        ),
    },
    {
        "category": "remote_exec",
        "permission": "deny",
        "patterns": [
            (
                r"\b(?:curl|wget|fetch)\b[^\n]*\|\s*(?:sudo\s+)?"
                r"(?:sh|bash|zsh|dash|python[0-9.]*|node|ruby|perl)\b",
                "i",
            ),
        ],
        "user_message": "Blocked: piping a download straight into a shell runs unreviewed remote code.",
        "agent_message": (
            "Command Guard denied a curl|sh / wget|bash remote-exec pipeline. Do not execute downloaded "
            "scripts unreviewed. Download to a file, let the user inspect it, then run it deliberately."
        ),
    },
    {
        "category": "infra_destructive",
        "permission": "deny",
        "patterns": [
            (r"\bterraform\s+destroy\b", "i"),
            (r"\bkubectl\s+delete\b", "i"),
            (r"\bDROP\s+(?:TABLE|DATABASE|SCHEMA)\b", "i"),
            (r"\bTRUNCATE\s+TABLE\b", "i"),
        ],
        "user_message": "Blocked: this tears down infrastructure or data.",
        "agent_message": (
            "Command Guard denied a destructive infrastructure/database command (terraform destroy / "
            "kubectl delete / DROP / TRUNCATE). These are irreversible against real state; propose the "
            "change and let the user apply it deliberately."
        ),
    },
    {
        "category": "git_destructive",
        "permission": "ask",
        "patterns": [
            (r"\bgit\s+push\b[^\n]*--force(?!-with-lease)", "i"),
            (r"\bgit\s+push\b[^\n]*(?:^|\s)-f(?:\s|$)", "i"),
            (r"\bgit\s+push\b[^\n]*--delete\b", "i"),
            (r"\bgit\s+reset\s+--hard\b", "i"),
            (r"\bgit\s+clean\s+-\w*f", "i"),
            (r"\bgit\s+branch\s+-D\b", ""),
            (r"\bgit\s+filter-(?:branch|repo)\b", "i"),
            (r"\bgit\s+commit\b[^\n]*--amend\b", "i"),
        ],
        "user_message": "Confirm: this rewrites or discards git history that others may rely on.",
        "agent_message": (
            "Command Guard is holding a history-rewriting git command for user confirmation (force-push / "
            "reset --hard / clean -f / branch -D / filter-branch / amend). Prefer --force-with-lease over "
            "--force, and confirm with the user before rewriting shared history."
        ),
    },
]

# Returned when the command could not be read (fail closed).
UNREADABLE_USER_MESSAGE = "Command guard error — denied by default (fail-closed)."
UNREADABLE_AGENT_MESSAGE = (
    "Command Guard could not evaluate this command and denied it by default. Retry, or ask the user to "
    "run it manually if it is safe."
)
