"""Transcript tags, caps, reply-choice texts (JavaScript dialect) and field aliases."""

TURN_END = "turn_ended"
TURN_SEPARATOR = "\n\n"
USER_QUERY = r"<user_query>([\s\S]*?)<\/user_query>"
ATTACHED_FILES = r"<attached_files>([\s\S]*?)<\/attached_files>"
CONTEXT_TAGS = [
    r"<timestamp>[\s\S]*?<\/timestamp>",
    r"<open_and_recently_viewed_files>[\s\S]*?<\/open_and_recently_viewed_files>",
    r"<attached_files>[\s\S]*?<\/attached_files>",
    r"<system_reminder>[\s\S]*?<\/system_reminder>",
]
HASH_CHARS = 32

MENTION = r"@([^\s@]+)"
MENTION_TRAILING = r"""[),.;:!?'"\]]+$"""

PROMPT_LABEL = "your prompt"
PENDING_LABEL = "an earlier message still pending in this chat"

TOOL_INPUT_FIELDS = ["tool_input", "input", "arguments", "toolInput", "params"]
TOOL_OUTPUT_FIELDS = [
    "tool_output",
    "output",
    "mcp_tool_output",
    "tool_response",
    "result",
    "response",
]

PAGE_CHROME = (
    r"gemini (is ai and |can )?(can )?make mistakes|chats?\s+(aren'?t|are not)\s+used to improve|"
    r"opens in a new window|your privacy\s*&\s*gemini|double[- ]check (its|it'?s) responses|ask gemini"
)
META_PIECE = (
    r"^(you|ask gemini|gemini|now|today|yesterday|mon|tue|wed|thu|fri|sat|sun|show thinking|"
    r"model thoughts|\d{1,2}:\d{2}(\s?[ap]\.?m\.?)?|"
    r"\d+\s*(sec|second|min|minute|hour|hr|day|week|month)s?(\s+ago)?)$"
)
META_SHORT_CHARS, META_SHORT_SHARE, META_ROW_CHARS = 60, 0.6, 200
REPLY_MIN_CHARS, REPLY_CONFIDENT_CHARS, REPLY_MAX_INTERACTIVE = 2, 80, 0.5
REPLY_LABEL_ONLY = r"^(gemini response|model thoughts|show thinking)$"
REPLY_LABEL_PREFIX = r"^(gemini response|show thinking|model thoughts)\s*"
