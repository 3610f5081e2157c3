"""File extensions, MIME types, size limits and office part names."""

TEXT_EXTENSIONS = [
    "txt", "text", "md", "markdown", "rst", "adoc", "tex", "bib", "csv", "tsv", "json", "jsonl", "ndjson",
    "yaml", "yml", "toml", "ini", "cfg", "conf", "env", "properties", "log", "xml", "svg", "html", "htm",
    "css", "scss", "less", "js", "mjs", "cjs", "jsx", "ts", "tsx", "vue", "svelte", "py", "rb", "go", "rs",
    "java", "kt", "swift", "c", "h", "cpp", "hpp", "cc", "cs", "php", "pl", "lua", "dart", "scala", "r", "jl",
    "sh", "bash", "zsh", "fish", "sql", "graphql", "gql", "proto", "tf", "patch", "diff", "srt", "vtt",
    "dockerfile", "makefile", "gitignore", "gitattributes", "editorconfig",
]
BINARY_EXTENSIONS = [
    "pdf", "doc", "xls", "ppt", "odt", "ods", "odp", "rtf", "pages", "numbers", "key", "epub", "zip", "gz",
    "tgz", "bz2", "xz", "7z", "rar", "tar", "png", "jpg", "jpeg", "gif", "bmp", "tiff", "tif", "webp", "ico",
    "heic", "heif", "avif", "psd", "ai", "eps", "mp3", "wav", "flac", "aac", "ogg", "oga", "m4a", "mp4",
    "mov", "avi", "mkv", "webm", "wmv", "m4v", "exe", "dll", "so", "dylib", "bin", "dmg", "iso", "pkg", "deb",
    "rpm", "jar", "war", "class", "pyc", "wasm", "db", "sqlite", "sqlite3", "parquet", "ttf", "otf", "woff",
    "woff2", "eot",
]
OFFICE_EXTENSIONS = ["docx", "xlsx", "pptx", "docm", "xlsm", "pptm"]
TEXT_MIME_TYPES = [
    "application/json",
    "application/ld+json",
    "application/xml",
    "application/xhtml+xml",
    "application/javascript",
    "application/ecmascript",
    "application/x-sh",
    "application/x-yaml",
    "application/yaml",
    "application/toml",
    "application/sql",
    "image/svg+xml",
]
TEXT_MAX_BYTES = 2 * 1024 * 1024
OFFICE_MAX_BYTES = 8 * 1024 * 1024
OFFICE_UNREADABLE = "not a readable Office file"

OFFICE_TEXT_PART = (
    r"^(word\/(document|footnotes|endnotes|comments|header\d*|footer\d*)\.xml|xl\/sharedStrings\.xml|"
    r"xl\/worksheets\/sheet\d+\.xml|ppt\/(slides|notesSlides)\/[a-z]+\d+\.xml)$"
)
# What stands before the first end tag, in runs without "<": a lazy "anything" tries the end at every character.
_CONTENT = r"([^<]*+(?:<(?!\/\1>)[^<]*+)*+)"
PARAGRAPH = rf"<(w:p|a:p|si|c)(\s[^>]*)?>{_CONTENT}<\/\1>|<(w:p|a:p)(\s[^>]*)?\/>"
TEXT_RUN = rf"<((?:w|a):t|t)(\s[^>]*)?>{_CONTENT}<\/\1>"

# Upload endpoints by site: (host suffix, path part).
UPLOAD_ENDPOINTS = [
    ("chatgpt", "oaiusercontent.com", "/files/"),
    ("grok", "grok.com", "/upload-file-v2/"),
    ("deepseek", "deepseek.com", "/file/upload_file"),
    ("gemini", "clients6.google.com", "/upload/"),
]
