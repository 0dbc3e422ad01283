"""Fixed values that results depend on."""

from __future__ import annotations

# Limits and ratios.
CHARS_PER_TOKEN = 4
LINE_CHARS = 40
BLANK_LINE_TOKENS = 2
SNIPPET_BUDGET = 2_000
BUDGET_WARNING, BUDGET_CRITICAL = 80_000, 150_000
CONTEXT_LIMIT, WATCH_WARNING, WATCH_CRITICAL, WATCH_EMERGENCY = 180_000, 0.70, 0.85, 0.95
LOG_CONTEXT, LOG_ENTRIES, LOG_LEVEL_ENTRIES = 3, 200, 100
SEARCH_RESULTS, SEARCH_CONTEXT = 50, 2
SECTION_LINES = 30
WINDOW_LINES, WINDOW_OVERLAP = 60, 10
BRACE_LINES, INDENT_LINES, SIGNATURES, SIGNATURE_LINES = 200, 300, 50, 60
SESSION_GAP_HOURS, CACHE_DAYS = 24, 7
K1, B = 1.5, 0.75
DEDUPE_CHARS = 120

# Words that carry no meaning in a query.
STOP_WORDS = [
    "the", "and", "for", "this", "that", "with", "from",
    "have", "not", "are", "was", "what", "how", "can",
    "does", "use", "via", "into", "onto", "will", "should",
    "would", "could", "about", "when", "then", "else",
]

# Folders and files that no scan enters.
IGNORED_DIRECTORIES = [
    "node_modules", ".git", "dist", "build", ".next", ".nuxt", "__pycache__", ".venv", "venv", "env", ".env", "coverage",
    ".nyc_output", "target", "vendor", ".gradle", "Pods", ".DS_Store", ".idea", ".vscode", "out", ".cache", "tmp", "temp",
]
IGNORED_FILES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", ".env", ".env.local", ".env.production"]

# Folders with a dot that a map takes at the top of a tree.
DOTTED_TOP = (".github", ".claude")

# Languages by file ending.
LANGUAGE_EXTENSIONS = {
    "typescript": [".ts", ".tsx", ".mts"],
    "javascript": [".js", ".jsx", ".mjs", ".cjs"],
    "python": [".py", ".pyw", ".pyx"],
    "go": [".go"],
    "rust": [".rs"],
    "java": [".java"],
    "csharp": [".cs"],
    "cpp": [".cpp", ".cc", ".cxx", ".c", ".h", ".hpp"],
    "ruby": [".rb", ".rake"],
    "php": [".php"],
    "swift": [".swift"],
    "kotlin": [".kt", ".kts"],
    "scala": [".scala"],
    "shell": [".sh", ".bash", ".zsh"],
    "yaml": [".yml", ".yaml"],
    "json": [".json"],
    "toml": [".toml"],
    "markdown": [".md", ".mdx"],
}
CODE_LANGUAGES = ["typescript", "javascript", "python", "go", "rust", "java", "csharp", "cpp", "ruby", "php", "swift", "kotlin"]

# Words that open no function.
NO_FUNCTION = ["if", "for", "while", "switch", "catch", "return", "new", "delete", "typeof", "void", "throw", "await", "constructor", "super", "this"]

# What a scan of log lines takes for trouble, most severe first.
LEVEL_PATTERNS = {
    "FATAL": r"\b(FATAL|CRITICAL|EMERGENCY)\b",
    "ERROR": r"\b(ERROR|ERR|Exception|Traceback|Error:|SEVERE)\b",
    "WARN": r"\b(WARN|WARNING|DEPRECAT|DEPRECATED)\b",
}

# Descriptions by file name, the first that fits.
DESCRIPTIONS = [
    (["index.ts", "index.js"], "is", "entry point"),
    (["test", "spec"], "has", "tests"),
    (["config"], "has", "configuration"),
    (["type", "model"], "has", "types/models"),
    (["util", "helper"], "has", "utilities"),
    (["service"], "has", "service"),
    (["controller"], "has", "controller"),
    (["router", "route"], "has", "routes"),
    (["README.md", "readme.md"], "is", "documentation"),
    (["package.json"], "is", "npm package config"),
]
