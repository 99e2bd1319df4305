r"""Word lists, lookup tables, limits, patterns and formats.

Every value in this file must stay as it is for results to be right. Patterns are in
ECMAScript notation (see ``dialect``); ``(?i)`` in front marks a case-insensitive one.
"""

# --- Fixed values: limits -------------------------------------------------------------
MAX_FILE_SIZE_MB = 10
DEFAULT_CONCURRENCY = 3
MAX_CONCURRENCY = 10
RETRY_ATTEMPTS = 3
RETRY_DELAY_SECONDS = 1.0
MAX_FUNCTIONS_PER_FILE = 15
MAX_FUNCTIONS_DRAWN = 2
MAX_KEY_FILES = 5
PREVIEW_CHARS = 1000
CHARS_PER_TOKEN = 4

# --- Fixed values: names of our own output files and work folder ------------------------
OUTPUT_PREFIX = "corpusloom-output"
WORK_DIR = ".corpusloom"

# --- Fixed values: extension -> language ------------------------------------------------
LANGUAGES = {
    ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".vue": "vue", ".svelte": "svelte", ".astro": "astro",
    ".html": "html", ".htm": "html", ".xml": "xml", ".svg": "xml",
    ".css": "css", ".scss": "scss", ".sass": "scss", ".less": "less",
    ".php": "php", ".asp": "asp", ".jsp": "java", ".ejs": "ejs",
    ".hbs": "handlebars", ".handlebars": "handlebars",
    ".py": "python", ".java": "java", ".c": "c", ".cpp": "cpp", ".cxx": "cpp", ".cc": "cpp",
    ".h": "c", ".hpp": "cpp", ".cs": "csharp", ".vb": "vbnet", ".fs": "fsharp", ".fsx": "fsharp",
    ".go": "go", ".rs": "rust", ".swift": "swift", ".kt": "kotlin", ".scala": "scala",
    ".rb": "ruby", ".pl": "perl", ".pm": "perl", ".tcl": "tcl", ".lua": "lua", ".dart": "dart",
    ".r": "r", ".m": "matlab", ".matlab": "matlab",
    ".asm": "asm", ".s": "asm", ".zig": "zig", ".v": "v", ".nim": "nim",
    ".crystal": "crystal", ".pony": "pony",
    ".hs": "haskell", ".ml": "ocaml", ".elm": "elm", ".purs": "purescript",
    ".clj": "clojure", ".cljs": "clojure", ".scm": "scheme", ".rkt": "racket",
    ".ex": "elixir", ".exs": "elixir", ".erl": "erlang", ".hrl": "erlang",
    ".graphql": "graphql", ".gql": "graphql", ".sql": "sql", ".json": "json",
    ".yaml": "yaml", ".yml": "yaml",
    ".awk": "awk", ".sed": "sed", ".perl": "perl", ".sh": "bash", ".bash": "bash", ".zsh": "bash",
    ".makefile": "makefile", ".mk": "makefile", ".cmake": "cmake", ".gradle": "gradle",
    ".maven": "xml", ".pom": "xml", ".dockerfile": "dockerfile", ".containerfile": "dockerfile",
    ".md": "markdown", ".markdown": "markdown", ".rst": "rst", ".tex": "latex",
    ".raku": "raku", ".p6": "raku", ".vala": "vala", ".genie": "vala", ".boo": "boo",
    ".cobra": "python", ".ahk": "autohotkey",
}
DEFAULT_LANGUAGE = "plaintext"

# --- Fixed values: extensions scanned by default -----------------------------------------
CODE_EXTENSIONS = [
    ".js", ".jsx", ".ts", ".tsx", ".vue", ".svelte", ".astro",
    ".html", ".htm", ".xml", ".svg", ".css", ".scss", ".sass", ".less",
    ".php", ".asp", ".jsp", ".ejs", ".hbs", ".handlebars",
    ".py", ".java", ".c", ".cpp", ".cxx", ".cc", ".h", ".hpp",
    ".cs", ".vb", ".fs", ".fsx", ".go", ".rs", ".swift", ".kt", ".scala",
    ".rb", ".pl", ".pm", ".tcl", ".lua", ".dart", ".r", ".m", ".matlab",
    ".asm", ".s", ".zig", ".v", ".nim", ".crystal", ".pony",
    ".hs", ".ml", ".elm", ".purs", ".clj", ".cljs", ".scm", ".rkt",
    ".ex", ".exs", ".erl", ".hrl",
    ".graphql", ".gql",
    ".awk", ".sed", ".perl", ".ahk",
    ".makefile", ".mk", ".cmake", ".gradle", ".maven", ".pom",
    ".dockerfile", ".containerfile",
    ".raku", ".p6", ".vala", ".genie", ".boo", ".cobra",
]

# --- Fixed values: exclude patterns applied by default -------------------------------------
EXCLUDES = [
    ".git", ".svn", ".hg", ".bzr",
    "node_modules", "vendor", "packages", "bower_components", "jspm_packages", "lib",
    "dist", "build", "target", "bin", "obj", ".next", ".nuxt", ".output", "public/build",
    ".vscode", ".idea", ".vs", "*.swp", "*.swo", "*~",
    ".DS_Store", "Thumbs.db", "desktop.ini", ".Trashes",
    "*.log", "logs", "log", ".log", "npm-debug.log*", "yarn-debug.log*", "yarn-error.log*",
    ".cache", "__pycache__", ".pytest_cache", ".mypy_cache", ".tox", ".coverage",
    ".nyc_output", "coverage", ".eslintcache", ".stylelintcache", ".sass-cache",
    "tmp", "temp", ".tmp", ".temp",
    "*.zip", "*.tar.gz", "*.tar.bz2", "*.tar", "*.rar", "*.7z", "*.bak", "*.backup",
    ".env", ".env.local", ".env.*",
    ".github/workflows", ".gitlab-ci.yml", ".travis.yml", "Jenkinsfile",
    "Dockerfile.*",
    "tests", "test", "__tests__", "*.test.*", "*cest*", "*.spec.*", "e2e", "*.e2e.*",
    WORK_DIR,
]

# --- Fixed values: path and name word lists -------------------------------------------------
KEY_FILE_PARTS = ["package.json", "main", "index", "app", "config"]
ENTRY_NAMES = ["index", "main", "app", "program", "start", "run", "init", "bootstrap"]
ENTRY_PREFIXES = ["main.", "app.", "index."]
RESERVED_FUNCTIONS = [
    "if", "for", "while", "switch", "try", "catch", "finally", "function", "class", "constructor", "main",
]

# --- Fixed values: component type by words in the file name, then by words in the content ----
COMPONENT_NAME_RULES = [
    (["controller", "handler", "route"], "Controller"),
    (["service", "manager", "provider"], "Service"),
    (["model", "entity", "schema"], "Model"),
    (["config", "settings", "conf"], "Configuration"),
    (["util", "helper", "utils"], "Utility"),
    (["main", "app", "index", "program"], "Main"),
    (["test", "spec"], "Test"),
]
COMPONENT_TEXT_RULES = [
    (["class ", "Class ", "struct "], "Class"),
    (["function ", "def ", "func "], "Function"),
    (["interface ", "protocol "], "Interface"),
]
COMPONENT_DEFAULT = "Component"

# --- Fixed values: function type by words in the lower-cased name ----------------------------
FUNCTION_NAME_RULES = [
    (["get", "fetch", "find", "select"], "getter"),
    (["set", "update", "save", "insert"], "setter"),
    (["handle", "process", "execute"], "handler"),
    (["validate", "check", "verify"], "validator"),
    (["convert", "transform", "format"], "converter"),
]
# the function's name is put in the place of NAME
ASYNC_PATTERN = r"(?i)\bNAME\b.*(?:async|await|Promise|Future|Task)"
ARROW_PATTERN = r"(?i)NAME\s*[:=]\s*[^=]*=>"

# --- Fixed values: node shape by words in the component type ---------------------------------
SHAPE_RULES = [
    (["Main", "Entry"], ("ENTRY", '("', '")')),
    (["Config", "Setting"], ("CONFIG", "[/", "/]")),
    (["Service", "Processor"], ("SERVICE", "{{", "}}")),
    (["Model", "Data"], ("MODEL", "[[", "]]")),
    (["Util", "Helper"], ("UTILITY", "[(", ")]")),
    (["Test"], ("TEST", "{{", "}}")),
]
SHAPE_DEFAULT = ("DEFAULT", '["', '"]')

# --- Fixed values: purpose sentence by words in the path, for code-like content ---------------
PURPOSE_GATE = ["class ", "function ", "def "]
PURPOSE_RULES = [
    (["controller", "route", "handler"], "Handles HTTP requests and routes them to appropriate business logic"),
    (["service", "manager"], "Contains business logic and service operations"),
    (["model", "entity"], "Defines data structures and database models"),
    (["api", "client"], "Handles external API communications"),
    (["util", "helper"], "Provides utility functions and reusable code"),
    (["config", "setting"], "Configuration settings and environment variables"),
    (["test", "spec"], "Contains tests for other modules"),
    (["main", "index", "app"], "Application entry point and main initialization"),
]

# --- Fixed values: extraction patterns (in order; order decides what is seen first) -----------
FUNCTION_PATTERNS = [
    r"(?i)\b(?:function|def|func|fn|method|sub)\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(",
    r"(?i)\b(?:const|let|var|val|var)\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*[:=]\s*(?:\([^)]*\)\s*=>|\([^)]*\)\s*->|function\s*\()",
    r"(?i)(?:public|private|protected|static)?\s*(?:function|def|func|fn|method|sub)\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(",
    r"(?i)([a-zA-Z_][a-zA-Z0-9_]*)\s*\([^)]*\)\s*\{",
]
# (pattern, number of alternative groups)
DEPENDENCY_PATTERNS = [
    (r"(?i)import\s+.*?\s+from\s+['\"]([^'\"]+)['\"]", 1),
    (r"(?i)require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", 1),
    (r"(?i)(?:from\s+([^\s]+)\s+import|import\s+([^\s]+))", 2),
    (r"(?i)(?:include|require|include_once|require_once)\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", 1),
    (r"(?i)#include\s+[<\"]([^>\"]+)[>\"]", 1),
    (r"(?i)import\s+([^\s;]+)", 1),
    (r"(?i)require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)|require\s+['\"]([^'\"]+)['\"]", 2),
    (r"(?i)import\s*\(\s*[\s\S]*?\"([^\"]+)\"[\s\S]*?\s*\)|import\s+\"([^\"]+)\"", 2),
    (r"(?i)use\s+([^;]+)", 1),
]
DATABASE_PATTERNS = [
    r"(?i)\b(?:mysql|postgresql|postgres|mongodb|mongo|sqlite|redis|oracle|sqlserver|mssql|cassandra|couchdb|dynamodb)\b",
    r"(?i)\b(?:database|db|pdo|mysqli|sqlite3|mongoose|prisma|typeorm|sequelize)\b",
    r"(?i)\b(?:connection|connect|pool|client|session)\b.*?\b(?:db|database)\b",
]
API_PATTERNS = [
    r"(?i)\b(?:api|rest|graphql|http|fetch|axios|request|curl|urllib|httpx)\b",
    r"(?i)\b(?:endpoint|route|router|controller)\b",
    r"(?i)(?:https?:\/\/[^\/\s]+|[a-zA-Z_][a-zA-Z0-9_]*\.(?:com|org|net|io|dev|api))",
]
ENTRY_PATTERNS = [
    r"(?i)\b(?:main|run|start|init|bootstrap)\s*\(",
    r"(?i)if\s+__name__\s*==\s*['\"]__main__['\"]",
    r"(?i)public\s+static\s+void\s+main",
    r"(?i)fn\s+main\s*\(",
    r"(?i)int\s+main\s*\(",
    r"(?i)func\s+main\s*\(",
    r"(?i)app\.listen|express\(\)",
    r"(?i)console\.log.*start|server.*start",
]
# (pattern, group that names the connection; 0 is the whole match)
DB_CONNECTION_PATTERNS = [
    (r"(?i)(?:host|server|hostname)=([^&\s;,]{5,})", 1),
    (r"(?i)(?:database|db|dbname)=([^&\s;,]{5,})", 1),
    (r"(?i)(?:mysql|postgresql|mongodb|sqlite|redis):\/\/([^\/\s]{5,})", 1),
    (r"(?i)(?:connection|connect).*?(?:to|@)\s*([^;\s]{5,})", 1),
]
API_CONNECTION_PATTERNS = [
    (r"(?i)(?:https?:\/\/[^\/\s]{8,})", 0),
    (r"(?i)(?:api|service|endpoint)[-_]?url[\s]*[=:][\s]*['\"]([^'\"]{8,})['\"]", 1),
    (r"(?i)(?:base|api)[-_]?url[\s]*[=:][\s]*['\"]([^'\"]{8,})['\"]", 1),
]

# --- Fixed values: reject patterns -------------------------------------------------------------
INVALID_PACKAGE = [
    r"['\")}\];]",
    r"mode with",
    r"^(?:if|else|for|while|return|const|let|var|function|class|def)$",
    r"basename if",
    r"different shapes",
    r"parsing issues",
    r"\s+",
    r"^$",
    r"[<>|?*]",
    r"^\.+$",
    r"^.{100,}$",
]
UNSAFE_FUNCTION = [
    r"(?i)\b(?:password|pwd|pass|secret|key|token|auth|credential|private)\b",
    r"(?i)\b(?:admin|root|superuser|sudo)\b",
    r"(?i)\b(?:encrypt|decrypt|cipher|hash)\b.*\b(?:key|secret|password)\b",
]
UNSAFE_DEPENDENCY = [
    r"(?i)\b(?:secret|key|token|auth|credential|password)\b",
    r"(?i)\b(?:private|internal|confidential)\b",
    r"[a-zA-Z0-9]{32,}",
]
UNSAFE_CONNECTION = [
    r"(?i)\b(?:password|pwd|pass|secret|key|token|auth|credential)\b",
    r"(?i)\b(?:admin|root|superuser)\b",
    r"\b\d{3,}\b",
    r"[a-zA-Z0-9]{32,}",
    r"localhost|127\.0\.0\.1|0\.0\.0\.0",
    r"\.local\b|\.internal\b",
]
UNSAFE_ENDPOINT = [
    r"(?i)\b(?:secret|key|token|auth|credential|password)\b",
    r"[a-zA-Z0-9]{32,}",
    r"localhost|127\.0\.0\.1|0\.0\.0\.0",
    r"\.local\b|\.internal\b",
    r"(?i)\/(?:admin|superuser|root|private|secret)\b",
]
DIAGRAM_KINDS = [
    "flowchart", "graph", "sequenceDiagram", "gantt", "classDiagram", "stateDiagram", "pie", "erDiagram", "journey",
]

# --- Fixed values: masks (pattern -> replacement, in order) ---------------------------------------
CONNECTION_MASKS = [
    (r"(?i)\bpassword\s*=\s*[^&\s,]*", "password=***"),
    (r"(?i)\bsecret\s*=\s*[^&\s,]*", "secret=***"),
    (r"(?i)\bkey\s*=\s*[^&\s,]*", "key=***"),
    (r"(?i)\btoken\s*=\s*[^&\s,]*", "token=***"),
    (r"(?i)\bauth\s*=\s*[^&\s,]*", "auth=***"),
]
ENDPOINT_MASKS = [
    (r"(?i)\/(?:secret|key|token|auth|credential|password)[^/]*", "/***"),
    (r"(?i)[?&](?:secret|key|token|auth|credential|password)=[^&]*", "?***=***"),
]
NAME_MASK = r"(?i)\b(?:secret|key|token|auth|password|credential)\b"
GENERIC_DEPENDENCY = "External Module"
GENERIC_CONNECTION = "Database Connection"
GENERIC_ENDPOINT = "API Endpoint"

# --- Fixed values: blocks inside text ------------------------------------------------------------
DIAGRAM_BLOCK = r"```mermaid\s*([\s\S]*?)```"
MARKDOWN_BLOCK = r"```markdown\s*([\s\S]*?)```"
HTML_TABLE = r"(?i)<table[^>]*>[\s\S]*?<\/table>"
HTML_TAG = r"<[^>]*>"

# --- Fixed values: modes, labels, phrases -----------------------------------------------------------
MODE_ALIASES = {"arch": "architecture"}
PROJECT_MODES = {
    "architecture": ("Project Architecture", "project-architecture"),
    "onboarding": ("Developer Onboarding", "developer-onboarding"),
    "flowchart": ("Project Flowchart", "project-flowchart"),
}
SOURCE_SHOWN_MODES = ["explain", "issues"]
LEVELS = {"expert": "an expert developer"}
LEVEL_DEFAULT = "a beginner developer"
PROMPT_SUFFIX = "\n\nIMPORTANT: Always respond in markdown format."
TRUNCATION_MARK = "\n... (truncated)"
ERROR_PREFIX = "Error generating explanation: "
PROJECT_ERROR_PREFIX = "Error generating {mode} analysis: "
# own wording
SYSTEM_FILE = "Explain source files to the people who have to read them."
SYSTEM_PROJECT = "Describe whole code bases to the people who work on them."
NO_EXPLANATION = "No explanation available."
OFFLINE_FILE = "Offline mode: AI explanation not available. Please provide an API key to get AI-powered explanations."
OFFLINE_PROJECT = (
    "Offline mode: AI analysis not available. Please provide an API key to get AI-powered architecture overview."
)
BYTE_UNITS = ["Bytes", "KB", "MB", "GB", "TB"]
HTML_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")]

# What an import may leave out, in the order in which it is looked for.
IMPORT_EXTENSIONS = [".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", ".cjs", ".json"]
IMPORT_INDEX = "index"
