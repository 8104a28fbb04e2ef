"""Fixed values that must equal the catalogued application's rules.

Everything in this module is data, stated plainly and in its natural
order.  The operators turn these lists into small broadcast tables or
column expressions; no logic lives here.
"""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------

# File names whose presence at a folder's root marks it as a project.
PROJECT_MARKERS = [
    ".git", "package.json", "pyproject.toml", "setup.py", "setup.cfg",
    "Cargo.toml", "go.mod", "Makefile", "CMakeLists.txt",
    "pom.xml", "build.gradle", "Gemfile", "composer.json",
    "mix.exs", "deno.json", "bun.lockb", "gleam.toml",
]

# Language by (lower-cased) file suffix.
LANGUAGE_EXTENSIONS = [
    (".py", "python"), (".pyw", "python"), (".pyi", "python"),
    (".js", "javascript"), (".mjs", "javascript"), (".cjs", "javascript"),
    (".ts", "typescript"), (".mts", "typescript"), (".cts", "typescript"),
    (".jsx", "javascript"), (".tsx", "typescript"),
    (".rs", "rust"), (".go", "go"), (".java", "java"), (".rb", "ruby"),
    (".php", "php"), (".c", "c"), (".cpp", "cpp"), (".cc", "cpp"),
    (".cxx", "cpp"), (".h", "c"), (".hpp", "cpp"), (".hxx", "cpp"),
    (".cs", "csharp"), (".swift", "swift"), (".kt", "kotlin"),
    (".kts", "kotlin"), (".scala", "scala"), (".sh", "shell"),
    (".bash", "shell"), (".zsh", "shell"), (".fish", "shell"),
    (".lua", "lua"), (".r", "r"), (".R", "r"), (".jl", "julia"),
    (".ex", "elixir"), (".exs", "elixir"), (".erl", "erlang"),
    (".hs", "haskell"), (".ml", "ocaml"), (".mli", "ocaml"),
    (".clj", "clojure"), (".cljs", "clojure"), (".cljc", "clojure"),
    (".elm", "elm"), (".vue", "vue"), (".svelte", "svelte"),
    (".dart", "dart"), (".nim", "nim"), (".zig", "zig"), (".v", "v"),
    (".cr", "crystal"), (".pl", "perl"), (".pm", "perl"),
    (".raku", "raku"), (".fs", "fsharp"), (".fsx", "fsharp"),
    (".gleam", "gleam"),
]

# Directory name patterns (shell globs) pruned from every walk.
EXCLUDE_DIRS = [
    "node_modules", "venv", ".venv", "__pycache__",
    ".git", "dist", "build", ".tox", "eggs", "*.egg-info",
    ".next", ".nuxt", "target", "vendor", ".cargo",
]

# Generated files ignored when dating code.  Change detection uses the
# first three only.
GENERATED_FILES = ["METADATA.json", "README.md", "USAGE.md", "readme.md"]
CHANGE_IGNORED_FILES = ["METADATA.json", "README.md", "USAGE.md"]

# Extra suffixes that count as code when dating a project.
CODE_DATE_EXTRA_EXTENSIONS = [".json", ".yaml", ".yml", ".toml", ".xml", ".html", ".css", ".sql"]

# README candidates in priority order.
README_NAMES = ["README.md", "README.rst", "README.txt", "README", "readme.md"]

# Deep search: file globs searched (case-sensitive suffix match).
GREP_INCLUDE = [
    "*.py", "*.js", "*.ts", "*.jsx", "*.tsx",
    "*.java", "*.c", "*.cpp", "*.h", "*.hpp",
    "*.go", "*.rs", "*.rb", "*.php",
    "*.html", "*.css", "*.scss", "*.sass",
    "*.json", "*.yaml", "*.yml", "*.toml",
    "*.xml", "*.md", "*.txt", "*.sh",
    "*.sql", "*.lua", "*.swift", "*.kt",
    "*.scala", "*.r", "*.R", "*.jl",
]

# Deep search: language label by lower-cased suffix (its own map).
GREP_LANGUAGE = [
    (".py", "python"), (".js", "javascript"), (".ts", "typescript"),
    (".jsx", "javascript"), (".tsx", "typescript"), (".java", "java"),
    (".c", "c"), (".cpp", "cpp"), (".h", "c"), (".hpp", "cpp"),
    (".go", "go"), (".rs", "rust"), (".rb", "ruby"), (".php", "php"),
    (".html", "html"), (".css", "css"), (".json", "json"),
    (".yaml", "yaml"), (".yml", "yaml"), (".md", "markdown"),
    (".sh", "bash"), (".sql", "sql"),
]

# Documentation kinds a project can be missing, in generation order.
DOC_KINDS = ["metadata", "readme", "usage"]
DOC_FILE_NAMES = [("metadata", "METADATA.json"), ("readme", "README.md"), ("usage", "USAGE.md")]

# Search defaults.
HYBRID_FTS_WEIGHT = 0.3
HYBRID_SEMANTIC_WEIGHT = 0.7
BM25_K1 = 1.2
BM25_B = 0.75
VIEWABLE_MAX_BYTES = 1048576
RECENT_COMMITS = 15
BROWSE_PAGE_SIZE = 50
README_MIN_CHARS = 50
NO_README_TEXT = "No README available"

# Truncation lengths for vector metadata and documents.
README_EXCERPT_CHARS = 1000
SHORT_DESCRIPTION_CHARS = 500
PROJECT_DOCUMENT_CHARS = 5000
MODULE_DOCUMENT_CHARS = 2000
VECTOR_KEYWORDS = 20

# --- end of fixed values ----------------------------------------------------

# The largest limits that a served request may ask for.
GREP_MAX_LIMIT = 500
GREP_MAX_CONTEXT = 5
LIST_MAX_LIMIT = 500
HISTORY_MAX_LIMIT = 500
SCAN_LOG_MAX_LIMIT = 100
