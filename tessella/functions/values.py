"""Fixed values of the source-corpus rules: names, extensions, languages and limits."""

from __future__ import annotations

# They must be exactly these for results to be right.
SKIP_DIRS = (".git", "node_modules", "__pycache__", ".venv", "venv", "env", ".idea", ".vscode", ".next", "dist", "build", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", "egg-info")
SKIP_DIR_ENDING = ".egg-info"
SKIP_EXTENSIONS = (
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg", ".webp", ".mp3", ".mp4", ".wav", ".avi", ".mov", ".mkv",
    ".zip", ".tar", ".gz", ".bz2", ".7z", ".rar", ".exe", ".dll", ".so", ".dylib", ".bin", ".dat",
    ".woff", ".woff2", ".ttf", ".eot", ".otf", ".pyc", ".pyo", ".class", ".o", ".obj",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".db", ".sqlite", ".sqlite3", ".lock",
)
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".jsx": "jsx", ".tsx": "tsx", ".html": "html", ".css": "css",
    ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".md": "markdown", ".txt": "text", ".sh": "shell", ".go": "go",
    ".rs": "rust", ".java": "java", ".c": "c", ".cpp": "cpp", ".h": "c", ".hpp": "cpp", ".rb": "ruby", ".php": "php",
    ".r": "r", ".do": "stata", ".sql": "sql", ".toml": "toml", ".cfg": "ini", ".ini": "ini", ".env": "text",
    ".swift": "swift", ".kt": "kotlin", ".scala": "scala", ".lua": "lua", ".dart": "dart", ".vue": "vue",
    ".svelte": "svelte", ".zig": "zig", ".nim": "nim",
}
CONFIG_NAMES = (
    "requirements.txt", "setup.py", "setup.cfg", "pyproject.toml", "package.json", "Cargo.toml", "go.mod", "Makefile", "Dockerfile",
    "docker-compose.yml", "docker-compose.yaml", ".env.example", "config.py", "config.yaml", "config.json",
    "README.md", "README.rst", "README.txt", "README",
)
#: Languages that the highlighter knows; any other shows as text.
HIGHLIGHTED = (
    "python", "javascript", "typescript", "jsx", "tsx", "html", "css", "json", "yaml", "shell", "go", "rust", "java", "c", "cpp",
    "ruby", "php", "sql", "toml", "markdown", "r", "swift", "kotlin", "scala", "lua", "dart", "vue", "svelte", "zig",
)
MAX_FILE_SIZE = 102_400
MAX_FILES = 500
PREVIEW_LINES = 80
PROMPT_PREVIEW_CHARS = 3000
ANNOTATED_LINES = 200
SNIFFED_BYTES = 1024
CACHE_TTL_SECONDS = 604_800
DAILY_QUOTA = 20
MAX_TREE_MB = 500
