"""File inventory: which files are looked at, and what they are. Lists are fixed values of the service."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
SKIP_PARTS = ("node_modules", "dist", "build", ".git", "coverage", "package-lock.json", "yarn.lock", "pnpm-lock.yaml")
BINARY = (
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".webp", ".tiff", ".svg", ".zip", ".tar", ".gz", ".tgz", ".bz2", ".rar", ".7z", ".xz", ".exe",
    ".dll", ".so", ".dylib", ".bin", ".o", ".a", ".lib", ".out", ".mp4", ".mkv", ".avi", ".mov", ".flv", ".mp3", ".wav", ".flac", ".ogg", ".ttf",
    ".otf", ".woff", ".woff2", ".eot", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".db", ".sqlite", ".dat",
)
LANGUAGES = {
    ".py": "Python", ".js": "JavaScript", ".jsx": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript", ".java": "Java", ".cs": "C#", ".go": "Go", ".rb": "Ruby", ".php": "PHP",
    ".cpp": "C/C++", ".cc": "C/C++", ".c": "C/C++", ".h": "C/C++", ".hpp": "C/C++", ".rs": "Rust", ".kt": "Kotlin", ".swift": "Swift",
}
CONFIG = (".json", ".yaml", ".yml", ".ini", ".cfg", ".toml", ".xml", ".env")
DOCS = (".md", ".txt", ".rst", ".adoc")
EXCLUDED_DIRS = (
    ".git", "node_modules", "venv", ".venv", "__pycache__", "dist", "build", "coverage", "vendor", "env", "virtualenv", "site-packages", ".next",
    ".nuxt", "out", "target", "obj", "bin", "bower_components", ".terraform", ".idea", ".vscode", "storage", ".pytest_cache",
)


def basename(path: Column) -> Column:
    return F.lower(F.substring_index(path, "/", -1))


def extension(path: Column) -> Column:
    """With its dot, lower case; leading dots of a name are no extension."""
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"^\.*[^.].*(\.[^.]*)$", 1))


def should_skip(path: Column) -> Column:
    """Markers anywhere in the path, generated or minified names, binary extensions."""
    name, low, test = basename(path), F.lower(path), F.lit(False)
    for marker in SKIP_PARTS:
        test = test | low.contains(marker)
    return test | name.contains(".min.") | name.contains("generated") | name.contains("webpack") | name.endswith(".map") | extension(path).isin(*BINARY)


def in_excluded_dir(path: Column) -> Column:
    dirs = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return F.exists(dirs, lambda x: x.isin(*EXCLUDED_DIRS) | x.startswith("."))


def file_type(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext.isin(*LANGUAGES), "source").when(ext.isin(*CONFIG), "config").when(ext.isin(*DOCS), "doc").otherwise("other")


def language(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    kind = file_type(path)
    return F.when(kind == "source", F.element_at(known, extension(path))).when(kind == "config", "Config").when(kind == "doc", "Documentation").otherwise("Other")


def is_test(path: Column) -> Column:
    name = basename(path)
    return ~file_type(path).isin("config", "doc") & (name.contains("test") | name.contains("spec") | path.startswith("tests/") | path.startswith("test/"))


def status(path: Column) -> Column:
    return F.when(in_excluded_dir(path), "excluded: directory").when(should_skip(path), "excluded: generated or binary").when((file_type(path) == "source") & ~is_test(path), "to_analyze").otherwise("inventoried")
