"""Expressions over file paths: names, ancestors, ignore rules, languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import col, strip

# A path is ignored when one of these is found in it.
IGNORE_PATTERNS = [
    r"\.git$", r"\.gitignore$", r"\.gitmodules$",
    r"\.env$", r"\.env\.*",
    r"node_modules$", r"vendor$", r"__pycache__$", r"\.venv$", r"venv$",
    r"build$", r"dist$", r"target$", r"out$", r"\.next$", r"\.nuxt$",
    r"package-lock\.json$", r"yarn\.lock$", r"poetry\.lock$", r"Pipfile\.lock$",
    r"requirements\.txt$", r"pyproject\.toml$", r"package\.json$",
    r"\.eslintrc$", r"\.prettierrc$", r"tsconfig\.json$", r"babel\.config\.js$",
    r"webpack\.config\.js$",
    r"\.vscode$", r"\.idea$", r"\.eclipse$", r"\.vs$",
    r"\.log$", r"logs$", r"tmp$",
    r"README\.md$", r"LICENSE$", r"\.(png|jpg|jpeg|gif|svg|ico)$", r"\.(mp3|mp4|wav)$",
    r"\.(class|jar|pyc|pyo|pyd)$", r"\.(exe|dll|so|dylib)$",
    r"\.DS_Store$", r"Thumbs\.db$",
]

# File name endings that are kept.
ALLOWED_EXTENSIONS = [
    ".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".scala", ".rb", ".go", ".cpp", ".c",
    ".rs", ".kt", ".swift", ".php", ".cs", ".vb", ".fs", ".csproj", ".vbproj", ".fsproj",
    ".sln", ".json", ".txt", ".xlsx", ".xlsm", ".doc", ".md", ".sql", ".html",
]

# Extension to language.
LANGUAGES = {
    ".py": "Python", ".js": "JavaScript", ".jsx": "JavaScript", ".ts": "TypeScript",
    ".tsx": "TypeScript", ".java": "Java", ".scala": "Scala", ".rb": "Ruby", ".go": "Go",
    ".cpp": "C++", ".c": "C", ".rs": "Rust", ".kt": "Kotlin", ".swift": "Swift",
    ".php": "PHP", ".cs": "C#", ".sql": "SQL", ".html": "HTML",
}

# Extensions whose text is analysed as code.
CODE_EXTENSIONS = [
    ".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".scala", ".rb", ".go", ".cpp", ".c",
    ".rs", ".kt", ".swift", ".php", ".cs",
]

# Workbook extensions and the language each is tagged with.
WORKBOOK_LANGUAGES = {".xlsx": "Excel", ".xlsm": "VBA", ".xls": "VBA", ".xlsb": "VBA"}


def file_name(path: Column | str) -> Column:
    return F.substring_index(col(path), "/", -1)


def parent(path: Column | str) -> Column:
    """The containing folder, or null for a top-level name."""
    path = col(path)
    cut = F.length(path) - F.length(file_name(path)) - 1
    return F.when(cut > 0, path.substr(F.lit(1), cut))


def extension(path: Column | str) -> Column:
    """Last dot and what follows, lower case; leading dots do not start one."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.]\.*(\.[^.]*)$", 1))


def stem(path: Column | str) -> Column:
    name = file_name(path)
    return name.substr(F.lit(1), F.length(name) - F.length(extension(path)))


def ancestors(path: Column | str) -> Column:
    """``a/b/c`` becomes ``[a, a/b, a/b/c]``."""
    parts = F.split(col(path), "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    )


def ignore_regex() -> str:
    """One pattern for a path and all its ancestors.

    An ancestor ends at a slash, so testing every ancestor for an
    end-anchored pattern is the same as testing the whole path for that
    pattern followed by a slash or the end.
    """
    ends = [p[:-1] + "(/|$)" if p.endswith("$") else p for p in IGNORE_PATTERNS]
    return "|".join(ends + [r"(^|/)\.[^/]*"])


def is_ignored(path: Column | str) -> Column:
    return col(path).rlike(ignore_regex())


def _ends_with_any(path: Column, extensions: list[str]) -> Column:
    names = "|".join(e[1:] for e in extensions)
    return F.lower(path).rlike(rf"\.({names})$")


def is_allowed(path: Column | str) -> Column:
    """Kept by the extension list (style sheets are not on it)."""
    return _ends_with_any(col(path), ALLOWED_EXTENSIONS)


def is_workbook(path: Column | str) -> Column:
    return extension(path).isin(list(WORKBOOK_LANGUAGES))


def is_code(path: Column | str) -> Column:
    return extension(path).isin(CODE_EXTENSIONS)


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    flat = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*flat), key), F.lit(""))


def language(path: Column | str) -> Column:
    return _lookup(LANGUAGES, extension(path))


def workbook_language(path: Column | str) -> Column:
    return _lookup(WORKBOOK_LANGUAGES, extension(path))


def clean_folder_name(name: Column | str, drop_main: bool = False) -> Column:
    """A safe display name; ``drop_main`` also cuts a trailing ``main`` and keeps the last part."""
    cleaned = F.btrim(col(name), F.lit("/\\- "))
    if drop_main:
        cleaned = F.regexp_replace(cleaned, "main/?$", "")
    cleaned = F.rtrim(cleaned, F.lit("-"))
    if drop_main:
        cleaned = file_name(cleaned)
    cleaned = F.regexp_replace(cleaned, r"(?U)[^\w\-]", "_")
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("project-root"))


def is_github_url(url: Column | str) -> Column:
    host = F.lower(F.try_parse_url(strip(url), F.lit("HOST")))
    return F.coalesce(host == "github.com", F.lit(False))


def is_windows_path(path: Column | str) -> Column:
    return col(path).rlike(r'^[A-Za-z]:\\(?:[^\\/:*?"<>|\r\n]+\\)*[^\\/:*?"<>|\r\n]*$')
