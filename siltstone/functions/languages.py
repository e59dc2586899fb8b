"""Languages by file extension, and what in each is a unit of code."""

from __future__ import annotations

_BY_LANGUAGE = {
    "c": ".c .h",
    "cpp": ".cpp .cc .cxx .hpp",
    "go": ".go",
    "java": ".java",
    "javascript": ".js .jsx",
    "kotlin": ".kt .kts",
    "python": ".py",
    "ruby": ".rb",
    "rust": ".rs",
    "swift": ".swift",
    "typescript": ".ts .tsx",
}
EXTENSIONS = {e: name for name, all_ in _BY_LANGUAGE.items() for e in all_.split()}
CANONICAL = {name: all_.split()[0] for name, all_ in _BY_LANGUAGE.items()}


def extension(path: str) -> str:
    name = path.replace("\\", "/").rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[1].lower() if "." in name else ""


def language_of(path: str) -> str | None:
    """None: no grammar for it."""
    return EXTENSIONS.get(extension(path))


def fallback_language(path: str) -> str:
    return extension(path).removeprefix(".") or "text"


def canonical_extension(language: str) -> str:
    return CANONICAL.get(language.strip().lower(), "")
