"""Which files are source files, and in which language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from srcstrata.functions.text import file_name

# --- fixed values -----------------------------------------------------------
LANGUAGE_EXTENSIONS = {
    "Java": ["java"],
    "Kotlin": ["kt", "kts"],
    "JavaScript": ["js", "jsx", "mjs", "cjs"],
    "TypeScript": ["ts", "tsx"],
    "Python": ["py"],
    "Go": ["go"],
    "Ruby": ["rb"],
    "PHP": ["php"],
    "C#": ["cs"],
    "C/C++": ["cpp", "cc", "cxx", "hpp", "h", "c"],
    "Rust": ["rs"],
    "Swift": ["swift"],
}
SKIPPED_NAMES = [".git", ".gradle", ".idea", ".vscode", "build", "dist", "node_modules", "out",
                 "target", "coverage", ".venv", "venv", "__pycache__"]
MAX_SOURCE_BYTES = 1_000_000


def detect_language(path: Column) -> Column:
    """Language by lower-cased extension, null when unknown.

    A name without a dot is its own extension, so a file called ``py`` is Python.
    """
    extension = F.regexp_extract(F.lower(file_name(path)), r"[^.]*\z", 0)
    rule = None
    for language, extensions in LANGUAGE_EXTENSIONS.items():
        test = extension.isin(extensions)
        rule = F.when(test, F.lit(language)) if rule is None else rule.when(test, F.lit(language))
    return rule


def is_skipped(path: Column) -> Column:
    """True where any part of the relative path, file name included, is a skipped name."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(n) for n in SKIPPED_NAMES]))


def within_size_cap(size: Column, cap: int = MAX_SOURCE_BYTES) -> Column:
    return F.coalesce(size <= cap, F.lit(False))
