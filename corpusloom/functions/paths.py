"""Path and language expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by extension.
LANGUAGE_OF = {
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "pyi": "python", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "kts": "kotlin", "rb": "ruby", "php": "php", "cs": "csharp", "cpp": "cpp", "cc": "cpp",
    "cxx": "cpp", "hpp": "cpp", "c": "c", "h": "c", "swift": "swift", "scala": "scala", "vue": "vue", "svelte": "svelte", "json": "json", "yaml": "yaml", "yml": "yaml", "md": "markdown",
    "html": "html", "css": "css", "scss": "scss", "sql": "sql", "sh": "shell",
}

# Extensions of source files.
SOURCE_EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "go", "rs", "java", "kt", "rb", "php", "cs", "cpp", "c", "h", "swift", "vue", "svelte")


def norm_path(path: Column) -> Column:
    r"""``\`` as ``/``, repeated ``/`` once, without leading ``./``."""
    return F.regexp_replace(F.regexp_replace(path, r"[\\/]+", "/"), r"^(\./)+", "")


def extension(path: Column) -> Column:
    """Lower-case extension, or ''."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def basename(path: Column) -> Column:
    """Last segment."""
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """Last segment without its extension."""
    return F.regexp_replace(basename(path), r"(.)\.[^.]*$", "$1")


def dirname(path: Column) -> Column:
    """All but the last segment, or ''."""
    return F.regexp_replace(F.regexp_extract(path, r"^(.*/)?[^/]*$", 1), "/$", "")


def language(path: Column) -> Column:
    """Language of a path's extension, or ``unknown``."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGE_OF.items() for x in pair])
    return F.coalesce(table[extension(path)], F.lit("unknown"))


def is_source(path: Column) -> Column:
    """Whether the extension is one of source code."""
    return extension(path).isin(*SOURCE_EXTENSIONS)


def glob_regex(pattern: str) -> str:
    """The anchored regular expression of a glob: ``**`` any, ``*`` within a segment, ``?`` one; all else stays as it is."""
    out = pattern.replace("**", "\0").replace("*", "[^/]*").replace("?", ".").replace("\0", ".*")
    return f"^{out}$"


def glob_column(pattern: Column) -> Column:
    """``glob_regex`` of a column of patterns."""
    out = F.replace(pattern, F.lit("**"), F.lit("\u0001"))
    out = F.replace(F.replace(out, F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("."))
    return F.concat(F.lit("^"), F.replace(out, F.lit("\u0001"), F.lit(".*")), F.lit("$"))


def matches_any(path: Column, patterns: list[str]) -> Column:
    """Whether a path matches any glob; an invalid pattern raises."""
    for p in patterns:
        re.compile(glob_regex(p))
    return F.lit(False) if not patterns else path.rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns))


def gitignore_globs(lines: list[str]) -> list[str]:
    """Globs of ignore lines: ``x/`` is ``x/**``, a bare name ``**/name``, others stay; comments, blanks and negations give none."""
    out = []
    for line in (x.strip() for x in lines):
        if not line or line[0] in "#!":
            continue
        out.append(line + "**" if line.endswith("/") else line if "/" in line or "*" in line else "**/" + line)
    return out
