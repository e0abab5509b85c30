"""Imports, exports, symbols and marker comments read from the lines of source files.

Contents are exploded to numbered lines once, and every language is a list of
line patterns in order: of each list the first that matches a line decides. All
stays in columns; a line belongs to one output row at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Line patterns; group 1 is the import's source. (language, kind, pattern)
_Q = "['\"]([^'\"]+)['\"]"
IMPORTS = [
    ("script", "named", r"^import\s+(?:type\s+)?(?:\w+\s*,\s*)?\{[^}]*\}\s+from\s+" + _Q),
    ("script", "default", r"^import\s+(?:type\s+)?\w+\s+from\s+" + _Q),
    ("script", "namespace", r"^import\s+\*\s+as\s+\w+\s+from\s+" + _Q),
    ("script", "effect", r"^import\s+" + _Q),
    ("script", "require", r"(?:const|let|var)\s+(?:\{[^}]*\}|\w+)\s*=\s*require\s*\(\s*" + _Q + r"\s*\)"),
    ("python", "from", r"^from\s+([\w.]+)\s+import\s+"),
    ("python", "module", r"^import\s+([\w.]+)"),
    ("java", "module", r"^import\s+(?:static\s+)?([\w.*]+)\s*;"),
    ("rust", "module", r"^(?:pub\s+)?use\s+([^;{]+?)(?:::\{.*)?;"),
    ("go", "module", r'^import\s+(?:[\w.]+\s+)?"([^"]+)"'),
    ("go", "block", r'^(?:[\w.]+\s+)?"([^"]+)"$'),
    ("csharp", "module", r"^using\s+(?:static\s+)?([\w.]+)\s*;"),
    ("ruby", "require", r"^require(?:_relative)?\s+" + _Q),
    ("php", "module", r"^use\s+([\w\\]+)(?:\s+as\s+\w+)?;"),
]
# Group 1 is the symbol's name. (language, type, pattern)
SYMBOLS = [
    ("script", "function", r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)"),
    ("script", "function", r"^(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s+)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>"),
    ("script", "class", r"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"),
    ("script", "interface", r"^(?:export\s+)?interface\s+(\w+)"),
    ("script", "type", r"^(?:export\s+)?type\s+(\w+)\s*(?:<[^>]*>)?\s*="),
    ("script", "enum", r"^(?:export\s+)?(?:const\s+)?enum\s+(\w+)"),
    ("python", "function", r"^(?:async\s+)?def\s+(\w+)\s*\("),
    ("python", "class", r"^class\s+(\w+)"),
    ("go", "function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*[\[(]"),
    ("go", "class", r"^type\s+(\w+)\s+struct\b"),
    ("go", "interface", r"^type\s+(\w+)\s+interface\b"),
    ("java", "class", r"^(?:public\s+|private\s+|protected\s+)?(?:static\s+|final\s+|abstract\s+)*class\s+(\w+)"),
    ("java", "interface", r"^(?:public\s+|private\s+|protected\s+)?interface\s+(\w+)"),
    ("java", "method", r"^(?:public|private|protected)\s+(?:static\s+|final\s+|abstract\s+|synchronized\s+)*[\w<>\[\],.]+\s+(\w+)\s*\("),
    ("rust", "function", r"^(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+(\w+)"),
    ("rust", "class", r"^(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(\w+)"),
    ("csharp", "class", r"^(?:public\s+|private\s+|protected\s+|internal\s+)?(?:abstract\s+|sealed\s+|static\s+|partial\s+)*class\s+(\w+)"),
    ("csharp", "interface", r"^(?:public\s+|private\s+|protected\s+|internal\s+)?interface\s+(\w+)"),
    ("csharp", "method", r"^(?:public|private|protected|internal)\s+(?:static\s+|async\s+|override\s+|virtual\s+)*[\w<>\[\],.?]+\s+(\w+)\s*\("),
    ("ruby", "class", r"^class\s+(\w+)"),
    ("ruby", "function", r"^def\s+(\w+)"),
    ("php", "class", r"^(?:abstract\s+)?class\s+(\w+)"),
    ("php", "function", r"^(?:(?:public|private|protected|static)\s+)*function\s+(\w+)"),
]
EXPORTED = r"^export\b|^pub\b|^public\b"
EXPORTS = [
    ("script", "default", r"^export\s+default\s+(?:(?:async\s+)?(?:class|function|const|let|var)\s+)?(\w*)"),
    ("script", "named", r"^export\s+(?:async\s+)?(?:abstract\s+)?(?:const|let|var|function|class|interface|type|enum)\s+(\w+)"),
]
MARKER = r"^(?://|#)\s*(TODO|FIXME|NOTE|Decision|Why|HACK|ADR):"


def family(language: Column) -> Column:
    """The name of a language's pattern list."""
    return F.when(language.isin("typescript", "javascript"), "script").otherwise(language)


def source_lines(files: DataFrame) -> DataFrame:
    """(file_id, repo, path, family, line, text): the trimmed lines of each content, from 1; blank ones are left out."""
    lines = files.filter("content is not null and content <> ''").select("file_id", "repo", "path", family(F.col("language")).alias("family"), F.posexplode(F.split("content", "\n")).alias("p", "raw"))
    return lines.select("file_id", "repo", "path", "family", (F.col("p") + 1).alias("line"), F.regexp_replace("raw", r"^\s+|\s+$", "").alias("text")).filter("text <> ''")


def _first(patterns: list[tuple[str, str, str]], text: Column) -> tuple[Column, Column]:
    """Kind and group 1 of the first pattern of the line's family that matches."""
    kind, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for of, name, pattern in reversed(patterns):
        hit = (F.col("family") == of) & text.rlike(pattern)
        kind, value = F.when(hit, F.lit(name)).otherwise(kind), F.when(hit, F.regexp_extract(text, pattern, 1)).otherwise(value)
    return kind, value


def line_imports(files: DataFrame) -> DataFrame:
    """(file_id, line, kind, source): one import for each line that holds one; imports over several lines are not seen.

    In Go a line of nothing but a quoted path is an import only inside an import block.
    """
    return _import_lines(files).select("file_id", "line", "kind", "source")


def import_names(files: DataFrame) -> DataFrame:
    """(file_id, repo, path, line, source, names, is_default, is_namespace): the imports of ``line_imports`` with the names that they bring in.

    Renamed ones count by the name that they have at their source. An import of
    the whole module brings in the module's last name; one for its effects brings
    in none.
    """
    t, kind, family_ = F.col("text"), F.col("kind"), F.col("family")
    none = F.array().cast("array<string>")
    listed = lambda x: F.filter(F.transform(F.split(x, ","), lambda n: F.regexp_replace(F.trim(n), r"\s+as\s+.*$", "")), lambda n: n != "")
    one = lambda x: F.when(x != "", F.array(x)).otherwise(none)
    braces = listed(F.regexp_extract(t, r"\{([^}]*)\}", 1))
    default = F.when(kind == "require", F.regexp_extract(t, r"(?:const|let|var)\s+(\w+)\s*=\s*require", 1)).otherwise(F.regexp_extract(t, r"^import\s+(?:type\s+)?(\w+)\s*(?:,|\s+from)", 1))
    from_ = F.trim(F.regexp_extract(t, r"^from\s+[\w.]+\s+import\s+(.+)$", 1))
    renamed = F.regexp_extract(t, r'^(?:import\s+)?(\w+)\s+"', 1)
    last = F.regexp_extract("source", r"(\w*)$", 1)
    script = family_ == "script"
    names = (
        F.when(kind == "namespace", one(F.regexp_extract(t, r"\*\s+as\s+(\w+)", 1)))
        .when((kind == "effect") | (family_ == "ruby"), none)
        .when(script, F.concat(one(default), braces))
        .when(kind == "from", F.filter(listed(from_), lambda n: n != "*"))
        .when(family_ == "go", F.array(F.when((renamed != "") & (renamed != "import"), renamed).otherwise(F.regexp_extract("source", "([^/]*)$", 1))))
        .when((family_ == "rust") & t.contains("{"), braces)
        .otherwise(F.array(last))
    )
    is_default = F.when(script, (default != "") & (kind != "namespace")).otherwise(((family_ == "python") & (kind == "module")) | (family_ == "ruby"))
    return _import_lines(files).select("file_id", "repo", "path", "line", "source", names.alias("names"), is_default.alias("is_default"), ((kind == "namespace") | ((kind == "from") & (from_ == "*"))).alias("is_namespace"))


def _import_lines(files: DataFrame) -> DataFrame:
    kind, source = _first(IMPORTS, F.col("text"))
    rows = source_lines(files).select("file_id", "repo", "path", "family", "line", "text", kind.alias("kind"), source.alias("source"))
    blocks = rows.filter("family = 'go' and text rlike '^(import\\\\s*\\\\($|\\\\)$)'").groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("line", F.col("text").startswith("import").alias("opens")))).alias("marks"))
    rows = rows.filter("kind is not null").join(blocks, "file_id", "left")
    last = F.element_at(F.filter("marks", lambda m: m["line"] < F.col("line")), -1)["opens"]
    inside = F.when(F.size(F.filter(F.coalesce("marks", F.array().cast("array<struct<line:int,opens:boolean>>")), lambda m: m["line"] < F.col("line"))) > 0, last).otherwise(F.lit(False))
    return rows.filter((F.col("kind") != "block") | inside)


def line_symbols(files: DataFrame) -> DataFrame:
    """(file_id, line, type, name, exported): one symbol for each line that declares one."""
    kind, name = _first(SYMBOLS, F.col("text"))
    rows = source_lines(files).select("file_id", "family", "line", "text", kind.alias("type"), name.alias("name")).filter("type is not null")
    by_case = F.col("name").rlike("^[A-Z]")
    exported = F.when(F.col("family") == "go", by_case).when(F.col("family") == "python", ~F.col("name").startswith("_")).when(F.col("family").isin("ruby", "php"), F.lit(True)).otherwise(F.col("text").rlike(EXPORTED))
    return rows.select("file_id", "line", "type", "name", exported.alias("exported"))


def line_exports(files: DataFrame) -> DataFrame:
    """(file_id, line, type, name): exports of scripts; a default export without a name is called ``default``."""
    kind, name = _first(EXPORTS, F.col("text"))
    rows = source_lines(files).select("file_id", "family", "line", kind.alias("type"), name.alias("name")).filter("type is not null")
    return rows.select("file_id", "line", "type", F.when(F.col("name") == "", F.lit("default")).otherwise(F.col("name")).alias("name"))


def exported_names(files: DataFrame) -> DataFrame:
    """(file_id, repo, path, line, type, name): what each file exports, in any language.

    Scripts export by declaration, as default or as a list in braces; Go exports
    functions and types with a capital, Rust what is ``pub``, Java and C# their
    classes, Python the names in ``__all__``, whose line is 0.
    """
    lines = source_lines(files)
    kind, name = _first(EXPORTS, F.col("text"))
    own = lines.withColumn("type", kind).withColumn("name", name).filter("type is not null").withColumn("name", F.when(F.col("name") == "", F.lit("default")).otherwise(F.col("name")))
    listed = F.filter(F.transform(F.split(F.regexp_extract("text", r"^export\s+\{([^}]*)\}", 1), ","), lambda n: F.regexp_replace(F.trim(n), r"\s+as\s+.*$", "")), lambda n: n != "")
    in_braces = lines.filter("family = 'script'").select("*", F.lit("named").alias("type"), F.explode(listed).alias("name"))
    what, declared = _first(SYMBOLS, F.col("text"))
    symbols = lines.filter(F.col("family").isin("go", "rust", "java", "csharp")).withColumn("what", what).withColumn("name", declared).filter("what is not null")
    open_ = F.when(F.col("family") == "go", F.col("name").rlike("^[A-Z]")).when(F.col("family") == "rust", F.col("text").startswith("pub")).otherwise(F.col("what") == "class")
    columns = ["file_id", "repo", "path", "line", "type", "name"]
    of_symbols = symbols.filter(open_).withColumn("type", F.lit("named"))
    every = F.regexp_extract("content", r"__all__\s*=\s*\[([^\]]*)\]", 1)
    of_python = files.filter("language = 'python' and content is not null").select("file_id", "repo", "path", F.lit(0).alias("line"), F.lit("named").alias("type"), F.explode(F.regexp_extract_all(every, F.lit("['\"](\\w+)['\"]"), 1)).alias("name"))
    return own.select(*columns).unionByName(in_braces.select(*columns)).unionByName(of_symbols.select(*columns)).unionByName(of_python)


def marker_comments(files: DataFrame) -> DataFrame:
    """(file_id, repo, path, line, marker, text): comments that begin with a marker word."""
    rows = source_lines(files).filter(F.col("text").rlike(MARKER))
    return rows.select("file_id", "repo", "path", "line", F.regexp_extract("text", MARKER, 1).alias("marker"), "text")
