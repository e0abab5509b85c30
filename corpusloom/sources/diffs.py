"""Unified diffs as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_IMPORT = r"^\s*import\s+|^\s*from\s+|require\s*\(|^\s*use\s+"
_SYMBOL = r"(?:async\s+)?function\s+(\w+)|class\s+(\w+)|(?:const|let)\s+(\w+)\s*=.*=>"


def added_file_diffs(files: DataFrame) -> DataFrame:
    """(repo, path, diff): each content as the diff that adds its file."""
    lines = F.split(F.regexp_replace("content", r"\n\z", ""), "\n")
    head = F.concat(F.lit("diff --git a/"), "path", F.lit(" b/"), "path", F.lit("\nnew file mode 100644\n--- /dev/null\n+++ b/"), "path", F.lit("\n@@ -0,0 +1,"), F.size(lines), F.lit(" @@\n"))
    return files.filter("content is not null and content <> ''").select("repo", "path", F.concat(head, F.array_join(F.transform(lines, lambda x: F.concat(F.lit("+"), x)), "\n")).alias("diff"))


def diff_sections(diffs: DataFrame, *keys: str) -> DataFrame:
    """(*keys, section, new_path, old_path, status, body): the files of each diff text, from 0.

    A changed name is ``renamed`` whatever else is said; status words count
    wherever they stand in the section.
    """
    parts = F.filter(F.split("diff", r"(?m)^diff --git "), lambda s: s != "")
    rows = diffs.select(*keys, F.posexplode(parts).alias("section", "body"))
    head = F.substring_index("body", "\n", 1)
    old, new = F.regexp_extract(head, r"a/(.+?)\s+b/(.+)", 1), F.regexp_extract(head, r"a/(.+?)\s+b/(.+)", 2)
    status = F.when(F.col("old_path") != F.col("new_path"), "renamed").when(F.col("body").contains("deleted file mode"), "deleted").when(F.col("body").contains("new file mode"), "added").otherwise("modified")
    return rows.withColumn("old_path", old).withColumn("new_path", new).filter("new_path <> ''").withColumn("status", status)


def diff_lines(sections: DataFrame, *keys: str) -> DataFrame:
    """(*keys, section, kind, number, content): added and removed lines with their numbers.

    Lines are numbered by counting from their hunk's start. ``+++`` and ``---``
    lines count as neither added, removed nor context.
    """
    rows = sections.select(*keys, "section", F.posexplode(F.split("body", "\n")).alias("at", "line")).filter("at > 0")
    line = F.col("line")
    hunk = F.regexp_extract(line, r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@", 1) != ""
    kind = (
        F.when(hunk, "hunk").when(line.startswith("+") & ~line.startswith("+++"), "added").when(line.startswith("-") & ~line.startswith("---"), "removed").when(line.startswith("\\"), "none").otherwise("context")
    )
    rows = rows.withColumn("kind", kind)
    window = Window.partitionBy(*keys, "section").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("hunk", F.sum((F.col("kind") == "hunk").cast("int")).over(window))
    start = F.when(F.col("kind") == "hunk", F.struct(F.regexp_extract(line, r"^@@ -(\d+)", 1).cast("int").alias("o"), F.regexp_extract(line, r"^@@ -\S+ \+(\d+)", 1).cast("int").alias("n")))
    within = Window.partitionBy(*keys, "section", "hunk").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.last(start, ignorenulls=True).over(window))
    new = F.coalesce(F.sum(F.col("kind").isin("added", "context").cast("int")).over(within), F.lit(0))
    old = F.coalesce(F.sum(F.col("kind").isin("removed", "context").cast("int")).over(within), F.lit(0))
    rows = rows.withColumn("number", F.when(F.col("kind") == "added", F.coalesce("start.n", F.lit(0)) + new).otherwise(F.coalesce("start.o", F.lit(0)) + old))
    return rows.filter("kind in ('added', 'removed')").select(*keys, "section", "kind", F.col("number").cast("int").alias("number"), F.substring("line", 2, 1 << 20).alias("content"))


def diff_files(diffs: DataFrame, *keys: str) -> DataFrame:
    """(*keys, path, old_path, status, added, removed, added_imports, removed_imports, added_symbols) of each file of each diff."""
    sections = diff_sections(diffs, *keys)
    lines = diff_lines(sections, *keys)
    content, added = F.col("content"), F.col("kind") == "added"
    symbol = F.coalesce(*[F.when(F.regexp_extract("content", _SYMBOL, g) != "", F.regexp_extract("content", _SYMBOL, g)) for g in (1, 2, 3)])
    counted = lines.groupBy(*keys, "section").agg(
        F.count_if(added).alias("added"), F.count_if(~added).alias("removed"), F.count_if(added & content.rlike(_IMPORT)).alias("added_imports"), F.count_if(~added & content.rlike(_IMPORT)).alias("removed_imports"), F.count_if(added & symbol.isNotNull()).alias("added_symbols")
    )
    zero = F.lit(0).cast("long")
    names = ["added", "removed", "added_imports", "removed_imports", "added_symbols"]
    rows = sections.join(counted, [*keys, "section"], "left")
    kept = [k for k in keys if k != "path"]
    return rows.select(*kept, F.col("new_path").alias("path"), F.when(F.col("status") == "renamed", F.col("old_path")).alias("old_path"), "status", *[F.coalesce(n, zero).alias(n) for n in names])
