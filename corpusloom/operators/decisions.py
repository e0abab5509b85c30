"""Decisions found in commit messages, decision records and code comments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.identifiers import slug
from corpusloom.operators.extract import source_lines

# Words of commit messages that tell a decision.
KEYWORDS = ("refactor:", "arch:", "decision:", "migrate:", "adopt:", "architecture", "convention", "pattern", "adopt", "switch to", "replace", "standardize", "enforce", "breaking change", "deprecat", "migrat")
_PREFIX = r"(?i)^(refactor|feat|fix|chore|arch|breaking):\s*"
_COMMENT = r"(?i)(?://|#)\s*(?:Decision|Why|ADR|Note):"


def commit_decisions(documents: DataFrame) -> DataFrame:
    """(id, doc_id, repo, title, decided_at, kind) of commit documents whose first line holds a decision word."""
    first = F.trim(F.substring_index("text", "\n", 1))
    rows = documents.filter("kind = 'commit' and text is not null").select("doc_id", F.col("source").alias("repo"), first.alias("message"), "created_at").filter("message <> ''")
    low = F.lower("message")
    hit = F.lit(False)
    for k in KEYWORDS:
        hit = hit | low.contains(k)
    rows = rows.filter(hit)
    return rows.select(F.concat(F.lit("commit-"), "doc_id", F.lit("-"), slug(F.col("message"))).alias("id"), "doc_id", "repo", F.regexp_replace("message", _PREFIX, "").alias("title"), F.col("created_at").alias("decided_at"), F.lit("commit").alias("kind"))


def record_decisions(documents: DataFrame) -> DataFrame:
    """(id, doc_id, repo, title, decided_at, kind, status, rationale) of decision records: title line, the word after ``## Status``, the first 500 characters."""
    rows = documents.filter("kind = 'adr' and text is not null and trim(text) <> ''").withColumn("t", F.regexp_replace("text", "\r\n", "\n"))
    title = F.trim(F.regexp_extract("t", r"(?m)^#[ \t]+(.+)", 1))
    status = F.lower(F.regexp_extract("t", r"(?i)## Status\s*\n\s*(\w+)", 1))
    name = F.concat(F.lit("adr-"), "doc_id")
    return rows.select(name.alias("id"), "doc_id", F.col("source").alias("repo"), F.when(title == "", name).otherwise(title).alias("title"), F.col("created_at").alias("decided_at"), F.lit("adr").alias("kind"), F.when(status == "", "active").otherwise(status).alias("status"), F.substring("t", 1, 500).alias("rationale"))


def comment_decisions(rules: DataFrame, files: DataFrame) -> DataFrame:
    """(id, rule_no, repo, path, line, title): decision comments in the files that rules give as evidence; each file is read once.

    ``files`` is ``live_files(files, "content")``. Paths with ``*`` are no files.
    """
    cited = rules.select("rule_no", "repo", F.explode("evidence").alias("e")).select("rule_no", "repo", F.col("e.file").alias("path")).filter("path is not null and not contains(path, '*')").distinct()
    lines = source_lines(files.join(cited.select("repo", "path").distinct(), ["repo", "path"], "left_semi")).filter(F.col("text").rlike(_COMMENT))
    text = F.regexp_replace("text", r"(?i)^[/#\s]*(Decision|Why|ADR|Note):\s*", "")
    rows = lines.select("repo", "path", "line", text.alias("t")).join(cited, ["repo", "path"])
    return rows.select(F.concat(F.lit("comment-"), "rule_no", F.lit("-"), "line").alias("id"), "rule_no", "repo", "path", "line", F.substring("t", 1, 80).alias("title"))


def merged(existing: DataFrame, found: DataFrame) -> DataFrame:
    """(id, repo, title, decided_at, kind): existing decisions and those found under new ids; of one new id the earliest stands."""
    columns = ["id", "repo", "title", "decided_at", "kind"]
    first = found.groupBy("id").agg(F.min_by(F.struct("repo", "title", "decided_at", "kind"), F.struct("decided_at", "title", "kind")).alias("v")).select("id", "v.*")
    return existing.select(*columns).unionByName(first.join(existing, "id", "left_anti").select(*columns))


def linked_rules(decisions: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, rule_no): rules of a decision's repository whose id holds the decision's, or the other way round, or whose category stands in its title."""
    r = rules.select("rule_no", "repo", F.col("id").alias("rule_id"), "category").dropDuplicates(["rule_no"])
    both = decisions.select("id", "repo", F.lower("title").alias("title")).join(r, "repo")
    return both.filter(F.expr("contains(rule_id, id) or contains(id, rule_id) or contains(title, category)")).select("id", "rule_no").distinct()


def timeline(decisions: DataFrame) -> DataFrame:
    """(repo, month, decisions, first_title): decisions by month, with the first of each."""
    return decisions.groupBy("repo", F.date_format("decided_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("decisions"), F.min_by("title", F.struct("decided_at", "id")).alias("first_title"))
