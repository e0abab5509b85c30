"""Rules made from what was mined, and views of rules.

Weights, severities and texts of rules are a matter of taste and are left to the
caller; here are the data steps: which facts become rules, what checks them, how
enhancements are carried over and how rules are laid out as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# What checks a mined pattern: (type, pattern, subject); all others are custom.
CHECKS = {
    "naming-functions-camelcase": ("naming-convention", "camelCase", "function"), "naming-functions-snake-case": ("naming-convention", "snake_case", "function"), "naming-classes-pascalcase": ("naming-convention", "PascalCase", "class"),
    "error-handling-result-pattern": ("pattern-match", "Result<", None), "error-handling-try-catch": ("pattern-match", "try {", None), "error-handling-promise-chain": ("pattern-match", ".catch(", None),
    "exports-named-only": ("no-pattern", "export default", None), "exports-default-preferred": ("pattern-match", "export default", None), "types-prefer-interface": ("pattern-match", "interface ", None), "types-prefer-type-alias": ("pattern-match", "type ", None),
    "imports-relative": ("pattern-match", "from '.", None), "imports-path-alias": ("pattern-match", "from '@/", None), "go-error-handling-err-nil": ("pattern-match", "if err != nil", None), "go-no-panic-in-handlers": ("no-pattern", "panic(", None),
    "go-context-first-param": ("pattern-match", "context.Context", None), "async-await-pattern": ("pattern-match", "async ", None), "nextjs-use-client-directive": ("pattern-match", '"use client"', None), "types-zod-validation": ("pattern-match", "from 'zod'", None),
    "state-management-zustand": ("pattern-match", "from 'zustand'", None), "state-management-redux": ("pattern-match", "from '@reduxjs/toolkit'", None), "state-management-react-query": ("pattern-match", "from '@tanstack/react-query'", None),
}


def pattern_checks(patterns: DataFrame) -> DataFrame:
    """(repo, pattern, prevalence, type, check, subject): what verifies each mined pattern, with its prevalence as threshold."""
    table = F.create_map(*[x for k, v in CHECKS.items() for x in (F.lit(k), F.struct(F.lit(v[0]).alias("type"), F.lit(v[1]).alias("check"), F.lit(v[2]).cast("string").alias("subject")))])
    found = table[F.col("pattern")]
    return patterns.select("repo", "pattern", "prevalence", F.coalesce(found["type"], F.lit("custom")).alias("type"), found["check"].alias("check"), found["subject"].alias("subject"))


def boundary_rules(boundaries: DataFrame) -> DataFrame:
    """(repo, id, source, forbidden, violations): an import constraint for each boundary that is violated."""
    return boundaries.filter("violations > 0").select("repo", F.concat(F.lit("architecture-no-"), "from_layer", F.lit("-to-"), "to_layer").alias("id"), F.concat("from_layer", F.lit("/**")).alias("source"), F.concat("to_layer", F.lit("/**")).alias("forbidden"), "violations")


def distinct_rules(rules: DataFrame) -> DataFrame:
    """The rules, each number once."""
    return rules.dropDuplicates(["rule_no"])


def description(enhanced: Column, core: Column) -> Column:
    """The enhanced description unless it is missing or stale."""
    fresh = enhanced.isNotNull() & ~F.coalesce(enhanced["stale"], F.lit(False))
    return F.when(fresh, F.coalesce(enhanced["description"], core)).otherwise(core)


def needing_enhancement(rules: DataFrame) -> DataFrame:
    """Rules without an enhancement, or with a stale one."""
    return distinct_rules(rules).filter("enhanced is null or coalesce(enhanced.stale, false)")


def prompt_batches(rules: DataFrame, size: int = 10) -> DataFrame:
    """(repo, batch, rules, ids): the rules to enhance, in batches of ``size`` by priority, then number."""
    order = Window.partitionBy("repo").orderBy(F.desc("priority"), "rule_no")
    rows = needing_enhancement(rules).withColumn("batch", F.floor((F.row_number().over(order) - 1) / size))
    return rows.groupBy("repo", "batch").agg(F.count(F.lit(1)).alias("rules"), F.array_sort(F.collect_list("rule_no")).alias("ids"))


def carried_enhancements(old: DataFrame, new: DataFrame) -> DataFrame:
    """(repo, id, description, enhanced): new rules with the enhancement of the old rule of the same id; it is stale if the description changed."""
    before = old.filter("enhanced is not null").select("repo", "id", F.col("description").alias("_was"), F.col("enhanced").alias("_old"))
    stale = F.coalesce(F.col("_old.stale"), F.lit(False)) | (F.col("_was") != F.col("description"))
    kept = F.when(F.col("_old").isNotNull(), F.struct(F.col("_old.description"), F.col("_old.rationale"), stale.alias("stale")))
    return new.select("repo", "id", "description").join(before, ["repo", "id"], "left").select("repo", "id", "description", kept.alias("enhanced"))


def applied_enhancements(rules: DataFrame, answers: DataFrame, files: DataFrame, shortest: int = 10, longest: int = 600) -> DataFrame:
    """(repo, id, outcome, examples): what becomes of each answer (repo, id, description, examples).

    An answer to an unknown rule is ``unknown``, one of another length is
    ``length``, the rest are ``applied`` with the examples whose file exists.
    """
    known = distinct_rules(rules).select("repo", "id").distinct().withColumn("_known", F.lit(True))
    size = F.length("description")
    outcome = F.when(F.col("_known").isNull(), "unknown").when(~size.between(shortest, longest), "length").otherwise("applied")
    rows = answers.join(known, ["repo", "id"], "left").withColumn("outcome", outcome)
    examples = rows.filter("outcome = 'applied'").select("repo", "id", F.explode("examples").alias("path")).join(files.select("repo", "path"), ["repo", "path"], "left_semi")
    kept = examples.groupBy("repo", "id").agg(F.array_sort(F.collect_set("path")).alias("examples"))
    return rows.drop("examples").join(kept, ["repo", "id"], "left").select("repo", "id", "outcome", F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def category_summary(rules: DataFrame) -> DataFrame:
    """(repo, category, rules, critical, evidence): rules and evidence by category."""
    rows = distinct_rules(rules)
    return rows.groupBy("repo", "category").agg(F.count(F.lit(1)).alias("rules"), F.count_if(F.col("severity") == "critical").alias("critical"), F.sum(F.coalesce(F.size("evidence"), F.lit(0))).alias("evidence"))


def markdown(rules: DataFrame, evidence: int = 3) -> DataFrame:
    """(repo, document): each repository's rules as one Markdown text, by category, falling priority and number.

    A rule is a line with its severity and its fresh description, followed by
    its first ``evidence`` files.
    """
    lines = F.transform(F.slice(F.filter(F.coalesce("evidence", F.array().cast("array<struct<file:string,line:int,note:string>>")), lambda e: e["file"].isNotNull()), 1, evidence), lambda e: F.concat(F.lit("\n  - "), e["file"], F.coalesce(F.concat(F.lit(":"), e["line"].cast("string")), F.lit(""))))
    entry = F.concat(F.lit("\n- ["), F.coalesce("severity", F.lit("info")), F.lit("] "), F.coalesce(description(F.col("enhanced"), F.col("description")), F.lit("")), F.array_join(lines, ""))
    rows = distinct_rules(rules).select("repo", F.coalesce("category", F.lit("patterns")).alias("category"), F.struct((-F.coalesce("priority", F.lit(0))).alias("p"), "rule_no", entry.alias("entry")).alias("e"))
    sections = rows.groupBy("repo", "category").agg(F.concat(F.lit("## "), F.first("category"), F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["entry"]), "")).alias("section"))
    return sections.groupBy("repo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("category", "section"))), lambda s: s["section"]), "\n\n").alias("document"))


def rule_details(rules: DataFrame, results: DataFrame, top: int = 3) -> DataFrame:
    """(rule_no, repo, id, status, score, description, evidence): each rule with how it stands and its first evidence as ``file:line``."""
    place = lambda e: F.concat(e["file"], F.coalesce(F.concat(F.lit(":"), e["line"].cast("string")), F.lit("")))
    shown = F.filter(F.transform(F.slice(F.coalesce("evidence", F.array().cast(rules.schema["evidence"].dataType)), 1, top), place), lambda x: x.isNotNull())
    rows = distinct_rules(rules).select("rule_no", description(F.col("enhanced"), F.col("description")).alias("description"), shown.alias("evidence"))
    return results.join(rows, "rule_no").select("rule_no", "repo", "id", "status", "score", "description", "evidence")
