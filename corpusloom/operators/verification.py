"""Rules turned into claims that are checked against the corpus, scored and rolled up.

A claim is checked against the live files of its own repository. Literal
patterns of many rules are looked for in one pass: each content meets the list of
its repository's literals in the scan, and only what it meets goes on, as counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.paths import glob_column
from corpusloom.session import durable

VALID, DEGRADED = 0.9, 0.6
#: Literals in a list that contents are held against, and lists that are broadcast; more are joined.
LITERALS_PER_LIST, BROADCAST_LISTS = 500, 2_000
# Baselines of claim types whose rule names none, and how bad a status is.
BASELINE = {"pattern-match": 0.8, "no-pattern": 0.95, "naming-convention": 0.9, "directory-structure": 0.8, "custom": 0.8}
STATUSES = ("valid", "degraded", "violated", "obsolete")


def claims(rules: DataFrame) -> DataFrame:
    """(rule_no, repo, id, type, assertion, threshold, applies_to, subject, source, forbidden): one claim for each rule.

    A pattern to match without a pattern is a custom claim. Import constraints
    and files that must exist have threshold 1; a threshold of null or 0 takes
    the type's own. A repeated rule counts once.
    """
    v = F.col("verification")
    kind = F.when((v["type"] == "pattern-match") & (F.coalesce(v["pattern"], F.lit("")) == ""), F.lit("custom")).otherwise(v["type"])
    base = F.create_map(*[F.lit(x) for pair in BASELINE.items() for x in pair])
    own = F.when(F.coalesce(v["threshold"], F.lit(0.0)) == 0, F.coalesce(base[kind], F.lit(0.8))).otherwise(v["threshold"])
    threshold = F.when(v["type"].isin("import-constraint", "file-exists"), F.lit(1.0)).otherwise(own)
    assertion = (
        F.when(v["type"] == "import-constraint", F.concat(F.coalesce(v["source"], F.lit("undefined")), F.lit(" -> "), F.coalesce(v["forbidden"], F.lit("undefined"))))
        .when(kind == "custom", F.col("description"))
        .otherwise(F.coalesce(v["pattern"], F.lit("")))
    )
    scope = F.when(kind.isin("pattern-match", "no-pattern"), F.col("applies_to"))
    subject = F.when(kind == "naming-convention", F.coalesce(v["subject"], F.lit("all")))
    rows = rules.select("rule_no", "repo", "id", kind.alias("type"), assertion.alias("assertion"), threshold.alias("threshold"), scope.alias("applies_to"), subject.alias("subject"), v["source"].alias("source"), v["forbidden"].alias("forbidden"))
    return rows.dropDuplicates(["rule_no"])


def claim_scores(claims: DataFrame, files: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """The claims with ``matched``, ``checked`` and ``score``.

    pattern-match: the share of the files in scope that hold the literal, 0 of
    none; no-pattern: the share that do not, 1 of none. import-constraint: 1
    less the violations for each file under the source glob, not below 0, 1 of
    none. naming-convention: the share of symbols that follow it, 1 of none.
    file-exists: 1 or 0. Anything else scores 0.5.
    """
    zero = F.lit(0).cast("long")
    literal = claims.filter(F.col("type").isin("pattern-match", "no-pattern")).select("rule_no", "repo", "assertion", glob_column(F.col("applies_to")).alias("scope"))
    # lists of at most so many literals of a repository; a content meets each list of its own
    many = literal.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    chunk = F.pmod(F.xxhash64("rule_no"), F.ceil(F.col("n") / LITERALS_PER_LIST))
    lists = durable(literal.join(many, "repo").groupBy("repo", chunk.alias("chunk")).agg(F.collect_list(F.struct("rule_no", "assertion", "scope")).alias("rules")))
    texts = files.filter("content is not null").select("repo", "path", "content")
    met = texts.join(F.broadcast(lists) if lists.count() <= BROADCAST_LISTS else lists, "repo")
    checks = F.expr("transform(filter(rules, r -> r.scope is null or path rlike r.scope), r -> struct(r.rule_no as rule_no, contains(content, r.assertion) as hit))")
    by_text = met.select(F.explode(checks).alias("c")).groupBy("c.rule_no").agg(F.count_if("c.hit").alias("matched"), F.count(F.lit(1)).alias("checked"))
    limits = claims.filter("type = 'import-constraint'").select("rule_no", "repo", glob_column(F.coalesce("source", F.lit("undefined"))).alias("from_glob"), glob_column(F.coalesce("forbidden", F.lit("undefined"))).alias("to_glob"))
    scoped = files.select("repo", "path").join(limits, "repo").filter(F.expr("path rlike from_glob"))
    of = imports.select("repo", "path", F.col("source").alias("import_source"), "resolved_path")
    hits = scoped.join(of, ["repo", "path"]).groupBy("rule_no").agg(F.sum(F.expr("if(coalesce(resolved_path rlike to_glob, false), 1, 0) + if(coalesce(import_source rlike to_glob, false), 1, 0)")).alias("matched"))
    by_import = scoped.groupBy("rule_no").agg(F.count(F.lit(1)).alias("checked")).join(hits, "rule_no", "left").select("rule_no", F.coalesce("matched", zero).alias("matched"), "checked")
    kind = F.when(F.col("type").isin("class", "interface", "type", "enum", "struct"), "class").when(F.col("type") == "function", "function").otherwise("other")
    name = F.col("name")
    styles = symbols.groupBy("repo", kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(name.rlike("^[a-z][a-zA-Z0-9]*$")).alias("camelCase"), F.count_if(name.rlike("^[a-z][a-z0-9_]*$")).alias("snake_case"), F.count_if(name.rlike("^[A-Z][a-zA-Z0-9]*$")).alias("PascalCase")
    )
    named = claims.filter("type = 'naming-convention'").select("rule_no", "repo", "assertion", "subject")
    style = F.when(F.col("assertion") == "camelCase", F.col("camelCase")).when(F.col("assertion") == "snake_case", F.col("snake_case")).when(F.col("assertion") == "PascalCase", F.col("PascalCase")).otherwise(zero)
    by_name = named.join(styles, "repo").filter("subject = 'all' or subject = kind").groupBy("rule_no").agg(F.sum(style).alias("matched"), F.sum("n").alias("checked"))
    wanted = claims.filter("type = 'file-exists'").select("rule_no", "repo", F.col("assertion").alias("path"))
    by_file = wanted.join(files.select("repo", "path"), ["repo", "path"], "left_semi").select("rule_no", F.lit(1).cast("long").alias("matched"), F.lit(1).cast("long").alias("checked"))
    counted = by_text.unionByName(by_import).unionByName(by_name).unionByName(by_file)
    rows = claims.join(counted, "rule_no", "left").withColumn("matched", F.coalesce("matched", zero)).withColumn("checked", F.coalesce("checked", zero))
    m, n, t = F.col("matched"), F.col("checked"), F.col("type")
    score = (
        F.when(t == "pattern-match", F.when(n > 0, m / n).otherwise(0.0))
        .when(t == "no-pattern", F.when(n > 0, (n - m) / n).otherwise(1.0))
        .when(t == "import-constraint", F.when(n > 0, F.greatest(F.lit(0.0), 1 - m / n)).otherwise(1.0))
        .when(t == "naming-convention", F.when(n > 0, m / n).otherwise(1.0))
        .when(t == "file-exists", F.least(m, F.lit(1)).cast("double"))
        .otherwise(0.5)
    )
    return rows.withColumn("score", score)


def status_of(score: Column, threshold: Column, kind: Column) -> Column:
    """Status of a score against its baseline: how far it fell from what once held."""
    relative = F.least(F.lit(1.0), score / F.when(threshold > 0, threshold).otherwise(1.0))
    return F.when(relative >= VALID, "valid").when(relative >= DEGRADED, "degraded").when((kind == "file-exists") & (score == 0), "obsolete").otherwise("violated")


def rule_results(scores: DataFrame) -> DataFrame:
    """(rule_no, repo, id, status, score): the mean score and the worst status of each rule's claims."""
    rank = F.array_position(F.array(*map(F.lit, STATUSES)), status_of(F.col("score"), F.col("threshold"), F.col("type")))
    rows = scores.groupBy("rule_no", "repo", "id").agg(F.max(rank).alias("worst"), F.avg("score").alias("score"))
    return rows.select("rule_no", "repo", "id", F.element_at(F.array(*map(F.lit, STATUSES)), F.col("worst").cast("int")).alias("status"), "score")


def health(results: DataFrame) -> DataFrame:
    """(repo, rules, valid, degraded, violated, obsolete, score, color): 100 for each valid rule and 60 for each degraded one, on average."""
    counts = results.groupBy("repo").agg(F.count(F.lit(1)).alias("rules"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    counts = counts.withColumn("score", F.floor((F.col("valid") * 100 + F.col("degraded") * 60) / F.col("rules") + 0.5))
    return counts.withColumn("color", badge_color(F.col("score")))


def badge_color(score: Column) -> Column:
    """Color of a health score."""
    return F.when(score >= 90, "brightgreen").when(score >= 75, "green").when(score >= 60, "yellow").when(score >= 40, "orange").otherwise("red")
