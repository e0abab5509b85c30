"""Changes held against the graph: new edges, boundaries, cycles, complexity, rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_edges(before: DataFrame, after: DataFrame, layers: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(repo, source, target, crosses_boundary, creates_cycle): edges that ``before`` does not have.

    An edge crosses a boundary that is known and not allowed; it creates a cycle
    of two if its reverse is in ``before``.
    """
    fresh = after.join(before, ["repo", "source", "target"], "left_anti")
    back = before.select("repo", F.col("target").alias("source"), F.col("source").alias("target"), F.lit(True).alias("back"))
    of = layers.select("repo", "path", "layer")
    rows = (
        fresh.join(of.select("repo", F.col("path").alias("source"), F.col("layer").alias("from_layer")), ["repo", "source"], "left")
        .join(of.select("repo", F.col("path").alias("target"), F.col("layer").alias("to_layer")), ["repo", "target"], "left")
        .join(boundaries.select("repo", "from_layer", "to_layer", "allowed"), ["repo", "from_layer", "to_layer"], "left")
        .join(back, ["repo", "source", "target"], "left")
    )
    return rows.select("repo", "source", "target", F.coalesce(~F.col("allowed"), F.lit(False)).alias("crosses_boundary"), F.coalesce("back", F.lit(False)).alias("creates_cycle"))


def complexity_changes(fresh: DataFrame, nodes: DataFrame, limit: int = 8) -> DataFrame:
    """(repo, path, before, after, risk): how new edges raise the degree of the files that they leave; ``risk`` from ``limit`` on."""
    more = fresh.groupBy("repo", F.col("source").alias("path")).agg(F.count(F.lit(1)).alias("more"))
    rows = nodes.join(more, ["repo", "path"])
    after = F.col("degree") + F.col("more")
    return rows.select("repo", "path", F.col("degree").alias("before"), after.alias("after"), (after >= limit).alias("risk"))


def rule_hits(fresh: DataFrame, rules: DataFrame) -> DataFrame:
    """(repo, rule_no, source, target): new edges whose target holds a rule's forbidden path, its ``/**`` or ``/*`` taken off once.

    Rules meet only the edges of their own repository.
    """
    bare = F.regexp_replace(F.regexp_replace("verification.forbidden", r"^(.*?)/\*\*", "$1"), r"^(.*?)/\*", "$1")
    limits = rules.filter("verification.type = 'import-constraint' and verification.forbidden is not null").select("rule_no", "repo", bare.alias("forbidden")).distinct()
    return fresh.join(limits, "repo").filter(F.expr("contains(target, forbidden)")).select("repo", "rule_no", "source", "target")


def violations(fresh: DataFrame, changes: DataFrame, hits: DataFrame) -> DataFrame:
    """(repo, type, severity, path): all violations of a change."""
    parts = [
        fresh.filter("crosses_boundary").select("repo", F.lit("boundary-violation").alias("type"), F.lit("violation").alias("severity"), F.col("source").alias("path")),
        fresh.filter("creates_cycle").select("repo", F.lit("circular-dependency").alias("type"), F.lit("violation").alias("severity"), F.col("source").alias("path")),
        changes.filter("risk").select("repo", F.lit("god-object").alias("type"), F.lit("warning").alias("severity"), "path"),
        hits.select("repo", F.lit("rule-violation").alias("type"), F.lit("violation").alias("severity"), F.col("source").alias("path")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows


def summary(found: DataFrame, changed: DataFrame) -> DataFrame:
    """(repo, files, violations, warnings, clean): changed files of each repository, and those that nothing was found in, not below 0."""
    counts = found.groupBy("repo").agg(F.count_if(F.col("severity") == "violation").alias("violations"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    files = changed.select("repo", "path").distinct().groupBy("repo").agg(F.count(F.lit(1)).alias("files"))
    zero = F.lit(0).cast("long")
    rows = files.join(counts, "repo", "left").select("repo", "files", F.coalesce("violations", zero).alias("violations"), F.coalesce("warnings", zero).alias("warnings"))
    return rows.withColumn("clean", F.greatest(zero, F.col("files") - F.col("violations") - F.col("warnings")))


def similar_suggestions(similar: DataFrame, least: float = 0.3) -> DataFrame:
    """(repo, path, like, cosine): for each new file the most similar one, if it is similar enough; takes ``similar_files`` of the new files."""
    return similar.filter((F.col("rank") == 1) & (F.col("cosine") >= least)).select("repo", F.col("query").alias("path"), F.col("path").alias("like"), "cosine")


def model_files(fresh: DataFrame, nodes: DataFrame, layers: DataFrame, below: int = 6) -> DataFrame:
    """(repo, source, target, look_at): for each new edge that crosses a boundary or closes a cycle, a service of few edges that shows how it is done, by path."""
    services = nodes.filter((F.col("degree") > 0) & (F.col("degree") < below)).join(layers.filter("layer = 'service'").select("repo", "path"), ["repo", "path"], "left_semi")
    return fresh.filter("crosses_boundary or creates_cycle").join(services.groupBy("repo").agg(F.min("path").alias("look_at")), "repo").select("repo", "source", "target", "look_at")
