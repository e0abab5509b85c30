"""One project from its sources alone: what the tables of a scan hold, read from the contents, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import paths
from corpusloom.operators import corpus, extract, graph, mining, rules
from corpusloom.session import durable

#: Folders that an alias with this prefix stands for, where no configuration file names others.
ALIASES = {"@/": "src"}


def analyze(files: DataFrame, exclude: list[str] | None = None) -> dict[str, DataFrame]:
    """files, symbols, imports, edges, nodes, layers, boundaries, patterns, checks and rules of (repo, path, content).

    Files are those that a scan keeps; imports, exports and symbols are read from
    their lines, imports are resolved, and the graph, its layers and the
    conventions follow. Null and empty contents are no files.
    """
    path = paths.norm_path(F.col("path"))
    rows = files.filter("path is not null and content is not null and content <> ''").select("repo", path.alias("path"), "content")
    numbered = rows.select("repo", "path", paths.language(F.col("path")).alias("language"), F.xxhash64("repo", "path").alias("file_id"), F.lit(0).cast("long").alias("ord"), "content")
    whole = numbered.filter(paths.is_source(F.col("path")) & ~paths.matches_any(F.col("path"), exclude or []) & (F.octet_length("content") <= corpus.MOST_BYTES)).dropDuplicates(["repo", "path"])
    known = whole.select("repo", "path", "language", "file_id")
    symbols = durable(extract.line_symbols(whole).join(known.select("file_id", "repo", "path"), "file_id").select("repo", "path", "name", "type", "exported", "line"))
    named = extract.import_names(whole).select("repo", "path", "source", F.col("names").alias("symbols"), "is_default", "is_namespace", "line")
    imports = durable(named.withColumn("import_id", F.xxhash64("repo", "path", "line")).withColumn("resolved_path", F.lit(None).cast("string")))
    config = numbered.filter(paths.basename(F.col("path")).isin("go.mod", "tsconfig.json", "jsconfig.json"))
    own = graph.resolved_edges(imports, known, config)
    by_prefix = graph.resolve_imports(imports.filter(F.col("source").startswith("@/")), known, ALIASES).select("repo", F.col("path").alias("source"), "target").filter("source <> target")
    edges = durable(own.unionByName(by_prefix).distinct())
    nodes = graph.file_nodes(edges, known)
    layers = durable(graph.file_layers(known, imports, symbols))
    boundaries = graph.layer_boundaries(edges, layers)
    patterns = durable(mining.mine_patterns(whole, symbols, imports))
    return {
        "files": known, "symbols": symbols, "imports": imports, "exports": extract.exported_names(whole), "edges": edges, "nodes": nodes, "layers": layers,
        "boundaries": boundaries, "patterns": patterns, "checks": rules.pattern_checks(patterns), "rules": rules.boundary_rules(boundaries),
    }


def summary(parts: dict[str, DataFrame]) -> DataFrame:
    """(repo, files, symbols, imports, exports, edges, boundaries, patterns) of ``analyze``: how many of each a repository has."""
    names = ("files", "symbols", "imports", "exports", "edges", "boundaries", "patterns")
    rows = None
    for name in names:
        part = parts[name].select("repo", F.lit(name).alias("kind"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("repo").agg(*[F.count_if(F.col("kind") == name).alias(name) for name in names])
