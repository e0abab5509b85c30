"""The call graph: symbols, resolved edges, fan-in and fan-out, hotspots, god classes, depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators.graph import strong_parts
from corpusloom.session import durable

NODE_TYPES = ("function", "class", "method", "interface")
# Kinds of edges by kinds of call sites.
EDGE_KIND = {"call": "call", "new": "instantiation", "extends": "inherits", "implements": "implements"}


def qualified(parent: Column, name: Column) -> Column:
    """``Parent.name``, or the name alone."""
    return F.when(parent.isNull() | (parent == ""), name).otherwise(F.concat_ws(".", parent, name))


def symbol_nodes(symbols: DataFrame) -> DataFrame:
    """(repo, path, name, kind, exported, line, body_size): one node for each qualified name of a file; the first symbol id stands."""
    rows = symbols.filter(F.col("type").isin(*NODE_TYPES)).select("repo", "path", qualified(F.col("parent_symbol"), F.col("name")).alias("qname"), F.col("name").alias("bare"), "symbol_id", F.col("type").alias("kind"), "exported", "line", "body_size")
    first = rows.groupBy("repo", "path", "qname").agg(F.min_by(F.struct("bare", "symbol_id", "kind", "exported", "line", "body_size"), "symbol_id").alias("v"))
    return first.select("repo", "path", F.col("qname").alias("name"), "v.*")


def _lookup(nodes: DataFrame) -> DataFrame:
    """(repo, path, key, name): qualified names come before bare ones, and of bare ones the first symbol."""
    keys = nodes.select("repo", "path", F.col("name").alias("key"), "name", F.lit(0).alias("p"), "symbol_id").unionByName(nodes.select("repo", "path", F.col("bare").alias("key"), "name", F.lit(1).alias("p"), "symbol_id"))
    return keys.groupBy("repo", "path", "key").agg(F.min_by("name", F.struct("p", "symbol_id")).alias("name"))


def call_edges(calls: DataFrame, nodes: DataFrame, imports: DataFrame) -> DataFrame:
    """(repo, path, source, target_path, target, kind, line, resolved): one edge for each call site.

    A callee is looked up in its own file, then, if its root is an imported name,
    in the file that the last import of that name resolves to. What is found in
    neither stays as ``external:callee``. Calls outside any function come from
    ``<module>``.
    """
    names = imports.filter("resolved_path is not null").select("repo", "path", "import_id", "resolved_path", F.explode("symbols").alias("root"))
    imported = names.groupBy("repo", "path", "root").agg(F.max_by("resolved_path", "import_id").alias("from_path"))
    kind = F.create_map(*[F.lit(x) for pair in EDGE_KIND.items() for x in pair])
    root = F.coalesce("callee_root", "callee")
    member = F.when(F.col("callee_root").isNotNull(), F.expr("substring(callee, length(callee_root) + 2)")).otherwise(F.col("callee"))
    caller = F.when(F.coalesce("caller", F.lit("")) == "", F.lit("<module>")).otherwise(F.col("caller"))
    sites = calls.filter("callee is not null").select("call_id", "repo", "path", caller.alias("source"), "callee", root.alias("root"), member.alias("member"), kind[F.col("kind")].alias("kind"), "line")
    keys = _lookup(nodes)
    here = keys.select("repo", "path", F.col("key").alias("callee"), F.col("name").alias("own"))
    there = keys.select("repo", F.col("path").alias("from_path"), F.col("key").alias("member"), F.col("name").alias("other"))
    met = sites.join(here, ["repo", "path", "callee"], "left").join(imported, ["repo", "path", "root"], "left").join(there, ["repo", "from_path", "member"], "left")
    target = F.coalesce("own", "other")
    outside = F.when(F.col("callee").startswith("external:"), F.col("callee")).otherwise(F.concat(F.lit("external:"), "callee"))
    return met.select(
        "call_id", "repo", "path", "source", F.when(F.col("own").isNotNull(), F.col("path")).when(F.col("other").isNotNull(), F.col("from_path")).alias("target_path"),
        F.coalesce(target, outside).alias("target"), "kind", "line", target.isNotNull().alias("resolved"),
    )


def fan_in_out(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes with ``fan_in`` (resolved edges from others) and ``fan_out`` (all edges)."""
    out = edges.groupBy("repo", "path", F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("fan_out"))
    other = edges.filter("resolved and not (path = target_path and source = target)")
    into = other.groupBy("repo", F.col("target_path").alias("path"), F.col("target").alias("name")).agg(F.count(F.lit(1)).alias("fan_in"))
    on, zero = ["repo", "path", "name"], F.lit(0).cast("long")
    rows = nodes.join(into, on, "left").join(out, on, "left")
    return rows.withColumn("fan_in", F.coalesce("fan_in", zero)).withColumn("fan_out", F.coalesce("fan_out", zero))


def hotspots(metrics: DataFrame, least: int = 10) -> DataFrame:
    """Functions and methods of at least ``least`` callers."""
    return metrics.filter(F.col("kind").isin("function", "method") & (F.col("fan_in") >= least)).select("repo", "path", "name", "kind", "fan_in", "fan_out")


def top_callees(metrics: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` nodes of each repository by fan-in, however low; ties go to the smaller path and name."""
    order = Window.partitionBy("repo").orderBy(F.desc("fan_in"), "path", "name")
    return metrics.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("repo", "rank", "path", "name", "fan_in", "fan_out")


def god_classes(metrics: DataFrame, methods: int = 15, fan_in: int = 20) -> DataFrame:
    """(repo, path, name, methods, total_fan_in): classes of so many methods, or of so many callers with their methods."""
    of = metrics.filter("kind = 'method'").groupBy("repo", "path", F.element_at(F.split("name", r"\."), 1).alias("name")).agg(F.count(F.lit(1)).alias("methods"), F.sum("fan_in").alias("inner"))
    zero = F.lit(0).cast("long")
    rows = metrics.filter("kind = 'class'").join(of, ["repo", "path", "name"], "left")
    rows = rows.select("repo", "path", "name", F.coalesce("methods", zero).alias("methods"), (F.col("fan_in") + F.coalesce("inner", zero)).alias("total_fan_in"))
    return rows.filter((F.col("methods") >= methods) | (F.col("total_fan_in") >= fan_in))


def length_p90(symbols: DataFrame, least: int = 20, share: float = 0.9) -> DataFrame:
    """(repo, functions, p90): the body size at index floor(share * n) of the ascending list, of repositories with ``least`` sizes.

    Sizes are counted first, so that no list of them is sorted in one task.
    """
    sizes = symbols.filter(F.col("type").isin("function", "method") & F.col("body_size").isNotNull()).groupBy("repo", "body_size").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("repo").orderBy("body_size").rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy("repo")
    rows = sizes.withColumn("upto", F.sum("n").over(upto)).withColumn("functions", F.sum("n").over(total))
    rows = rows.filter((F.col("functions") >= least) & (F.col("upto") > F.floor(F.col("functions") * F.lit(share))))
    return rows.groupBy("repo", "functions").agg(F.min("body_size").alias("p90"))


def call_depth(edges: DataFrame) -> DataFrame:
    """(repo, depth): symbols on the longest chain of resolved calls.

    Symbols that call each other in a cycle count as one link of the chain that
    has all of their number. Longest paths over such links are grown one call at
    a time, however long; only the longest to each is kept. Calls of a symbol by
    itself are left out.
    """
    key = lambda path, name: F.xxhash64("repo", path, name)
    calls = edges.filter("resolved and kind = 'call' and not (path = target_path and source = target)")
    steps = durable(calls.select("repo", key("path", "source").alias("s"), key("target_path", "target").alias("t")).distinct())
    parts = durable(strong_parts(steps.select("s", "t")))
    size = parts.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    of = parts.select("v", "part")
    joined = steps.join(of.select(F.col("v").alias("s"), F.col("part").alias("a")), "s", "left").join(of.select(F.col("v").alias("t"), F.col("part").alias("b")), "t", "left")
    links = durable(joined.select("repo", F.coalesce("a", "s").alias("a"), F.coalesce("b", "t").alias("b")).filter("a <> b").distinct())
    ends = joined.select("repo", F.coalesce("a", "s").alias("v")).unionByName(joined.select("repo", F.coalesce("b", "t").alias("v"))).distinct()
    weights = durable(ends.join(size.withColumnRenamed("part", "v"), "v", "left").select("repo", "v", F.coalesce("size", F.lit(1)).cast("int").alias("own")))
    weighted = links.join(weights.select("repo", F.col("v").alias("b"), "own"), ["repo", "b"])
    reach = weights.select("repo", "v", F.col("own").alias("depth"))
    moved = reach
    while True:
        longer = weighted.join(moved.select("repo", F.col("v").alias("a"), "depth"), ["repo", "a"]).groupBy("repo", F.col("b").alias("v")).agg(F.max(F.col("depth") + F.col("own")).alias("longer"))
        both = durable(reach.join(longer, ["repo", "v"], "left").select("repo", "v", F.greatest("depth", "longer").alias("depth"), (F.coalesce("longer", F.lit(0)) > F.col("depth")).alias("moved")))
        reach, moved = both.drop("moved"), both.filter("moved").drop("moved")
        if moved.isEmpty():
            return reach.groupBy("repo").agg(F.max("depth").alias("depth"))
