"""The import graph: resolution, centrality, layers, boundaries, cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import paths
from corpusloom.session import durable

# Endings tried on an import's base path, in this order; index files come after all of them.
EXTENSIONS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".py", ".go", ".rs", ".java", ".rb", ".php")
INDEX_FILES = ("index.ts", "index.js", "index.tsx", "index.jsx", "__init__.py", "mod.rs")

# Layers of folder names, and the order in which layers may import each other.
LAYER_DIRS = {
    "controller": ["controller", "controllers"],
    "api": ["routes", "api", "endpoints", "handlers", "middleware", "interceptors", "guards", "pipes"],
    "service": ["services", "service", "usecases", "use-cases"],
    "model": ["models", "model", "entities", "schemas", "types", "interfaces", "dtos"],
    "data": ["repositories", "repository", "data", "db", "database", "dal", "store", "stores", "state", "reducers", "actions"],
    "ui": ["components", "views", "pages", "ui", "screens", "layouts", "widgets", "hooks"],
    "utility": ["utils", "util", "helpers", "lib", "shared", "common", "decorators"],
    "config": ["config", "configs", "configuration", "settings", "constants"],
    "test": ["tests", "test", "__tests__", "spec"],
}
LAYER_RANK = {"api": 0, "controller": 0, "ui": 0, "service": 1, "data": 2, "model": 2, "utility": 3, "config": 3, "test": -1}
#: Steps along the edges in one job; share of the edges up to which peeling goes on; paths for each edge up to which they are listed.
STEPS, WORTH_PEELING, MOST_PATHS = 8, 0.9, 30


def _joined(base: Column, rest: Column) -> Column:
    """``base/rest`` with ``.`` and ``..`` segments worked off; a ``..`` above the root stays as one."""
    steps = F.filter(F.split(F.concat_ws("/", base, rest), "/"), lambda s: ~s.isin("", "."))
    walked = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda acc, s: F.when((s == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )
    return F.array_join(walked, "/")


def resolve_imports(imports: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """(import_id, repo, path, source, target): the file that a relative or aliased import names.

    ``files`` has repo and path; ``aliases`` maps a prefix such as ``@/`` to a
    folder such as ``src``, longer prefixes first. Of the candidate paths the
    first in the order of endings that exists is taken. Imports of anything else
    do not resolve and do not appear.
    """
    s = F.col("source")
    base = F.when(s.startswith(".") | s.startswith("/"), _joined(paths.dirname(F.col("path")), s))
    for prefix, folder in sorted((aliases or {}).items(), key=lambda x: len(x[0])):
        base = F.when(s.startswith(prefix), _joined(F.lit(folder), F.substring(s, len(prefix) + 1, 1 << 20))).otherwise(base)
    bare = F.regexp_replace("base", r"\.(js|jsx|mjs|cjs)$", "")
    bases = F.when(bare == F.col("base"), F.array("base")).otherwise(F.array(F.col("base"), bare))
    with_ending = F.flatten(F.transform(bases, lambda b: F.transform(F.array(*map(F.lit, EXTENSIONS)), lambda e: F.concat(b, e))))
    with_index = F.flatten(F.transform(bases, lambda b: F.transform(F.array(*map(F.lit, INDEX_FILES)), lambda e: F.concat(b, F.lit("/"), e))))
    tried = (
        imports.withColumn("base", base)
        .filter("base is not null")
        .select("import_id", "repo", "path", "source", F.posexplode(F.concat(with_ending, with_index)).alias("rank", "candidate"))
    )
    known = files.select("repo", F.col("path").alias("candidate"))
    return tried.join(known, ["repo", "candidate"]).groupBy("import_id", "repo", "path", "source").agg(F.min_by("candidate", "rank").alias("target"))


def import_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, source, target): distinct import edges between files of a repository, without self-edges."""
    known = files.select("repo", "path")
    edges = imports.filter("resolved_path is not null and path <> resolved_path").select("repo", F.col("path").alias("source"), F.col("resolved_path").alias("target")).distinct()
    return edges.join(known.withColumnRenamed("path", "source"), ["repo", "source"], "left_semi").join(known.withColumnRenamed("path", "target"), ["repo", "target"], "left_semi").select("repo", "source", "target")


def file_nodes(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, path, in_degree, out_degree, degree, betweenness): ``betweenness`` is in times out over the repository's edges."""
    ends = edges.select("repo", F.col("source").alias("path"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select("repo", F.col("target").alias("path"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    degrees = ends.groupBy("repo", "path").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    size = edges.groupBy("repo").agg(F.count(F.lit(1)).alias("edges"))
    zero = F.lit(0).cast("long")
    nodes = files.select("repo", "path").join(degrees, ["repo", "path"], "left").join(size, "repo", "left")
    i, o = F.coalesce("in_degree", zero), F.coalesce("out_degree", zero)
    return nodes.select("repo", "path", i.alias("in_degree"), o.alias("out_degree"), (i + o).alias("degree"), (i * o * F.lit(1.0) / F.greatest(F.coalesce("edges", zero), F.lit(1))).alias("betweenness"))


def resolved_edges(imports: DataFrame, files: DataFrame, contents: DataFrame) -> DataFrame:
    """(repo, source, target): import edges by ``resolved_path``, and where that is null by the resolver.

    Relative imports are tried with all endings, aliased ones by the script
    configuration files among ``contents``, Go packages by its ``go.mod`` files.
    """
    known = import_edges(imports, files)
    open_ = imports.filter("resolved_path is null and source is not null")
    tried = resolve_imports(aliased_imports(open_, script_aliases(contents)).select("import_id", "repo", "path", "source"), files)
    # an aliased import is resolved from the root; its own file is the one it stands in
    own = open_.select("import_id", F.col("path").alias("own"))
    packages = resolve_packages(open_.select("import_id", "repo", "path", "source"), files, go_modules(contents)).select("import_id", "repo", "target")
    found = tried.select("import_id", "repo", "target").unionByName(packages).join(own, "import_id").select("repo", F.col("own").alias("source"), "target").filter("source <> target")
    inside = found.join(files.select("repo", F.col("path").alias("source")), ["repo", "source"], "left_semi")
    return known.unionByName(inside).distinct()


def hub_files(nodes: DataFrame, least: int = 8) -> DataFrame:
    """The nodes of at least ``least`` edges."""
    return nodes.filter(F.col("degree") >= least)


def top_nodes(nodes: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` nodes of each repository by degree; ties go to the smaller path."""
    order = Window.partitionBy("repo").orderBy(F.desc("degree"), "path")
    return nodes.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def file_layers(files: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo, path, layer, confidence): the architectural layer of each file.

    The first folder that names a layer decides at 0.8. File names come after it
    and each later rule wins: test at 0.9, controller, service, model and
    repository at 0.85, with the highest confidence kept. A file still unknown is
    a service at 0.5 if it imports from data or model folders, configuration at
    0.7 by its name, a utility at 0.4 with more than three exported functions.
    """
    layer_of = F.create_map(*[F.lit(x) for layer, names in LAYER_DIRS.items() for n in names for x in (n, layer)])
    parts = F.transform(F.split("path", "/"), lambda p: F.lower(p))
    by_dir = F.element_at(F.filter(F.transform(parts, lambda p: layer_of[p]), lambda x: x.isNotNull()), 1)
    rows = files.select("repo", "path", F.when(F.size(F.filter(parts, lambda p: layer_of[p].isNotNull())) > 0, by_dir).alias("dir_layer"), F.lower(paths.stem(F.col("path"))).alias("b"))
    b = F.col("b")
    named = [
        ("test", 0.9, b.contains(".test") | b.contains(".spec") | b.contains("_test")),
        ("controller", 0.85, b.contains("controller")),
        ("service", 0.85, b.contains("service")),
        ("model", 0.85, b.contains(".model") | b.contains(".entity") | b.contains(".schema")),
        ("data", 0.85, b.contains(".repo") | b.contains("repository")),
    ]
    layer, confidence = F.col("dir_layer"), F.when(F.col("dir_layer").isNotNull(), F.lit(0.8)).otherwise(F.lit(0.0))
    for name, sure, hit in named:
        layer = F.when(hit, F.lit(name)).otherwise(layer)
        confidence = F.when(hit, F.greatest(confidence, F.lit(sure))).otherwise(confidence)
    inner = [n for k in ("data", "model") for n in LAYER_DIRS[k]]
    hint = F.lit(False)
    for n in inner:
        hint = hint | F.col("source").contains(n)
    hints = imports.filter(F.col("source").isNotNull()).groupBy("repo", "path").agg(F.max(hint).alias("inner"))
    exported = symbols.filter("exported and type = 'function'").groupBy("repo", "path").agg(F.count(F.lit(1)).alias("exported"))
    rows = rows.withColumn("layer", layer).withColumn("confidence", confidence).join(hints, ["repo", "path"], "left").join(exported, ["repo", "path"], "left")
    unknown = F.col("layer").isNull()
    many, is_config, is_service = F.coalesce("exported", F.lit(0)) > 3, b.isin("config", "constants", "env"), F.coalesce("inner", F.lit(False))
    final = F.when(~unknown, F.col("layer")).when(is_service, "service").when(many, "utility").when(is_config, "config").otherwise("unknown")
    sure = F.when(~unknown, F.col("confidence")).when(is_service, 0.5).when(many, 0.4).when(is_config, 0.7).otherwise(0.0)
    return rows.select("repo", "path", final.alias("layer"), sure.alias("confidence"))


def layer_boundaries(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """(repo, from_layer, to_layer, edges, violations, allowed) of edges between different known layers.

    An edge violates if its source's rank is above its target's; see ``LAYER_RANK``.
    """
    known = layers.filter("layer <> 'unknown'").select("repo", "path", "layer")
    rank = F.create_map(*[F.lit(x) for pair in LAYER_RANK.items() for x in pair])
    met = (
        edges.join(known.select("repo", F.col("path").alias("source"), F.col("layer").alias("from_layer")), ["repo", "source"])
        .join(known.select("repo", F.col("path").alias("target"), F.col("layer").alias("to_layer")), ["repo", "target"])
        .filter("from_layer <> to_layer")
    )
    bad = F.count_if(rank[F.col("from_layer")] > rank[F.col("to_layer")])
    return met.groupBy("repo", "from_layer", "to_layer").agg(F.count(F.lit(1)).alias("edges"), bad.alias("violations")).withColumn("allowed", F.col("violations") == 0)


def files_on_cycles(edges: DataFrame) -> DataFrame:
    """(repo, path): files on an import cycle of any length."""
    numbered = durable(edges.select("repo", "source", "target", F.xxhash64("repo", "source").alias("s"), F.xxhash64("repo", "target").alias("t")))
    names = numbered.select("repo", F.col("source").alias("path"), F.col("s").alias("v")).unionByName(numbered.select("repo", F.col("target").alias("path"), F.col("t").alias("v"))).distinct()
    return names.join(strong_parts(numbered.select("s", "t")).select("v"), "v", "left_semi").select("repo", "path")


def strong_parts(edges: DataFrame) -> DataFrame:
    """(v, part): the strongly connected parts of two vertices or more of the edges (s, t), each named by its largest vertex.

    Vertices without an edge in or out are peeled off. By colouring, every vertex
    takes the largest number that reaches it along the edges, so that one that
    keeps its own is the root of its part; what reaches the root backward within
    its colour is the part. Parts found, and edges between colours, are taken out.
    What is left is closed under paths of 1, 2, 4 ... edges where that stays small,
    and is coloured again where not, until no edge is left.
    """
    e, on = _peeled(edges), None
    while not e.isEmpty():
        colours = _grown(e, e.select(F.col("s").alias("v")).unionByName(e.select(F.col("t").alias("v"))).distinct().withColumn("c", F.col("v")))
        same = durable(e.join(colours.select(F.col("v").alias("s"), F.col("c").alias("cs")), "s").join(colours.select(F.col("v").alias("t"), F.col("c").alias("ct")), "t").filter("cs = ct").select("s", "t"))
        part = _grown(same.select(F.col("t").alias("s"), F.col("s").alias("t")), colours.filter("v = c"))
        many = part.groupBy("c").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("c")
        found = part.join(many, "c", "left_semi").select("v", F.col("c").alias("part"))
        on = found if on is None else on.unionByName(found)
        gone = part.select("v")
        e = _peeled(same.join(gone.withColumnRenamed("v", "s"), "s", "left_anti").join(gone.withColumnRenamed("v", "t"), "t", "left_anti"))
        reached = _closed(e)
        if reached is not None:
            back = reached.select(F.col("s").alias("t"), F.col("t").alias("s"))
            both = reached.join(back, ["s", "t"]).groupBy(F.col("s").alias("v")).agg(F.max("t").alias("part"))
            return on.unionByName(both)
    return edges.select(F.col("s").alias("v"), F.col("t").alias("part")).limit(0) if on is None else on


def _peeled(e: DataFrame) -> DataFrame:
    """The edges (s, t) without those that no cycle can use: whose ends lack an edge in or an edge out. It stops where little is left to peel."""
    e, size = durable(e), None
    while True:
        now = e.count()
        if not now or (size is not None and now > WORTH_PEELING * size):
            return e
        size = now
        into, out = e.select(F.col("t").alias("s")).distinct(), e.select(F.col("s").alias("t")).distinct()
        e = durable(e.join(into, "s", "left_semi").join(out, "t", "left_semi").select("s", "t"))


def _closed(e: DataFrame) -> DataFrame | None:
    """All (s, t) of which t is reached from s; None once they outnumber the edges by ``MOST_PATHS``."""
    edges = e.count()
    reached, before = e, -1
    while (now := reached.count()) != before:
        if now > MOST_PATHS * max(edges, 1000):
            return None
        before = now
        reached = durable(reached.unionByName(reached.join(reached.select(F.col("s").alias("t"), F.col("t").alias("far")), "t").select("s", F.col("far").alias("t"))).distinct())
    return reached


def _grown(e: DataFrame, start: DataFrame) -> DataFrame:
    """(v, c): the values of ``start`` spread along the edges (s, t) until none changes; a vertex keeps its largest."""
    values = durable(start)
    # a vertex sends its value to itself as well
    sends = durable(e.unionByName(values.select(F.col("v").alias("s"), F.col("v").alias("t"))).unionByName(e.select(F.col("t").alias("s"), "t")).distinct())
    before = None
    while True:
        for _ in range(STEPS):
            values = sends.join(values.withColumnRenamed("v", "s"), "s").groupBy(F.col("t").alias("v")).agg(F.max("c").alias("c"))
        values = durable(values)
        now = values.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "c") % F.lit(1 << 40))).first()
        if now == before:
            return values
        before = now


def dependencies(edges: DataFrame, nodes: DataFrame, layers: DataFrame) -> DataFrame:
    """(repo, path, layer, degree, imports, imported_by): both directions of each file's edges as sorted lists."""
    out = edges.groupBy("repo", F.col("source").alias("path")).agg(F.array_sort(F.collect_list("target")).alias("imports"))
    into = edges.groupBy("repo", F.col("target").alias("path")).agg(F.array_sort(F.collect_list("source")).alias("imported_by"))
    none = F.array().cast("array<string>")
    rows = nodes.filter("degree > 0").select("repo", "path", "degree").join(out, ["repo", "path"], "left").join(into, ["repo", "path"], "left").join(layers.select("repo", "path", "layer"), ["repo", "path"], "left")
    return rows.select("repo", "path", F.coalesce("layer", F.lit("unknown")).alias("layer"), "degree", F.coalesce("imports", none).alias("imports"), F.coalesce("imported_by", none).alias("imported_by"))


def go_modules(files: DataFrame) -> DataFrame:
    """(repo, prefix, root): module paths of ``go.mod`` files and the folders that they stand in."""
    rows = files.filter((paths.basename(F.col("path")) == "go.mod") & F.col("content").isNotNull())
    return rows.select("repo", F.regexp_extract("content", r"(?m)^module\s+(\S+)", 1).alias("prefix"), paths.dirname(F.col("path")).alias("root")).filter("prefix <> ''")


def script_aliases(files: DataFrame) -> DataFrame:
    """(repo, prefix, folder): path aliases of ``tsconfig.json`` and ``jsconfig.json``, comments and trailing commas allowed; broken files give none."""
    rows = files.filter(paths.basename(F.col("path")).isin("tsconfig.json", "jsconfig.json") & F.col("content").isNotNull())
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("content", r"(?s)/\*.*?\*/", ""), r"(?m)(^|[^:])//.*$", "$1"), r",(\s*[}\]])", "$1")
    options = F.from_json(bare, "compilerOptions struct<baseUrl:string,paths:map<string,array<string>>>")["compilerOptions"]
    pairs = rows.select("repo", paths.dirname(F.col("path")).alias("dir"), F.coalesce(options["baseUrl"], F.lit(".")).alias("base"), F.explode(options["paths"]).alias("key", "targets"))
    each = pairs.select("repo", "dir", "base", F.regexp_replace("key", r"\*$", "").alias("prefix"), F.explode("targets").alias("target"))
    folder = _joined(F.concat_ws("/", "dir", "base"), F.regexp_replace("target", r"\*$", ""))
    return each.select("repo", "prefix", folder.alias("folder")).distinct()


def resolve_packages(imports: DataFrame, files: DataFrame, modules: DataFrame) -> DataFrame:
    """(import_id, repo, path, source, target): every Go file of the package folder that an import names; the longest module prefix that has one wins."""
    s, p = F.col("source"), F.col("prefix")
    met = imports.join(modules, "repo").filter((s == p) | s.startswith(F.concat(p, F.lit("/"))))
    rest = F.regexp_replace(F.expr("substring(source, length(prefix) + 1)"), "^/", "")
    met = met.select("import_id", "repo", "path", "source", F.length("prefix").alias("size"), F.array_join(F.filter(F.array("root", rest), lambda x: x != ""), "/").alias("dir"))
    known = files.filter(F.col("path").endswith(".go")).select("repo", paths.dirname(F.col("path")).alias("dir"), F.col("path").alias("target"))
    hits = met.join(known, ["repo", "dir"])
    best = hits.groupBy("import_id").agg(F.max("size").alias("size"))
    return hits.join(best, ["import_id", "size"]).select("import_id", "repo", "path", "source", "target")


def aliased_imports(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """The imports with each aliased source written from the root, as ``/folder/rest``; of several prefixes the longest counts."""
    met = imports.join(aliases, "repo").filter(F.col("source").startswith(F.col("prefix")))
    best = met.groupBy("import_id").agg(F.max_by(F.concat_ws("/", F.lit(""), "folder", F.expr("substring(source, length(prefix) + 1)")), F.length("prefix")).alias("_rooted"))
    return imports.join(best, "import_id", "left").withColumn("path", F.when(F.col("_rooted").isNotNull(), F.lit("")).otherwise(F.col("path"))).withColumn("source", F.coalesce("_rooted", "source")).drop("_rooted")
