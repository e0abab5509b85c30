"""Conventions of each repository, mined as ratios in one wide aggregate.

Files carry their facts (language, names, what their content, symbols, imports
and exports hold); one aggregate for each repository counts them, and every
pattern is a ratio of two counts that is emitted under its own condition. Ratios
below 0.2 never come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import paths
from corpusloom.operators import extract

LEAST = 0.2

# First path segments that stand for layers, features, front ends, back ends and shared types.
LAYER_FOLDERS = ["controllers", "services", "models", "views", "routes", "middleware", "utils", "helpers", "repositories", "handlers", "stores", "entities"]
FEATURE_FOLDERS = ["auth", "users", "products", "orders", "payments", "notifications", "dashboard", "inventory", "devices"]
FRONT = ["frontend", "web", "client", "ui", "app"]
BACK = ["backend", "server", "api", "cmd", "internal", "service", "services"]
SHARED = ["shared", "common", "types", "contracts", "proto", "schema"]


def file_facts(files: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """One row of facts for each file of ``live_files(files, "content")``."""
    p, text, name = F.col("path"), F.coalesce("content", F.lit("")), F.col("name")
    b, s = paths.basename(p), paths.stem(p)
    script, go = F.col("language").isin("typescript", "javascript"), F.col("language") == "go"
    count = lambda c: F.count_if(c)
    of_symbols = symbols.groupBy("repo", "path").agg(
        count(F.col("type") == "function").alias("functions"),
        count((F.col("type") == "function") & name.rlike("^[a-z][a-zA-Z0-9]*$")).alias("camel"),
        count((F.col("type") == "function") & name.rlike("^[a-z][a-z0-9_]*$") & name.contains("_")).alias("snake"),
        count(F.col("type").isin("class", "interface")).alias("classes"),
        count(F.col("type").isin("class", "interface") & name.rlike("^[A-Z][a-zA-Z0-9]*$")).alias("pascal"),
        count(F.col("type") == "interface").alias("interfaces"),
        count(F.col("type") == "type").alias("aliases"),
        count(F.col("type") == "class").alias("structs"),
        F.max(name.contains("Result")).alias("result_symbol"),
    )
    src, lower = F.col("source"), F.lower("source")
    is_ = lambda *names: F.max(src.isin(*names))
    of_imports = imports.filter("source is not null").groupBy("repo", "path").agg(
        F.max(F.exists(F.coalesce("symbols", F.array().cast("array<string>")), lambda x: x.contains("Result"))).alias("result_import"),
        count(src.startswith(".")).alias("relative"),
        count(src.startswith("@/") | src.startswith("~/") | src.startswith("#")).alias("alias"),
        count(~src.startswith(".") & ~src.startswith("/") & ~src.contains("node_modules") & ~src.startswith("@")).alias("bare"),
        F.max((src == "zustand") | src.startswith("zustand/")).alias("zustand"),
        F.max(src.isin("redux", "@reduxjs/toolkit") | src.startswith("react-redux")).alias("redux"),
        is_("@tanstack/react-query", "react-query").alias("query"),
        F.max((src == "zod") | src.startswith("zod/")).alias("zod"),
        F.max(lower.rlike("/service|/controller|/handler")).alias("to_upper"),
        F.max(lower.rlike("/controller|/handler|/route")).alias("to_entry"),
    )
    of_exports = extract.line_exports(files).groupBy("file_id").agg(F.max(F.col("type") == "named").alias("named_export"), F.max(F.col("type") == "default").alias("default_export"))
    parts = F.split(F.lower(p), "/")
    rows = files.select(
        "repo", "path", "file_id", script.alias("script"), go.alias("go"), (F.col("language") == "typescript").alias("ts"),
        (s.rlike("^[a-z][a-z0-9-]*$") & s.contains("-")).alias("kebab_file"), (s.rlike("^[a-z][a-zA-Z0-9]*$") & s.rlike("[A-Z]")).alias("camel_file"), s.rlike("^[A-Z][a-zA-Z0-9]*$").alias("pascal_file"),
        text.rlike(r"try\s*\{").alias("try_catch"), text.rlike(r"\.catch\s*\(").alias("promise"), text.rlike(r"\basync\s+function|\basync\s+\(").alias("is_async"), text.rlike(r"new Promise\s*\(").alias("new_promise"),
        text.contains("if err != nil").alias("err_nil"), text.rlike(r"\bpanic\s*\(").alias("panic"), text.rlike(r"func\s+\w+\s*\(\s*ctx\s+context\.Context").alias("ctx_first"),
        F.regexp_count(text, F.lit(r"func\s*\(\s*\w+\s+\*\w+\)")).alias("pointer_receivers"),
        text.contains("gin.Context").alias("gin"), (text.contains("http.ResponseWriter") & text.contains("*http.Request")).alias("net_http"), (text.contains('"use client"') | text.contains("'use client'")).alias("use_client"),
        F.lower(p).rlike("handler|route").alias("handler_path"), (p.contains("/app/") & p.rlike("(page\\.tsx?|layout\\.tsx)$")).alias("app_router"), (p.contains("/pages/") & ~p.contains("/_")).alias("pages_router"),
        b.isin("index.ts", "index.js").alias("index_file"), p.contains("/").alias("nested"), paths.dirname(p).alias("dir"), F.when(p.contains("/"), F.split(p, "/")[0]).alias("root"),
        (b.contains(".test.") | b.contains(".spec.") | b.contains("_test.") | p.contains("__tests__/") | p.contains("/tests/")).alias("test"), b.contains(".test.").alias("dot_test"), b.contains(".spec.").alias("dot_spec"), b.contains("_test.go").alias("go_test"),
        F.exists(parts, lambda x: x.isin("services", "service")).alias("in_service"), F.exists(parts, lambda x: x.isin("utils", "helpers", "lib")).alias("in_util"),
    )
    on = ["repo", "path"]
    return rows.join(of_symbols, on, "left").join(of_imports, on, "left").join(of_exports, "file_id", "left")


def repo_counts(facts: DataFrame) -> DataFrame:
    """One row of counts for each repository."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    total = lambda name, when=None: F.coalesce(F.sum(F.when(when, F.col(name)) if when is not None else F.col(name)), F.lit(0))
    c, script, go, ts = F.col, F.col("script"), F.col("go"), F.col("ts")
    sources = facts.filter(~c("test")).select("repo", "dir").distinct().withColumn("has_source", F.lit(True))
    facts = facts.join(sources, ["repo", "dir"], "left")
    low = F.lower("dir")
    return facts.groupBy("repo").agg(
        F.count(F.lit(1)).alias("files"), n(script).alias("scripts"), n(go).alias("go_files"), n(ts).alias("ts_files"),
        *[total(x).alias(x) for x in ("functions", "camel", "snake", "classes", "pascal")],
        n(c("kebab_file")).alias("kebab_files"), n(c("camel_file")).alias("camel_files"), n(c("pascal_file")).alias("pascal_files"),
        n(script & (F.coalesce("result_symbol", F.lit(False)) | F.coalesce("result_import", F.lit(False)))).alias("results"),
        *[n(script & c(x)).alias(y) for x, y in (("try_catch", "try_files"), ("promise", "promise_files"), ("is_async", "async_files"), ("new_promise", "new_promise_files"), ("zustand", "zustand_files"), ("redux", "redux_files"), ("query", "query_files"), ("named_export", "named_files"), ("default_export", "default_files"), ("nested", "nested_scripts"))],
        *[n(go & c(x)).alias(y) for x, y in (("err_nil", "err_files"), ("panic", "panic_files"), ("ctx_first", "ctx_files"), ("handler_path", "handler_files"))],
        n(go & c("handler_path") & c("gin")).alias("gin_files"), n(go & c("handler_path") & c("net_http")).alias("net_files"),
        total("pointer_receivers", go).alias("receivers"), total("structs", go).alias("structs"),
        F.max(go & low.contains("handler")).alias("handler_dir"), F.max(go & low.contains("service")).alias("service_dir"),
        F.max(F.lower("root").isin(FRONT)).alias("front"), F.max(F.lower("root").isin(BACK)).alias("back"), F.max(F.lower("root").isin(SHARED)).alias("shared"),
        n(script & ((c("in_util") & F.coalesce("to_upper", F.lit(False))) | (c("in_service") & F.coalesce("to_entry", F.lit(False))))).alias("violations"),
        n(script & c("app_router")).alias("app_files"), n(script & c("pages_router")).alias("pages_files"), n(script & c("app_router") & c("use_client")).alias("client_files"),
        n(script & c("index_file") & (F.coalesce("named_export", F.lit(False)) | F.coalesce("default_export", F.lit(False)))).alias("barrels"),
        *[total(x, script).alias(x) for x in ("relative", "alias", "bare")],
        *[F.coalesce(F.max(c("root") == x), F.lit(False)).cast("int").alias(f"layer_{x}") for x in LAYER_FOLDERS],
        *[F.coalesce(F.max(c("root") == x), F.lit(False)).cast("int").alias(f"feature_{x}") for x in FEATURE_FOLDERS],
        n(c("test")).alias("tests"), n(c("test") & c("has_source")).alias("colocated"), n(c("test") & c("dot_test")).alias("dot_tests"), n(c("test") & c("dot_spec")).alias("dot_specs"), n(c("test") & c("go_test")).alias("go_tests"),
        total("interfaces", ts).alias("interfaces"), total("aliases", ts).alias("aliases"), n(ts & c("zod")).alias("zod_files"),
    )


def _patterns() -> list[tuple[str, Column, Column, Column, Column | None]]:
    """(id, matched, population, emitted if, constant prevalence or None)."""
    c = F.col
    ratio = lambda a, b: c(a) / c(b)
    one, scripts, yes = F.lit(1), c("scripts") >= 3, F.lit(True)
    layers, features = sum((c(f"layer_{x}") for x in LAYER_FOLDERS), F.lit(0)), sum((c(f"feature_{x}") for x in FEATURE_FOLDERS), F.lit(0))
    kebab, camel = ratio("kebab_files", "files") >= 0.4, ratio("camel_files", "files") >= 0.4
    tested = (c("tests") >= 2) & (c("files") - c("tests") >= 2)
    const = lambda x: F.lit(x)
    return [
        ("naming-functions-camelcase", c("camel"), c("functions"), (c("functions") > 3) & (ratio("camel", "functions") >= 0.7), None),
        ("naming-functions-snake-case", c("snake"), c("functions"), (c("functions") > 3) & (ratio("snake", "functions") >= 0.7), None),
        ("naming-classes-pascalcase", c("pascal"), c("classes"), (c("classes") > 2) & (ratio("pascal", "classes") >= 0.7), None),
        ("naming-files-kebab-case", c("kebab_files"), c("files"), kebab, None),
        ("naming-files-camelcase", c("camel_files"), c("files"), ~kebab & camel, None),
        ("naming-files-pascalcase", c("pascal_files"), c("files"), ~kebab & ~camel & (ratio("pascal_files", "files") >= 0.4), None),
        ("error-handling-result-pattern", c("results"), c("scripts"), scripts & (ratio("results", "scripts") >= 0.3), None),
        ("error-handling-try-catch", c("try_files"), c("scripts"), scripts & (ratio("try_files", "scripts") >= 0.4), None),
        ("error-handling-promise-chain", c("promise_files"), c("scripts"), scripts & (ratio("promise_files", "scripts") >= 0.3) & (ratio("try_files", "scripts") < 0.4), None),
        ("go-error-handling-err-nil", c("err_files"), c("go_files"), (c("go_files") >= 3) & (ratio("err_files", "go_files") >= 0.4), None),
        ("go-no-panic-in-handlers", c("go_files") - c("panic_files"), c("go_files"), (c("go_files") >= 3) & (c("panic_files") > 0) & (ratio("panic_files", "go_files") <= 0.15), None),
        ("go-context-first-param", c("ctx_files"), c("go_files"), (c("go_files") >= 3) & (ratio("ctx_files", "go_files") >= 0.3), None),
        ("go-layered-architecture", one, one, (c("go_files") >= 3) & c("handler_dir") & c("service_dir"), const(0.85)),
        ("go-pointer-receivers", c("receivers"), c("structs"), (c("go_files") >= 3) & (c("structs") >= 3) & (c("receivers") > c("structs") * 0.5), const(0.75)),
        ("architecture-monorepo-frontend-backend", one, one, c("front") & c("back"), const(0.95)),
        ("architecture-layer-violation-detected", c("violations"), c("scripts"), c("violations") > 0, const(0.8)),
        ("architecture-shared-types", one, one, c("shared"), const(0.9)),
        ("nextjs-app-router", c("app_files"), c("scripts"), (c("app_files") > c("pages_files")) & (c("app_files") >= 2), None),
        ("nextjs-use-client-directive", c("client_files"), c("app_files"), (c("app_files") > c("pages_files")) & (c("app_files") >= 2) & (c("client_files") > 0), None),
        ("go-gin-framework", c("gin_files"), c("handler_files"), (c("go_files") >= 3) & (c("gin_files") > 0), None),
        ("go-net-http-handlers", c("net_files"), c("handler_files"), (c("go_files") >= 3) & (c("gin_files") == 0) & (c("net_files") > 0), None),
        ("state-management-zustand", c("zustand_files"), c("scripts"), scripts & (c("zustand_files") >= 2), None),
        ("state-management-redux", c("redux_files"), c("scripts"), scripts & (c("redux_files") >= 2), None),
        ("state-management-react-query", c("query_files"), c("scripts"), scripts & (c("query_files") >= 2), None),
        ("async-await-pattern", c("async_files"), c("scripts"), scripts & (ratio("async_files", "scripts") >= 0.4) & (c("async_files") > c("new_promise_files")), None),
        ("imports-barrel-files", c("barrels"), c("nested_scripts"), scripts & (c("barrels") >= 2), None),
        ("imports-path-alias", c("alias"), c("alias") + c("relative"), scripts & (c("alias") > c("relative")) & (c("alias") >= 5), None),
        ("imports-relative", c("relative"), c("relative") + c("bare"), scripts & ~((c("alias") > c("relative")) & (c("alias") >= 5)) & (c("relative") > c("bare")) & (c("relative") > 5), None),
        ("organization-layer-folders", layers, F.lit(len(LAYER_FOLDERS)), layers >= 2, None),
        ("organization-feature-folders", features, F.lit(len(FEATURE_FOLDERS)), features >= 2, None),
        ("testing-colocated", c("colocated"), c("tests"), tested & (ratio("colocated", "tests") >= 0.5), None),
        ("testing-naming-test", c("dot_tests"), c("tests"), tested & (c("dot_tests") > c("dot_specs")) & (ratio("dot_tests", "tests") >= 0.7), None),
        ("testing-go-test-files", c("go_tests"), c("go_files"), tested & (c("go_tests") >= 2), None),
        ("types-prefer-interface", c("interfaces"), c("interfaces") + c("aliases"), (c("ts_files") >= 3) & (c("interfaces") > c("aliases")) & (c("interfaces") >= 5), None),
        ("types-prefer-type-alias", c("aliases"), c("interfaces") + c("aliases"), (c("ts_files") >= 3) & (c("aliases") > c("interfaces")) & (c("aliases") >= 5), None),
        ("types-zod-validation", c("zod_files"), c("ts_files"), (c("ts_files") >= 3) & (c("zod_files") >= 2), None),
        ("exports-named-only", c("named_files"), c("scripts"), scripts & (c("named_files") > c("default_files")) & (c("named_files") >= 5), None),
        ("exports-default-preferred", c("default_files"), c("scripts"), scripts & (c("default_files") > c("named_files")) & (c("default_files") >= 5) & yes, None),
    ]


def mine_patterns(files: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(repo, pattern, matched, population, prevalence) of the conventions that each repository follows."""
    rows = []
    for name, matched, population, emitted, constant in _patterns():
        whole = F.greatest(population.cast("long"), F.lit(1).cast("long"))
        prevalence = (matched.cast("double") / whole) if constant is None else constant.cast("double")
        rows.append(F.when(F.coalesce(emitted, F.lit(False)), F.struct(F.lit(name).alias("pattern"), matched.cast("long").alias("matched"), population.cast("long").alias("population"), prevalence.alias("prevalence"))))
    counts = repo_counts(file_facts(files, symbols, imports))
    return counts.select("repo", F.explode(F.array(*rows)).alias("p")).filter("p is not null").select("repo", "p.*").filter(F.col("prevalence") >= LEAST)


def shared_cluster_imports(clusters: DataFrame, imports: DataFrame, least_files: int = 4, share: float = 0.5) -> DataFrame:
    """(repo, component, source, files): imports that at least ``share`` of the members of a large cluster have."""
    size = clusters.groupBy("repo", "component").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") >= least_files)
    used = clusters.join(imports.filter("source is not null").select("repo", "path", "source").distinct(), ["repo", "path"]).groupBy("repo", "component", "source").agg(F.count(F.lit(1)).alias("files"))
    return used.join(size, ["repo", "component"]).filter(F.col("files") >= F.col("members") * share).select("repo", "component", "source", "files")


def structural_clusters(clusters: DataFrame, imports: DataFrame, cohesion: DataFrame, files: DataFrame, least_files: int = 4, share: float = 0.5, top: int = 3) -> DataFrame:
    """(repo, component, members, shared, cohesion, prevalence): clusters of similar files that count as a pattern.

    A cluster of ``least_files`` members counts if ``share`` of them have an
    import in common or if its cohesion is at least ``share``. ``shared`` has the
    first ``top`` such imports by name; ``prevalence`` is the cluster's share of
    the repository's files, to two digits.
    """
    order = Window.partitionBy("repo", "component").orderBy("source")
    common = shared_cluster_imports(clusters, imports, least_files, share)
    few = common.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top).groupBy("repo", "component").agg(F.array_sort(F.collect_list("source")).alias("shared"))
    size = clusters.groupBy("repo", "component").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") >= least_files)
    whole = files.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    rows = size.join(few, ["repo", "component"], "left").join(cohesion.select("repo", "component", "cohesion"), ["repo", "component"], "left").join(whole, "repo")
    rows = rows.filter(F.col("shared").isNotNull() | (F.col("cohesion") >= share))
    return rows.select("repo", "component", "members", F.coalesce("shared", F.array().cast("array<string>")).alias("shared"), "cohesion", (F.floor(F.col("members") * 100 / F.col("n") + 0.5) / 100).alias("prevalence"))


def naming_examples(symbols: DataFrame, top: int = 3) -> DataFrame:
    """(repo, style, follows, rank, path, line, name): the first names that follow each naming style and the first that do not, by path, line and name."""
    name = F.col("name")
    styles = [
        ("functions-camelcase", F.col("type") == "function", name.rlike("^[a-z][a-zA-Z0-9]*$")),
        ("functions-snake-case", F.col("type") == "function", name.rlike("^[a-z][a-z0-9_]*$") & name.contains("_")),
        ("classes-pascalcase", F.col("type").isin("class", "interface"), name.rlike("^[A-Z][a-zA-Z0-9]*$")),
    ]
    cases = F.array(*[F.when(of, F.struct(F.lit(style).alias("style"), fits.alias("follows"))) for style, of, fits in styles])
    rows = symbols.select("repo", "path", F.col("line").cast("int").alias("line"), "name", F.explode(F.filter(cases, lambda c: c.isNotNull())).alias("c")).select("repo", "c.*", "path", "line", "name").distinct()
    order = Window.partitionBy("repo", "style", "follows").orderBy("path", F.asc_nulls_last("line"), "name")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
