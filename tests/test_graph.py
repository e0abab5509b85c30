import random

from pyspark.sql import functions as F

from corpusloom.operators import calls, graph, semantic

E = "repo string, source string, target string"


def cyclic(edges):
    nodes = {x for e in edges for x in e}
    reach = {n: {b for a, b in edges if a == n} for n in nodes}
    while any(reach[n] | set().union(*[reach[m] for m in reach[n]], set()) != reach[n] for n in nodes):
        reach = {n: reach[n] | set().union(*[reach[m] for m in reach[n]], set()) for n in nodes}
    return {n for n in nodes if n in reach[n]}


def test_files_on_cycles_match_reachability(spark):
    rng = random.Random(7)
    want, rows = set(), []
    for repo in ("p", "q", "none"):
        edges = {(str(rng.randrange(14)), str(rng.randrange(14))) for _ in range(22 if repo != "none" else 0)}
        edges = {(a, b) for a, b in edges if a != b} | ({("x", "y"), ("y", "z")} if repo == "none" else set())
        want |= {(repo, n) for n in cyclic(edges)}
        rows += [(repo, a, b) for a, b in edges]
    got = {(r.repo, r.path) for r in graph.files_on_cycles(spark.createDataFrame(rows, E)).collect()}
    assert got == want and want
    assert graph.files_on_cycles(spark.createDataFrame([], E)).collect() == []


def files(spark, *paths):
    return spark.createDataFrame([("r", p) for p in paths], "repo string, path string")


def test_resolution_order(spark):
    known = files(spark, "src/a.ts", "src/util/b.ts", "src/c/index.ts", "src/ui/Button.tsx", "pkg/__init__.py")
    rows = [(1, "src/a.ts", "./util/b.js"), (2, "src/util/b.ts", "../a"), (3, "src/a.ts", "./c"), (4, "src/a.ts", "@/ui/Button"), (5, "src/a.ts", "react"), (6, "pkg/x.py", "."), (7, "src/a.ts", "../../../a"), (8, "src/a.ts", None)]
    imports = spark.createDataFrame([(i, "r", p, s) for i, p, s in rows], "import_id long, repo string, path string, source string")
    got = {r.import_id: r.target for r in graph.resolve_imports(imports, known, {"@/": "src"}).collect()}
    assert got == {1: "src/util/b.ts", 2: "src/a.ts", 3: "src/c/index.ts", 4: "src/ui/Button.tsx", 6: "pkg/__init__.py"}


def test_degrees_add_up(spark):
    edges = spark.createDataFrame([("r", "a", "b"), ("r", "b", "c"), ("r", "a", "c")], E)
    nodes = {n.path: n for n in graph.file_nodes(edges, files(spark, "a", "b", "c", "d")).collect()}
    assert sum(n.degree for n in nodes.values()) == 6 and nodes["b"].betweenness == 1 / 3 and nodes["d"].degree == 0


def test_layers_last_rule_wins(spark):
    paths = ["src/services/user.service.test.ts", "src/routes/x.ts", "tests/a.ts", "x/config.ts", "x/many.ts", "x/plain.ts", "x/asks.ts"]
    imports = spark.createDataFrame([("r", "x/asks.ts", "../db/users")], "repo string, path string, source string")
    symbols = spark.createDataFrame([("r", "x/many.ts", True, "function")] * 4, "repo string, path string, exported boolean, type string")
    got = {r.path: (r.layer, r.confidence) for r in graph.file_layers(files(spark, *paths), imports, symbols).collect()}
    assert got[paths[0]] == ("service", 0.9) and got["src/routes/x.ts"] == ("api", 0.8) and got["tests/a.ts"] == ("test", 0.8)
    assert got["x/config.ts"] == ("config", 0.7) and got["x/many.ts"] == ("utility", 0.4) and got["x/plain.ts"] == ("unknown", 0.0) and got["x/asks.ts"] == ("service", 0.5)


def test_boundaries(spark):
    layers = spark.createDataFrame([("r", "s", "service"), ("r", "c", "controller"), ("r", "a", "api"), ("r", "t", "test"), ("r", "u", "unknown")], "repo string, path string, layer string")
    edges = spark.createDataFrame([("r", "s", "c"), ("r", "a", "c"), ("r", "s", "t"), ("r", "t", "s"), ("r", "u", "s")], E)
    got = {(b.from_layer, b.to_layer): (b.violations, b.allowed) for b in graph.layer_boundaries(edges, layers).collect()}
    assert got == {("service", "controller"): (1, False), ("api", "controller"): (0, True), ("service", "test"): (1, False), ("test", "service"): (0, True)}


SYM = "symbol_id long, repo string, path string, name string, type string, exported boolean, line int, body_size int, parent_symbol string"
CALL = "call_id long, repo string, path string, caller string, callee string, callee_root string, line int, kind string"
IMP = "import_id long, repo string, path string, resolved_path string, symbols array<string>"


def test_call_graph(spark):
    symbols = spark.createDataFrame([(1, "r", "util.ts", "log", "function", True, 1, 3, None), (2, "r", "svc.ts", "Service", "class", True, 1, 9, None), (3, "r", "svc.ts", "run", "method", True, 2, 3, "Service"), (4, "r", "svc.ts", "helper", "method", False, 5, 3, "Service"), (5, "r", "main.ts", "main", "function", True, 1, 5, None)], SYM)
    imports = spark.createDataFrame([(1, "r", "main.ts", "util.ts", ["log"]), (2, "r", "main.ts", "svc.ts", ["Service"]), (3, "r", "svc.ts", "util.ts", ["log"])], IMP)
    sites = [("main.ts", "main", "log", None, "call"), ("main.ts", "main", "Service", None, "new"), ("svc.ts", "Service.run", "log", None, "call"), ("svc.ts", "Service.run", "helper", None, "call"), ("main.ts", "", "console.log", "console", "call"), ("svc.ts", "Service.helper", "log", None, "call")]
    calls_ = spark.createDataFrame([(i, "r", p, a, b, root, i, k) for i, (p, a, b, root, k) in enumerate(sites)], CALL)
    nodes = calls.symbol_nodes(symbols)
    edges = calls.call_edges(calls_, nodes, imports)
    by = {(e.source, e.target): e for e in edges.collect()}
    assert by[("main", "log")].target_path == "util.ts" and by[("main", "Service")].kind == "instantiation"
    assert by[("<module>", "external:console.log")].resolved is False and by[("Service.run", "Service.helper")].resolved
    metrics = calls.fan_in_out(nodes, edges)
    fan = {m.name: (m.fan_in, m.fan_out) for m in metrics.collect()}
    assert fan["log"] == (3, 0) and fan["main"] == (0, 2) and sum(i for i, _ in fan.values()) == 5
    assert calls.call_depth(edges).first().depth == 3
    assert [(g.name, g.methods, g.total_fan_in) for g in calls.god_classes(metrics, 2, 99).collect()] == [("Service", 2, 2)]


def test_p90_is_the_value_at_the_index(spark):
    symbols = spark.createDataFrame([(n, "r", "a", f"f{n}", "function", True, 1, n, None) for n in range(1, 21)] + [(99, "q", "a", "f", "function", True, 1, 1, None)], SYM)
    assert [(r.repo, r.functions, r.p90) for r in calls.length_p90(symbols).collect()] == [("r", 20, 19)]


def test_two_groups_and_an_outsider(spark):
    words = {f"auth{n}.ts": ["auth", "login", "token", "session", f"x{n}aaa"] for n in range(12)} | {f"draw{n}.ts": ["render", "canvas", "pixel", "frame", f"y{n}bbb"] for n in range(12)} | {"odd.ts": ["alone"]}
    tokens = spark.createDataFrame([("r", p, t, 1) for p, ts in words.items() for t in ts], "repo string, path string, term string, tf long")
    known = files(spark, *words)
    weights = semantic.tfidf(tokens, known)
    norms = weights.selectExpr("path", "weight * weight as w").groupBy("path").sum("w").collect()
    assert all(abs(n[1] - 1) < 1e-9 for n in norms)
    pairs = semantic.similar_pairs(weights, 0.3)
    assert pairs.count() == 2 * 66 and all(0.3 <= p.cosine <= 1 for p in pairs.collect())
    for partitions in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        parts = semantic.adaptive_clusters(pairs, semantic.same_terms(weights), known)
        sizes = sorted(r["count"] for r in parts.groupBy("component").count().collect())
        assert sizes == [12, 12]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    clusters = parts.select("repo", "path", "component")
    cohesion = {r.component: r.cohesion for r in semantic.cohesion(clusters, weights).collect()}
    mean = [p.cosine for p in pairs.collect() if p.a.startswith("auth")]
    assert abs(cohesion["auth0.ts"] - sum(mean) / len(mean)) < 1e-3


def test_same_terms_are_one_and_components_are_whole(spark):
    tokens = spark.createDataFrame([("r", f"c{n}.ts", t, 1) for n in range(30) for t in ("same", "words")] + [("r", "o.ts", "other", 1)], "repo string, path string, term string, tf long")
    known = files(spark, *[f"c{n}.ts" for n in range(30)], "o.ts")
    weights = semantic.tfidf(tokens, known)
    assert semantic.similar_pairs(weights, 0.3).count() == 0
    assert semantic.clusters_at(semantic.similar_pairs(weights, 0.3), semantic.same_terms(weights), 0.3).count() == 30
    chain = spark.createDataFrame([("r", f"{n:03}", f"{n + 1:03}", 1.0) for n in range(60)], "repo string, a string, b string, cosine double")
    assert {r.component for r in semantic.components(chain).collect()} == {"000"}


def test_modules_and_aliases(spark):
    rows = [("backend/go.mod", "// x\nmodule example.com/app\n"), ("backend/internal/svc/a.go", ""), ("backend/internal/svc/b.go", ""), ("backend/main.go", ""), ("web/tsconfig.json", '{ // c\n "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["./src/*"], }},}'), ("web/src/ui/Button.tsx", ""), ("jsconfig.json", "{broken"), ("x/tsconfig.json", None)]
    known = spark.createDataFrame([("r", p, t) for p, t in rows], "repo string, path string, content string")
    modules, aliases = graph.go_modules(known), graph.script_aliases(known)
    assert [(m.prefix, m.root) for m in modules.collect()] == [("example.com/app", "backend")]
    assert [(a.prefix, a.folder) for a in aliases.collect()] == [("@/", "web/src")]
    imports = spark.createDataFrame([(1, "r", "backend/main.go", "example.com/app/internal/svc"), (2, "r", "backend/main.go", "fmt"), (3, "r", "web/src/a.ts", "@/ui/Button"), (4, "r", "web/src/a.ts", "react"), (5, "r", "backend/x.go", "example.com/apple")], "import_id long, repo string, path string, source string")
    assert sorted((r.import_id, r.target) for r in graph.resolve_packages(imports, known, modules).collect()) == [(1, "backend/internal/svc/a.go"), (1, "backend/internal/svc/b.go")]
    got = {r.import_id: r.target for r in graph.resolve_imports(graph.aliased_imports(imports, aliases), known).collect()}
    assert got == {3: "web/src/ui/Button.tsx"}


def test_pairs_over_blocks_are_all_pairs_and_move_no_candidates(spark):
    import random

    rng = random.Random(3)
    words = {f"{r}/{n}.ts": (r, rng.sample([f"w{k}" for k in range(60)], rng.randint(1, 12))) for r, size in (("p", 150), ("q", 5)) for n in range(size)}
    tokens = spark.createDataFrame([(r, p, t, rng.randint(1, 3)) for p, (r, ts) in words.items() for t in ts], "repo string, path string, term string, tf long")
    known = spark.createDataFrame([(r, p) for p, (r, _) in words.items()], "repo string, path string")
    weights = semantic.durable(semantic.tfidf(tokens, known))
    same = {r.path for r in semantic.same_terms(weights).collect() if r.path == r.same}
    vectors = {}
    for r in weights.collect():
        vectors.setdefault((r.repo, r.path), {})[r.term] = r.weight
    ids = sorted(k for k in vectors if k[1] in same)
    cosine = {(x[0], x[1], y[1]): sum(w * vectors[y].get(t, 0.0) for t, w in vectors[x].items()) for x in ids for y in ids if x[0] == y[0] and x[1] < y[1]}
    want = {k: c for k, c in cosine.items() if c >= 0.3}
    for block_files in (2048, 40, 2):
        rows = semantic.similar_pairs(weights, 0.3, block_files=block_files).collect()
        got = {(r.repo, r.a, r.b): r.cosine for r in rows}
        assert len(rows) == len(got) and got.keys() == want.keys() and all(abs(c - want[k]) < 1e-12 for k, c in got.items())
    assert semantic.similar_pairs(weights.limit(0), 0.3).count() == 0
    # a pair is moved in blocks only; no join meets the files under their terms
    plan = semantic.similar_pairs(weights, 0.3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Inner, (((" not in plan and plan.count("Join") == 2


def _random_terms(spark):
    rng = random.Random(5)
    sizes = (("p", 90, 60), ("dense", 40, 9), ("q", 5, 9))
    words = {(r, f"{n:03}.ts"): rng.sample([f"w{k}" for k in range(many)], rng.randint(1, 8)) for r, size, many in sizes for n in range(size)}
    tokens = spark.createDataFrame([(r, p, t, rng.randint(1, 3)) for (r, p), ts in words.items() for t in ts], "repo string, path string, term string, tf long")
    return tokens, spark.createDataFrame(list(words), "repo string, path string")


def test_links_have_the_parts_of_all_pairs_and_are_not_more_than_the_files(spark, monkeypatch):
    tokens, known = _random_terms(spark)
    weights = semantic.durable(semantic.tfidf(tokens, known))
    same, pairs = semantic.same_terms(weights), semantic.durable(semantic.similar_pairs(weights, 0.3))
    want = {t: sorted(semantic.clusters_at(pairs, same, t).collect()) for t in (0.3, 0.7)}
    assert pairs.count() > 3 * known.count()
    terms = tokens.groupBy("repo", "path").agg(F.collect_list(F.struct("term", "tf")).alias("v"))
    monkeypatch.setattr(semantic, "FOREST_BLOCKS", 2)
    for block_files in (2048, 9):
        vectors, counts = semantic.file_vectors(terms, known, block_files=block_files)
        assert sorted(vectors.select("repo", "path", "same").collect()) == sorted(same.select("repo", "path", "same").collect())
        got = {(r.repo, r.path, r.term): r.weight for r in vectors.select("repo", "path", F.inline("v")).collect()}
        rows = weights.collect()
        assert len(got) == len(rows) and all(abs(got[r.repo, r.path, r.term] - r.weight) < 1e-12 for r in rows)
        copies = vectors.select("repo", "path", "same")
        links = semantic.durable(semantic.similar_links(vectors, counts, semantic.LIMITS, block_files=block_files))
        assert {t: sorted(semantic.clusters_at(links, copies, t).collect()) for t in want} == want
        assert block_files < 2048 or links.count() < known.count()
    empty, none = semantic.file_vectors(terms.limit(0), known)
    assert empty.count() == 0 and semantic.similar_links(empty, none, [0.3]).count() == 0


def test_terms_by_file_are_the_tokens_of_rows_told_apart(spark):
    symbols = spark.createDataFrame([(1, "r", "a.ts", "userName", "Store", None, 5, ["x", None]), (1, "r", "a.ts", "userName", "Store", None, 5, ["x", None]), (1, "r", "a.ts", "userName", "Store", 5, None, ["x", None]), (1, "r", "a.ts", "userName", "Store", 5, None, [None, "x"]), (2, "r", "gone.ts", "lost", None, 1, 1, None), (3, "r", "b.ts", "lonely", None, 1, 1, [])], "symbol_id long, repo string, path string, name string, parent_symbol string, line int, end_line int, parameters array<string>")
    imports = spark.createDataFrame([(1, "r", "a.ts", "react", ["useState", None]), (1, "r", "a.ts", "react", ["useState", None]), (2, "r", "a.ts", "react", None), (3, "r", "b.ts", None, ["thing"])], "import_id long, repo string, path string, source string, symbols array<string>")
    known = spark.createDataFrame([("r", "a.ts"), ("r", "b.ts"), ("r", "pathWord.ts"), (None, "x.ts")], "repo string, path string")
    want = sorted(semantic.file_tokens(known, symbols.distinct(), imports.distinct()).collect())
    rows = semantic.file_terms(known, symbols, imports)
    assert sorted(rows.select("repo", "path", F.inline("v")).collect()) == [tuple(r) for r in want] and any(r.term == "user" and r.tf == 3 for r in want)
    # rows are moved once and narrow: the other exchanges are those of the live files
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2


def test_adaptive_parts_of_links_are_those_of_all_pairs(spark, monkeypatch):
    tokens, known = _random_terms(spark)
    weights = semantic.durable(semantic.tfidf(tokens, known))
    pairs, same = semantic.durable(semantic.similar_pairs(weights, 0.3)), semantic.durable(semantic.same_terms(weights))
    terms = tokens.groupBy("repo", "path").agg(F.collect_list(F.struct("term", "tf")).alias("v"))
    vectors, counts = semantic.file_vectors(terms, known, block_files=20)
    links = semantic.durable(semantic.similar_links(vectors, counts, semantic.LIMITS, block_files=20))
    got = sorted(semantic.adaptive_clusters(links, same, known).collect())
    # parts of a repository too large for one task are found over all of them
    monkeypatch.setattr(semantic, "TASK_LINKS", 0)
    want = sorted(semantic.adaptive_clusters(pairs, same, known).collect())
    assert got == want and {r.repo for r in got} == {"p", "dense"}
    assert semantic.adaptive_clusters(links.limit(0), same.limit(0), known).count() == 0


def test_terms_and_cohesion_of_parts_from_arrays_move_no_words(spark):
    tokens, known = _random_terms(spark)
    weights = semantic.durable(semantic.tfidf(tokens, known))
    terms = tokens.groupBy("repo", "path").agg(F.collect_list(F.struct("term", "tf")).alias("v"))
    vectors, _ = semantic.file_vectors(terms, known)
    clusters = semantic.durable(known.select("repo", "path", F.regexp_replace("path", "[0-9]\\.ts", "").alias("component")))
    for summary in (semantic.cluster_terms, semantic.cohesion):
        rows = summary(clusters, vectors)
        assert sorted(rows.collect()) == sorted(summary(clusters, weights).collect()) and rows.count()
    # members meet by file, then by part, and so do the sizes; nothing is moved by term
    plan = semantic.cohesion(clusters, vectors)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(repo" in plan and not [x for x in plan.split("\n") if "Exchange" in x and "term#" in x]


def test_structural_clusters_make_no_pairs_and_count_repeated_imports_once(spark, monkeypatch):
    from corpusloom.plans import core

    def refuse(*_):
        raise AssertionError("all pairs of a part are its square")

    monkeypatch.setattr(semantic, "similar_pairs", refuse)
    monkeypatch.setattr(core.Corpus, "raw", lambda self, name: tables[name])
    paths = [f"d{c}/same.ts" for c in "abcdef"]
    tables = {
        "files": spark.createDataFrame([(n, n, "r", p, None, None) for n, p in enumerate(paths)], "file_id long, ord long, repo string, path string, scanned_at timestamp, removed_at timestamp"),
        "symbols": spark.createDataFrame([(n, "r", p, w, None, None) for n, p in enumerate(paths) for w in ("renderCanvasFrameBuffer", "shaderTextureMeshLight", f"pixel{'abcdef'[n] * 3}")], "symbol_id long, repo string, path string, name string, parent_symbol string, removed_at timestamp"),
        "imports": spark.createDataFrame([(n, "r", p, "react" if n < 3 else "vue", ["x"], None) for n, p in enumerate(paths)] + [(5, "r", paths[5], "vue", ["x"], None)] * 3 + [(9, "r", paths[0], "rare", ["x"], None)] * 3, "import_id long, repo string, path string, source string, symbols array<string>, resolved_path string"),
    }
    (row,) = core.QUERIES["structural_clusters"](spark, "").collect()
    assert (row.component, row.members, row.shared, row.prevalence) == (paths[0], 6, ["react", "vue"], 1.0)
