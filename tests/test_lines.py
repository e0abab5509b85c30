"""Names, exports, live contents, resolver and the joins over them on small fixtures."""

from datetime import datetime

from corpusloom.operators import calls, corpus, extract, graph, mining, review, rules, semantic

FILES = "repo string, path string, language string, file_id long, ord long, content string"
CODE = {
    "a.ts": "import { A, B as C } from './x'\nimport D, { E } from 'y'\nimport * as F from \"z\"\nimport 'side'\nconst { G, H } = require('w')\nconst I = require('v')\nexport { A, B as Q }\nexport default class K {}\nexport async function f() {}\n",
    "b.py": "import os.path\nimport sys as s\nfrom a.b import c, d as e\nfrom q import *\n__all__ = [\n  'c',\n]\ndef f(): pass\n",
    "c.go": 'package c\nimport "fmt"\nimport (\n\talias "a/b"\n\t"net/http"\n)\nfunc Open() {}\nfunc close() {}\ntype T struct{}\n',
    "d.java": "import java.util.List;\nimport static a.B.C;\npublic class D {\n  public int f(int x) {\n",
    "e.rs": "use a::b::{C, D};\nuse std::fmt;\npub fn open() {}\nfn close() {}\npub struct S;\n",
    "f.rb": "require 'json'\nrequire_relative './x'\nclass A\n  def go\n",
    "g.php": "use App\\Models\\User;\nabstract class B\n  public static function run()\n",
    "h.cs": "using System.Text;\npublic sealed class E\n  internal async Task<int> Go()\ninterface IX\n",
    "i.ts": None,
    "j.ts": "",
}


def frame(spark):
    names = {"ts": "typescript", "py": "python", "go": "go", "java": "java", "rs": "rust", "rb": "ruby", "php": "php", "cs": "csharp"}
    return spark.createDataFrame([("r", p, names[p.split(".")[1]], n, n, t) for n, (p, t) in enumerate(CODE.items())], FILES)


def test_names_and_flags_of_imports(spark):
    got = {}
    for r in extract.import_names(frame(spark)).collect():
        got.setdefault(r.path, []).append((r.line, r.source, r.names, r.is_default, r.is_namespace))
    got = {p: [x[1:] for x in sorted(v)] for p, v in got.items()}
    assert got == {
        "a.ts": [("./x", ["A", "B"], False, False), ("y", ["D", "E"], True, False), ("z", ["F"], False, True), ("side", [], False, False), ("w", ["G", "H"], False, False), ("v", ["I"], True, False)],
        "b.py": [("os.path", ["path"], True, False), ("sys", ["sys"], True, False), ("a.b", ["c", "d"], False, False), ("q", [], False, True)],
        "c.go": [("fmt", ["fmt"], False, False), ("a/b", ["alias"], False, False), ("net/http", ["http"], False, False)],
        "d.java": [("java.util.List", ["List"], False, False), ("a.B.C", ["C"], False, False)],
        "e.rs": [("a::b", ["C", "D"], False, False), ("std::fmt", ["fmt"], False, False)],
        "f.rb": [("json", [], True, False), ("./x", [], True, False)],
        "g.php": [("App\\Models\\User", ["User"], False, False)],
        "h.cs": [("System.Text", ["Text"], False, False)],
    }


def test_exports_of_every_language(spark):
    got = {}
    for r in extract.exported_names(frame(spark)).collect():
        got.setdefault(r.path, set()).add((r.type, r.name))
    assert got == {
        "a.ts": {("named", "A"), ("named", "B"), ("default", "K"), ("named", "f")}, "b.py": {("named", "c")}, "c.go": {("named", "Open"), ("named", "T")},
        "d.java": {("named", "D")}, "e.rs": {("named", "open"), ("named", "S")}, "h.cs": {("named", "E")},
    }
    symbols = {(r.type, r.name, r.exported) for r in extract.line_symbols(frame(spark).filter("path in ('f.rb', 'g.php', 'h.cs')")).collect()}
    assert symbols == {("class", "A", True), ("function", "go", True), ("class", "B", True), ("function", "run", True), ("class", "E", True), ("method", "Go", False), ("interface", "IX", False)}


def test_stored_contents_are_scanned_once_and_never_shuffled(spark, tmp_path):
    day = lambda n: datetime(2026, 1, n)
    rows = [(1, "r", "a.ts", 1, "old", day(1), None), (2, "r", ".\\a.ts", 2, "new", day(2), None), (2, "r", ".\\a.ts", 2, "new", day(2), None), (3, "r", "b.ts", 3, None, None, None), (4, "r", "c.ts", 4, "gone", day(1), day(3)), (5, None, "a.ts", 5, "x", day(1), None), (6, "r", None, 6, "y", day(1), None)]
    memory = spark.createDataFrame(rows * 2, "file_id long, repo string, path string, ord long, content string, scanned_at timestamp, removed_at timestamp")
    memory.repartition(3).write.parquet(str(tmp_path / "files.parquet"))
    stored = corpus.live_files(spark.read.parquet(str(tmp_path / "files.parquet")), "content")
    both = [sorted(map(str, x.select("repo", "path", "language", "file_id", "ord", "content").collect())) for x in (stored, corpus.live_files(memory, "content"))]
    assert both[0] == both[1] and len(both[0]) == 3
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert all("content" not in line for line in plan.split("\n") if "Exchange hashpartitioning" in line)


def test_calls_have_no_depth_limit_and_cycles_count_whole(spark):
    edge = "repo string, path string, source string, target_path string, target string, kind string, resolved boolean"
    chain = [("long", "f", f"a{n}", "f", f"a{n + 1}", "call", True) for n in range(100)]
    ring = [("ring", "f", x, "f", y, "call", True) for x, y in (("m", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "z"), ("z", "z"))] + [("ring", "f", "q", "f", "r", "new", True), ("ring", "f", "z", "f", "w", "call", False)]
    got = {r.repo: r.depth for r in calls.call_depth(spark.createDataFrame(chain + ring, edge)).collect()}
    assert got == {"long": 101, "ring": 5}
    assert calls.call_depth(spark.createDataFrame([], edge)).count() == 0


def test_resolver_feeds_the_graph_where_no_path_is_given(spark):
    paths = ["frontend/src/components/Button.tsx", "frontend/src/app.ts", "backend/main.go", "backend/db/a.go", "backend/db/b.go", "x/y.ts", "x/z.ts"]
    files = spark.createDataFrame([("r", p) for p in paths], "repo string, path string")
    config = '{ // paths\n "compilerOptions": { "baseUrl": ".", "paths": { "@/*": ["./src/*"], } } }'
    contents = spark.createDataFrame([("r", "frontend/tsconfig.json", config), ("r", "backend/go.mod", "module example.com/app\n\ngo 1.22\n")], "repo string, path string, content string")
    rows = [(1, "frontend/src/app.ts", "@/components/Button", None), (2, "backend/main.go", "example.com/app/db", None), (3, "x/y.ts", "./z", None), (4, "x/y.ts", "react", None), (5, "x/z.ts", "whatever", "x/y.ts"), (6, "gone.ts", "./x/z", None), (7, "x/y.ts", None, None)]
    imports = spark.createDataFrame([(i, "r", p, s, t) for i, p, s, t in rows], "import_id long, repo string, path string, source string, resolved_path string")
    got = {(r.source, r.target) for r in graph.resolved_edges(imports, files, contents).collect()}
    assert got == {("frontend/src/app.ts", paths[0]), ("backend/main.go", "backend/db/a.go"), ("backend/main.go", "backend/db/b.go"), ("x/y.ts", "x/z.ts"), ("x/z.ts", "x/y.ts")}


def test_structural_clusters_and_examples(spark):
    part = [("r", f"p{n}", "p0") for n in range(4)] + [("r", f"q{n}", "q0") for n in range(4)] + [("r", f"s{n}", "s0") for n in range(4)] + [("r", "t0", "t0"), ("r", "t1", "t0")]
    clusters = spark.createDataFrame(part, "repo string, path string, component string")
    imports = spark.createDataFrame([("r", "p0", "x"), ("r", "p1", "x"), ("r", "p1", "x"), ("r", "p2", "y"), ("r", "q0", "x")], "repo string, path string, source string")
    cohesion = spark.createDataFrame([("r", "p0", 0.3), ("r", "q0", 0.5), ("r", "s0", 0.4), ("r", "t0", 0.9)], "repo string, component string, cohesion double")
    files = spark.createDataFrame([("r", f"f{n}") for n in range(20)], "repo string, path string")
    got = {r.component: (r.members, r.shared, r.prevalence) for r in mining.structural_clusters(clusters, imports, cohesion, files).collect()}
    assert got == {"p0": (4, ["x"], 0.2), "q0": (4, [], 0.2)}
    symbols = spark.createDataFrame([("r", "b.ts", n, "getIt", "function") for n in range(5)] + [("r", "a.ts", None, "Bad_one", "function"), ("r", "a.ts", 1, "Good", "class")], "repo string, path string, line int, name string, type string")
    rows = mining.naming_examples(symbols).filter("style = 'functions-camelcase'").collect()
    assert sorted((r.follows, r.rank, r.line) for r in rows) == [(False, 1, None), (True, 1, 0), (True, 2, 1), (True, 3, 2)]


def test_model_files_and_rule_details(spark):
    fresh = spark.createDataFrame([("r", "a", "b", True, False), ("r", "a", "c", False, False), ("q", "a", "b", False, True)], "repo string, source string, target string, crosses_boundary boolean, creates_cycle boolean")
    nodes = spark.createDataFrame([("r", "s2", 3), ("r", "s1", 9), ("r", "s3", 1), ("r", "s0", 0)], "repo string, path string, degree long")
    layers = spark.createDataFrame([("r", f"s{n}", "service") for n in range(4)], "repo string, path string, layer string")
    assert [tuple(r) for r in review.model_files(fresh, nodes, layers).collect()] == [("r", "a", "b", "s2")]
    rule = "rule_no long, description string, evidence array<struct<file:string,line:int,note:string>>, enhanced struct<description:string,rationale:string,stale:boolean>"
    made = spark.createDataFrame([(1, "d", [("a.ts", 3, None), ("b.ts", None, None), (None, 1, None), ("z", 1, None)], ("better", None, False)), (2, "e", None, None)], rule)
    results = spark.createDataFrame([(1, "r", "x", "valid", 1.0), (2, "r", "y", "violated", 0.1)], "rule_no long, repo string, id string, status string, score double")
    got = {r.rule_no: (r.description, r.evidence) for r in rules.rule_details(made, results).collect()}
    assert got == {1: ("better", ["a.ts:3", "b.ts"]), 2: ("e", [])}


def test_words_of_exports_and_comments(spark):
    files = spark.createDataFrame([("r", "a.ts")], "repo string, path string")
    nothing = spark.createDataFrame([], "repo string, path string, name string, parent_symbol string"), spark.createDataFrame([], "repo string, path string, source string, symbols array<string>")
    exports = spark.createDataFrame([("r", "a.ts", "openLedger"), ("r", "gone.ts", "lost")], "repo string, path string, name string")
    comments = spark.createDataFrame([("r", "a.ts", "// TODO: close ledger")], "repo string, path string, text string")
    got = {r.term: r.tf for r in semantic.file_tokens(files, *nothing, exports, comments).collect()}
    assert got == {"open": 1, "ledger": 2, "todo": 1, "close": 1}
