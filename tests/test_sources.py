import subprocess
from datetime import datetime

from corpusloom.functions import paths
from corpusloom.operators import corpus, extract, mining, overview
from corpusloom.sources import git, sinks, tree
from corpusloom.streaming import scan


def test_tree(spark, tmp_path):
    for name, text in {"pkg/__init__.py": "x", "__tests__/a.test.ts": "x", ".github/c.ts": "x", ".x/d.ts": "x", "gen/x.ts": "x", "a/gen/y.ts": "x", "node_modules/z.js": "x", "big.py": "x" * 200, "empty.py": "", "readme.md": "x", "src/é.go": "package é"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (tmp_path / ".gitignore").write_text("gen\n")
    rows = tree.read_tree(spark, str(tmp_path), ["node_modules/**"], repo="r", maxBytes="100").orderBy("ord").collect()
    assert {r.path for r in rows} == {"pkg/__init__.py", "__tests__/a.test.ts", ".github/c.ts", "gen/x.ts", "src/é.go"}
    assert [r.ord for r in rows] == list(range(5)) and all(r.repo == "r" and len(r.hash) == 16 for r in rows)
    assert tree.read_tree(spark, str(tmp_path), maxFiles="2").count() == 2
    (tmp_path / "none").mkdir()
    assert tree.read_tree(spark, str(tmp_path / "none")).count() == 0


def test_git(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=A | B", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    for k, message in enumerate(["feat: one | two", "fix: three"]):
        (tmp_path / "a.ts").write_text("import x from './y'\n" * (k + 1))
        run("add", ".")
        run("commit", "-qm", message)
    log = git.read_log(spark, [str(tmp_path), "/nowhere"])
    assert [(r.author, r.message) for r in log.collect()] == [("A | B", "fix: three"), ("A | B", "feat: one | two")]
    assert git.authors(log).first().commits == 2 and git.read_log(spark, [str(tmp_path)], 1).count() == 1
    assert "+import x" in git.read_diff(spark, [str(tmp_path)]).first().diff
    lines = spark.createDataFrame([("h|n|e|d|a | b",), ("h|n|e|d",), ("h|n",), ("h | n | e || m",)], "line string")
    assert [tuple(r) for r in git.parse_log_lines(lines).collect()] == [("h", "n", "d", "b"), ("h", "n", "d", "d"), ("h", "n", "e", "m")]


def files(spark, rows):
    return spark.createDataFrame([(n, "r", p, lang, t) for n, (p, lang, t) in enumerate(rows)], "file_id long, repo string, path string, language string, content string")


def test_line_extraction(spark):
    code = files(spark, [
        ("a.ts", "typescript", "import { A, B as C } from './x'\nimport * as n from 'm'\r\nimport d from \"e\"\nimport 'side'\nconst q = require('z')\nimport {\n  a } from './lost'\nexport async function f() {}\nexport const g = (a: number) => a\nexport default class K {}\ninterface I {}\ntype T = string\n// TODO: x\n"),
        ("b.py", "python", "import os\nfrom a.b import c\nasync def f(x):\n    pass\nclass _C:\n"),
        ("c.go", "go", 'package c\nimport (\n\t"fmt"\n\tx "y/z"\n)\nvar s = []string{\n\t"no"\n}\nimport "one"\nfunc (t *T) Run() {}\ntype T struct {\n'),
        ("D.java", "java", "import java.util.List;\npublic class D {\n    private static int f(int a) {\n"),
        ("e.rs", "rust", "use a::b::{C, D};\npub fn f() {}\nstruct S;\n"), ("n.ts", "typescript", None),
    ])
    got = sorted((r.file_id, r.line, r.source) for r in extract.line_imports(code).collect())
    assert got == [(0, 1, "./x"), (0, 2, "m"), (0, 3, "e"), (0, 4, "side"), (0, 5, "z"), (1, 1, "os"), (1, 2, "a.b"), (2, 3, "fmt"), (2, 4, "y/z"), (2, 9, "one"), (3, 1, "java.util.List"), (4, 1, "a::b")]
    symbols = sorted((r.file_id, r.name, r.type, r.exported) for r in extract.line_symbols(code).collect())
    assert symbols == [(0, "I", "interface", False), (0, "K", "class", True), (0, "T", "type", False), (0, "f", "function", True), (0, "g", "function", True), (1, "_C", "class", False), (1, "f", "function", True), (2, "Run", "function", True), (2, "T", "class", True), (3, "D", "class", True), (3, "f", "method", False), (4, "S", "class", False), (4, "f", "function", True)]
    assert sorted((r.type, r.name) for r in extract.line_exports(code).collect()) == [("default", "K"), ("named", "f"), ("named", "g")]
    assert [r.marker for r in extract.marker_comments(code).collect()] == ["TODO"]


def test_mined_patterns(spark):
    rows = [(f"src/services/s{n}.ts", "typescript", "import a from './a'\nexport async function f() { try { } catch {} }\n") for n in range(6)] + [("app/page.tsx", "typescript", "export default function P() {}"), ("server/x.test.ts", "typescript", "x"), ("server/y.test.ts", "typescript", "x"), ("server/y.ts", "typescript", None)]
    symbols = spark.createDataFrame([("r", "src/services/s0.ts", f"fn{k}", "function") for k in range(9)] + [("r", "src/services/s0.ts", "Bad_name", "function")], "repo string, path string, name string, type string")
    imports = spark.createDataFrame([("r", f"src/services/s{n}.ts", "./a", ["Result"]) for n in range(6)] + [("r", "app/page.tsx", "../x/routes/y", None)], "repo string, path string, source string, symbols array<string>")
    got = {r.pattern: (r.matched, r.population) for r in mining.mine_patterns(files(spark, rows), symbols, imports).collect()}
    assert got["naming-functions-camelcase"] == (9, 10) and got["error-handling-try-catch"] == (6, 10) and got["async-await-pattern"] == (6, 10)
    assert got["error-handling-result-pattern"] == (6, 10) and got["imports-relative"] == (7, 7) and got["testing-colocated"] == (2, 2) and got["testing-naming-test"] == (2, 2)
    assert got["architecture-monorepo-frontend-backend"] == (1, 1) and got["exports-named-only"] == (6, 10)
    assert "naming-functions-snake-case" not in got and "naming-files-kebab-case" not in got


def test_live_files_take_the_latest_scan(spark):
    at = [datetime(2025, 1, k) for k in (1, 2, 3)]
    rows = [(1, "r", "./a.py", 0, "old", at[0], None), (2, "r", "a.py", 1, "new", at[1], None), (3, "r", "gone.py", 2, "x", at[0], at[1]), (4, "r", None, 3, "x", at[0], None), (2, "r", "a.py", 1, "new", at[1], None)]
    raw = spark.createDataFrame(rows, "file_id long, repo string, path string, ord long, content string, scanned_at timestamp, removed_at timestamp")
    assert [(r.path, r.file_id, r.content, r.language) for r in corpus.live_files(raw, "content").collect()] == [("a.py", 2, "new", "python")]


def test_overview(spark):
    imports = spark.createDataFrame([("r", "a", "react-dom", None), ("r", "b", "express", None), ("q", "a", "./x", "x"), ("r", "c", "@s/p/q", None), ("r", "d", "@s/p", None)], "repo string, path string, source string, resolved_path string")
    assert [(r.repo, r.framework) for r in overview.frameworks(imports).collect()] == [("r", "React")]
    assert [(r.package, r.files) for r in overview.external_packages(imports).collect()] == [("@s/p", 2)]


def test_streams_match_batches(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/files.parquet").filter("content is not null")
    sinks.write_table(batch.repartition(3), str(tmp_path), "files")
    stream = scan.latest_files(scan.file_stream(spark, str(tmp_path / "files.parquet"), batch.schema, 1), "2000 days")
    for name, rows, mode in (("syms", scan.symbol_stream(stream), "append"), ("langs", scan.language_counts(stream), "complete")):
        q = rows.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
    want = extract.line_symbols(batch.dropDuplicates(["file_id"]).withColumn("language", paths.language(batch.path)))
    assert spark.table("syms").count() == want.count() > 0
    assert spark.table("langs").groupBy().sum("files").first()[0] == batch.dropDuplicates(["file_id"]).count()


def test_parsed_facts(spark, sf):
    from corpusloom.operators import parse

    code = files(spark, [
        ("a.ts", "typescript", "import x from 'y';\nexport class A extends B {\n  run(a: number) {\n    if (a) { return this.go(a); }\n    const r = /[({]+/g;\n    return new Thing('}');\n  }\n}\nfunction f(): void { g(); }\nf();\n"),
        ("b.py", "python", "class A(Base):\n    def run(self, x):\n        if x and y:\n            return os.path.join(x)\n\ndef f():\n    pass\nf()\n"),
        ("c.go", "go", "package c\n\nfunc (x *T) Run(a int) int {\n\treturn fmt.Sum(a)\n}\n"), ("d.py", "python", "def f(:\n"), ("e.ts", "typescript", None), ("f.rs", "rust", "impl<'a> S<'a> {\n    pub fn run(&self) -> char { '{' }\n}\n"),
    ])
    symbols = sorted((r.file_id, r.name, r.type, r.line, r.end_line, r.parent_symbol, r.complexity) for r in parse.parsed_symbols(code).collect())
    assert symbols == [(0, "A", "class", 2, 8, None, 2), (0, "f", "function", 9, 9, None, 1), (0, "run", "method", 3, 7, "A", 2), (1, "A", "class", 1, 4, None, 1), (1, "f", "function", 6, 7, None, 1), (1, "run", "method", 2, 4, "A", 3), (2, "Run", "method", 3, 5, "T", 1), (5, "run", "method", 2, 2, "S", 1)]
    calls = {(r.file_id, r.caller, r.callee, r.callee_root, r.kind) for r in parse.parsed_calls(code).collect()}
    assert {(0, "A.run", "this.go", "this", "call"), (0, "A.run", "Thing", None, "new"), (0, "A", "B", None, "extends"), (0, "f", "g", None, "call"), (0, "", "f", None, "call"), (1, "A.run", "os.path.join", "os", "call"), (1, "A", "Base", None, "extends"), (1, "", "f", None, "call"), (2, "T.Run", "fmt.Sum", "fmt", "call")} == calls
    raw = spark.read.parquet(sf.replace("0.001", "0.01") + "/files.parquet")
    got = {(r.file_id, r.name, r.line): (r.type, r.end_line) for r in parse.parsed_symbols(corpus.live_files(raw, "content")).collect()}
    known = spark.read.parquet(sf.replace("0.001", "0.01") + "/symbols.parquet").filter("removed_at is null and end_line is not null and type in ('function', 'method', 'class')").distinct().collect()
    same = sum(got.get((r.file_id, r.name, r.line)) == (r.type, r.end_line) for r in known)
    assert same > 0.95 * len(known)


def test_python_that_does_not_parse_is_read_by_its_lines():
    from corpusloom.operators import parse

    good = 'import os\n\n\nclass A(Base):\n    """Text\n    def no(): open(1)\n    """\n\n    def one(self, x):\n        if x:\n            return helper(x)\n        # run(x)\n\n    async def two(self):\n        return os.path.join("def f():", self.one(1))\n\n\ndef main():\n    def inner():\n        pass\n    A()\n    text = """a\nb\n"""\n'
    symbols, calls, parser = parse.facts(good, "python")
    assert parser == "ast"
    found, sites, parser = parse.facts(good + "\nx = = 1\n", "python")
    assert parser == "regex" and sorted(found) == sorted(symbols) and sorted(sites, key=str) == sorted(calls, key=str)
    assert [s[0] for s in parse.facts("def a():\n    b(\n\ndef c():\n    d()\n", "python")[0]] == ["a", "c"]
