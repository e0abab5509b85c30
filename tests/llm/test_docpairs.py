from datetime import datetime

import pytest

from corpusloom.llm import docpairs

DOC = "Reads all records once more."
CASES = {
    "py": f'import os\n\n@dec\nasync def read_all(\n        a, b="):",\n) -> int:\n    # first\n    r"""{DOC}\n\n    :param a: x\n    """\n    if a:\n        return 1\n\n    return 2\n\ndef none():\n    x = 1\n    """{DOC}"""\n',
    "ts": f"/**\n * {DOC}\n * @param a x\n */\n@Dec()\nexport async function readAll(a: number) {{\n  const s = '}}';\n  return a;\n}}\n\n/** {DOC} */\n\nfunction none() {{}}\n// {DOC}\nfunction none2() {{}}\n",
    "java": f'class A {{\n    /** {DOC} */\n    @Deprecated\n    @SuppressWarnings("x")\n    public static int readAll(int a) {{\n        return a;\n    }}\n    /* {DOC} */\n    int none() {{ return 1; }}\n}}\n',
    "go": f"package a\n\n// {DOC}\n// More.\nfunc (x *T) ReadAll(a int) int {{\n\treturn a\n}}\n\n// {DOC}\n\nfunc None() {{}}\n",
    "rs": f"/// {DOC}\n#[inline]\npub(crate) fn read_all(a: i64) -> i64 {{\n    a\n}}\n// {DOC}\nfn none() {{}}\n",
}
NAMES = {"py": ("read_all", 4, 15), "ts": ("readAll", 6, 9), "java": ("readAll", 5, 7), "go": ("ReadAll", 5, 7), "rs": ("read_all", 3, 5)}


@pytest.mark.parametrize("ext", CASES)
def test_pairs(ext):
    for text in (CASES[ext], CASES[ext].replace("\n", "\r\n")):
        found = [f for f in docpairs.functions(text, ext) if not docpairs.is_trivial(f[3], f[0])]
        assert [(n, line, end) for n, line, end, _, _ in found] == [NAMES[ext]]
        assert DOC in found[0][3] and "return" in found[0][4] or ext == "rs"


@pytest.mark.parametrize(("doc", "name", "trivial"), [("", "f", True), ("Read all.", "readAll", True), ("TODO: document", "f", True), ("@param x the long thing here\n:return: a long text here", "f", True), ("reads every row", "f", False), ("The read all now", "readAll", True), ("Read all the old rows", "readAll", False), ("...", "f", True)])
def test_trivial(doc, name, trivial):
    assert docpairs.is_trivial(doc, name) is trivial


def test_operator(spark):
    now = datetime(2025, 1, 1)
    rows = [(n, f"a.{e}", t, "x") for n, (e, t) in enumerate(CASES.items())] + [(50, "a.py", None, "x"), (51, "a.py", "", "x"), (52, "a.json", "{}", "x"), (53, "b.py", "def f(" + "a, " * 40000, "x")]
    files = spark.createDataFrame(rows + rows, "file_id long, path string, content string, name string")
    symbols = [(n, NAMES[e][0], NAMES[e][1], "function", None) for n, e in enumerate(CASES)] + [(0, "none", 17, "function", None), (1, "none", 13, "method", None), (2, "readAll", 5, "class", None), (3, "ReadAll", 5, "function", now), (4, "read_all", 3, "method", None), (4, "read_all", 9, "function", None)]
    symbols = [s for s in symbols if s[:2] != (3, "ReadAll")] + [(3, "ReadAll", 5, "function", now)]
    frame = spark.createDataFrame(symbols * 2, "file_id long, name string, line int, type string, removed_at timestamp")
    got = sorted((r.file_id, r.name, r.line) for r in docpairs.documented_functions(files, frame).collect())
    assert got == [(0, "read_all", 4), (1, "readAll", 6), (2, "readAll", 5), (4, "read_all", 3)]
    assert docpairs.documented_functions(files.limit(0), frame).count() == 0


def test_every_symbol_has_a_signature(spark, sf):
    folder = sf.replace("0.001", "0.01")
    files = {r.file_id: r for r in spark.read.parquet(f"{folder}/files.parquet").collect()}
    symbols = spark.read.parquet(f"{folder}/symbols.parquet").filter("type in ('function', 'method') and removed_at is null").collect()
    missing = 0
    for s in symbols:
        f = files[s.file_id]
        pattern = docpairs.SIGNATURES.get(docpairs.LANGUAGES.get(f.path.rsplit(".")[-1]))
        if f.content and pattern:
            line = f.content.replace("\r\n", "\n").split("\n")[s.line - 1]
            missing += not any(m.group(m.lastindex) == s.name for m in pattern.finditer(line + "\n"))
    assert missing == 0 and len(symbols) > 1000


def test_words_of_other_languages_are_names_in_python_and_annotations_have_no_limit():
    text = 'def throw(x):\n    """Raises what was given to it."""\n    pass\n'
    assert [f[0] for f in docpairs.functions(text, "py")] == ["throw"]
    lines = "\n".join(f"    'role{n}'," for n in range(90))
    java = f"class A {{\n/** Deletes all of the given records. */\n@Allowed(\n{lines}\n)\npublic void remove() {{\n}}\n}}\n"
    assert [f[0] for f in docpairs.functions(java, "java")] == ["remove"]
