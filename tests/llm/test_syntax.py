import ast
import json
import random
import re
import sysconfig
import warnings
from pathlib import Path

import pytest

from corpusloom.llm import syntax

warnings.filterwarnings("ignore", category=SyntaxWarning)

GOOD = {
    "py": ['def f(a, b=")"):\n    """(doc"""\n    if a:\n        return {1: [2]}\n    # don\'t (\n    return f"{a}"\n', "x = (\n    1,\n    2)\nclass A: pass\n", "", "@dec(1)\nasync def f() -> int:\n    await g()\n", 's = """\n<<<<<<< HEAD\n=======\n"""\n'],
    "ts": ["export const f = (a: number): string => `x ${`y${a}`} ) {`;\n", "/* <<<<<<< HEAD\n=======\n*/\nconst r = /[({]+\\/x/g;\nlet s = '}';\n", "interface A { b?: string; c: () => void }\ntype X = { a: number } | null;\n"],
    "jsx": ["const A = () => {\n  return x / 2 / 3;\n};\n"],
    "go": ['package a\n\nimport (\n\t"fmt"\n)\n\nfunc f(a int, b ...string) (int, error) {\n\tr := \'}\'\n\ts := `{`\n\treturn 0, nil\n}\n'],
    "java": ['package a.b;\n\nimport java.util.List;\n\npublic class A {\n    @Override\n    public int f(List<String> x) {\n        char c = \'{\';\n        return x.size() > 1 ? 1 : 0;\n    }\n}\n'],
    "rs": ["use a::b;\n\n#[derive(Debug)]\nstruct A<'a> { b: &'a str }\n\nfn f<'a>(x: &'a str) -> char {\n    /* a /* b */ { */\n    let s = r#\"}\"#;\n    '{'\n}\n"],
    "json": ['{"a": [1, -2.5e3, true, null, "\\u00e9\\n"], "b": {}}', "[]", '"x"'],
    "yml": ["# c\na:\n  b: \"1\"\n  c: 'x: y'\nd:\n  - 1\n  - e: f\nt: |\n  any: thing\n   here\n", "---\na: {b: [1, 2]}\n", "- a\n- b\n"],
    "txt": ["((("],
}
BAD = {
    "py": ["def f(:\n    pass\n", "def f():\n    return (1\n", 'x = "abc\ny = 1\n', "def f():\n    a = 1\n   b = 2\n", "<<<<<<< HEAD\nx = 1\n=======\nx = 2\n>>>>>>> b\n", "function f() {\n  return 1;\n}\n", "def f():\n", "   1  import os\n   2  x = 1\n", "x = “a”\n", "Here is the updated code:\nx = 1\n", '"""open\n', "if x\n    y = 1\n"],
    "ts": ["function f() {\n  return 1;\n", "const a = 'x;\nconst b = 1;\n", "const a = `x;\n", "/* open\nlet a = 1;\n", "def f():\n    return 1\n", "const a =\n", "f((1);\n", "let a = [1, 2};\n", "> import a from 'b';\n> let x = 1;\n", "use crate::a::B;\n"],
    "go": ["package a\n\nfunc f() {\n\treturn\n", "public class A {\n}\n", "package a\n\nThe old module reads it.\n", 'package a\n\nvar x = "abc\n'],
    "java": ["package a\n", "public class A {\n    int f() { return 1; }\n", "public class A {\n    Here is the updated version:\n}\n", "import { a } from 'bcd';\n"],
    "rs": ["fn f() {\n    (1\n}\n", "fn f() {\n    let s = \"abc;\n}\n", "package a;\n", "def f():\n    pass\n", "fn f() {\n    /* open\n}\n"],
    "json": ['{"a": 1,}', '{"a": 1', "{'a': 1}", '{"a" 1}', "[1 2]", '{"a": 01}', '"abc', "<<<<<<< HEAD\n{}", "1 2"],
    "yml": ["a: \"open\nb: 1\n", "a:\n\tb: 1\n", "<<<<<<< HEAD\na: 1\n=======\na: 2\n", "a: [1, 2\nb: 3\n", "a:\n  b: 1\n c: 2\n"],
}


@pytest.mark.parametrize(("ext", "text"), [(e, t) for e, ts in GOOD.items() for t in ts])
def test_valid(ext, text):
    assert syntax.fault(text, ext) is None
    assert syntax.fault(text.replace("\n", "\r\n"), ext) is None


@pytest.mark.parametrize(("ext", "text"), [(e, t) for e, ts in BAD.items() for t in ts])
def test_invalid(ext, text):
    assert syntax.fault(text, ext) is not None


def test_lines_of_faults():
    assert syntax.fault("let a = 1;\n/* b\nc */\nlet d = 'x;\n", "ts") == ("unterminated literal", 4)
    assert syntax.fault("/*\n*/\nf();\ng(]);\n", "js") == ("unbalanced delimiter", 4)


def test_python_and_json_agree_with_their_parsers(spark, sf):
    rows = spark.read.parquet(sf.replace("0.001", "0.01") + "/files.parquet").filter("content <> ''").select("file_id", "path", "content").distinct().collect()
    checked = 0
    for r in rows:
        ext = r.path.rsplit(".")[-1]
        if ext in ("py", "json"):
            checked += 1
            try:
                ast.parse(r.content) if ext == "py" else json.loads(r.content)
                valid = True
            except ValueError:
                valid = False
            except SyntaxError:
                valid = False
            assert (syntax.fault(r.content, ext) is None) == valid, r.path
    assert checked > 100


def test_operator(spark):
    rows = [(1, "r", "a.py", "x = (", 9), (1, "r", "a.py", "x = (", 9), (2, "r", "b.py", "x = 1\n", 9), (3, "r", "C.PY", "x = )", 9), (4, "r", "d.py", None, 9), (5, "r", "e.py", "", 9), (6, "r", "f.txt", "(", 9), (7, None, "g.json", "{", 9), (8, "r", None, "(", 9), (9, "r", "h.py", "x = 1\n" * 20000 + "(", 9)]
    files = spark.createDataFrame(rows, "file_id long, repo string, path string, content string, line int")
    found = syntax.invalid_files(files)
    assert sorted(r.file_id for r in found.collect()) == [1, 3, 7, 9]
    rates = {(r.repo, r.language): (r.files, r.invalid) for r in syntax.invalid_rates(files, found).collect()}
    assert rates == {("r", "python"): (4, 3), (None, "json"): (1, 1)}
    assert {(r.repo, r.language): (r.files, r.invalid) for r in syntax.checked_rates(files).collect()} == rates
    assert syntax.invalid_files(files.limit(0)).count() == 0 and syntax.checked_rates(files.limit(0)).count() == 0


#: Valid code that word neighbours alone would misjudge, and faults that they would miss.
TRICKY_GOOD = [
    ("py", "x = 1 if a else 2\nmetavar, = f(1)\nfor x, in y: pass\nprint(f'{f'{a}' if b else ''}')\n"),
    ("py", 'def f(a, /, *, b=1, **c):\n    """doc\n    (\n    """\n    return """\n    %s\n    """ % (a[:, 1:], not b, lambda: 0, [i async for i in c])\n'),
    ("py", "match = 1\nmatch x:\n    case [1, *_]: pass\n    case _:\n        type2 = ...\ntry:\n    pass\nexcept* E as e:\n    raise X from None\nelse: pass\n"),
    ("jsx", "const a = (\n  <p className=\"b\">don't stop {x ? <b>it's</b> : null}<br/></p>\n);\nconst c = a < b && c > d;\n"),
    ("tsx", "const f = <T,>(x: T) => x;\nexport const A = () => <><i/>{list.map((x) => <li key={x}>{`}${x}`}</li>)}</>;\n"),
    ("js", "f(function () {\n}\n)\n"), ("ts", "const a = [{ b: 'c' as const, d: ['e'] as const }];\nconst { f } = g;\n"),
    ("java", "@A({B.class, C.class})\nclass D {\n    int[] x = {1, 2};\n    enum E { X, Y }\n    String[] f() { return new String[] { \"a\" }; }\n}\n"),
    ("yml", "a: some text\n  that goes on\nb:\n  - one item\n    over two lines\n  - c: d\n"),
]
TRICKY_BAD = [
    ("py", "x = = 1\n"), ("py", "f(a b)\n"), ("py", "x = a.\n"), ("py", "try:\n    pass\nx = 1\n"), ("py", "if a:\n    b\nexcept X:\n    c\n"), ("py", "return return\n"), ("py", "x = (1,, 2)\n"), ("py", "print 'x'\n"), ("py", "x = f'{a'\n"),
    ("js", "function { }\n"), ("ts", "const = 5;\n"), ("jsx", "const a = <div><p></div>;\n"), ("jsx", "const a = <div>\n"), ("java", "class A { int x }\n"), ("yml", "a: text\n  b: c\n"),
]


@pytest.mark.parametrize(("ext", "text"), TRICKY_GOOD)
def test_tricky_valid(ext, text):
    assert syntax.fault(text, ext) is None


@pytest.mark.parametrize(("ext", "text"), TRICKY_BAD)
def test_tricky_invalid(ext, text):
    assert syntax.fault(text, ext) is not None


def test_standard_library():
    """At most one in a hundred of its files is flagged; nearly all are once they are cut, spliced or renamed."""
    rng = random.Random(3)
    texts = [p.read_text("utf-8", "ignore") for p in sorted(Path(sysconfig.get_paths()["stdlib"]).glob("*.py"))]
    assert len(texts) > 100 and sum(syntax.fault(t, "py") is not None for t in texts) <= 0.01 * len(texts)

    def invalid(t):
        try:
            ast.parse(t)
        except (SyntaxError, ValueError):
            return True
        return False

    broken = [t[: rng.randrange(len(t) // 3, len(t))] for t in texts if len(t) > 300]
    for t in texts:
        m = rng.choice(list(re.finditer(r"\w+|[-+*/=.,()\[\]{}:]", t)) or [re.match("", t)])
        broken += [t[: m.start()] + t[m.end() :], t[: m.end()] + " " + t[m.start() :]]
    broken = [t for t in broken if invalid(t)]
    assert len(broken) > 150 and sum(syntax.fault(t, "py") is not None for t in broken) >= 0.9 * len(broken)
    long = [t for t in texts if len(t) > 1000]
    for ext in ("ts", "js", "go", "java", "rs", "json"):
        assert sum(syntax.fault(t, ext) is None for t in long) <= 0.01 * len(long)


def test_nesting_has_no_limit():
    assert syntax.fault("x = " + "(" * 500 + "1" + ")" * 500 + "\n", "py") is None
    assert syntax.fault("x = " + "[" * 500 + "1" + "]" * 499 + "\n", "py") is not None
