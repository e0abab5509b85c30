"""Symbol spans and call sites from source contents.

Python is read with its own parser, and by its lines where that fails; the brace languages are read over code whose
comments and strings are blanked, with the line patterns of ``extract`` for
declarations and a brace count for their ends. One pass over a partition's
contents gives both tables; nothing but the small helpers here runs in Python.
"""

from __future__ import annotations

import ast
import keyword
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.extract import SYMBOLS, family

LONGEST_CALLEE = 120

# Words that branch, words before a bracket that are no calls, and kinds of relations.
_BRANCH = re.compile(r"\b(?:if|for|while|case|catch|match|select)\b|&&|\|\||(?<![?:])\?(?![.?:])")
_NO_CALL = frozenset("if for while switch catch return function func fn def match with new throw typeof super await async sizeof print_ do else in of and or not select go defer let const var class".split())
_COMMENTS = r"//[^\n]*|/\*.*?\*/"
_DOUBLE, _SINGLE, _RAW = r'"(?:[^"\\\n]|\\.)*"', r"'(?:[^'\\\n]|\\.)*'", r"`(?:[^`\\]|\\.)*`"
_REGEX = r"(?<=[=(,:!&|?;{}]) ?/(?![*/ ])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
_OPAQUE = {
    "script": re.compile(f"{_COMMENTS}|{_DOUBLE}|{_SINGLE}|{_RAW}|{_REGEX}", re.S),
    "go": re.compile(f"{_COMMENTS}|{_DOUBLE}|{_SINGLE}|`[^`]*`", re.S),
    "java": re.compile(f'{_COMMENTS}|"""(?:[^"\\\\]|\\\\.|"(?!""))*"""|{_DOUBLE}|{_SINGLE}', re.S),
    "rust": re.compile(_COMMENTS + r"""|\bb?r(#*)".*?"\1|"(?:[^"\\]|\\.)*"|'(?:[^'\\\n]|\\[^\n]{1,8})'""", re.S),
}
_PY_OPAQUE = re.compile(r'#[^\n]*|"""(?:[^"\\]|\\.|"(?!""))*"""|' + r"'''(?:[^'\\]|\\.|'(?!''))*'''|" + f"{_DOUBLE}|{_SINGLE}", re.S)
_PY_CALL = re.compile(r"(?<![\w.])([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)[ \t]*\(")
_PY_BRANCH = re.compile(r"\b(?:if|elif|for|while|except|and|or)\b|^case\b")
_PY_BASES = re.compile(r"class\s+\w+\s*\(([^()]*)")
_RECEIVER = re.compile(r"func\s*\(\s*\w*\s*\*?\s*(\w+)")
_METHOD = re.compile(r"^\s+(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*([A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\([^;]*$")
_CALL = re.compile(r"(?<![\w$.])(new\s+)?([A-Za-z_$][\w$]*(?:(?:\.|::)[A-Za-z_$][\w$]*)*)\s*(?:<[\w, ]*>)?\(")
_RELATION = re.compile(r"\b(extends|implements)\s+([A-Za-z_$][\w$.]*(?:\s*,\s*[A-Za-z_$][\w$.]*)*)")
_PATTERNS: dict[str, list[tuple[str, re.Pattern[str]]]] = {}
for _family, _type, _pattern in SYMBOLS:
    _PATTERNS.setdefault(_family, []).append((_type, re.compile(_pattern)))

Symbol = tuple[str, str, int, int, str | None, int]  # name, type, line, end line, parent, complexity
Call = tuple[str, str, str | None, int, str]  # caller, callee, root, line, kind


def python_facts(text: str) -> tuple[list[Symbol], list[Call]]:
    """Symbols and calls of Python code; a syntax error raises."""
    symbols, calls = [], []
    branches = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.BoolOp, ast.match_case)

    def walk(node: ast.AST, parent: str | None, caller: str) -> None:
        for child in ast.iter_child_nodes(node):
            inner_parent, inner_caller = parent, caller
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                inside = isinstance(node, ast.ClassDef)
                complexity = 1 + sum(isinstance(x, branches) for x in ast.walk(child))
                symbols.append((child.name, "method" if inside else "function", child.lineno, child.end_lineno, parent if inside else None, complexity))
                inner_caller = f"{parent}.{child.name}" if inside else child.name
            elif isinstance(child, ast.ClassDef):
                symbols.append((child.name, "class", child.lineno, child.end_lineno, None, 1))
                for base in child.bases:
                    calls.append((child.name, ast.unparse(base)[:LONGEST_CALLEE], None, child.lineno, "extends"))
                inner_parent = child.name
            elif isinstance(child, ast.Call):
                name = ast.unparse(child.func)[:LONGEST_CALLEE]
                calls.append((caller, name, name.split(".")[0] if "." in name else None, child.lineno, "call"))
            walk(child, inner_parent, inner_caller)

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        walk(ast.parse(text), None, "")
    return symbols, calls


def _header_parses(line: str) -> bool:
    """Whether a declaration that ends on its line is one; of others the line cannot tell."""
    if not line.endswith(":"):
        return True
    try:
        ast.parse(f"{line} pass")
    except (SyntaxError, ValueError):
        return False
    return True


def python_lines(text: str) -> tuple[list[Symbol], list[Call]]:
    """Symbols and calls of Python code that does not parse, by its lines: a block ends before the next line that is indented no further.

    A declaration whose own line is the broken spot is lost.
    """

    def blanked(m: re.Match[str]) -> str:
        inside = m.group().count("\n")
        return "" if m.group()[0] == "#" else '""' + "\n" * inside + "\0" * bool(inside)  # the mark tells that the line goes on from a string

    symbols: list[Symbol] = []
    calls: list[Call] = []
    open_: list[list] = []  # [name, type, first line, indent, parent, branches, caller inside]
    last = 0

    def close(indent: int) -> None:
        while open_ and indent <= open_[-1][3]:
            name, type_, first, _, parent, branches, _ = open_.pop()
            symbols.append((name, type_, first, last, parent, 1 if type_ == "class" else 1 + branches))

    for n, line in enumerate(_PY_OPAQUE.sub(blanked, text).split("\n"), start=1):
        goes_on, line = line.startswith("\0"), line.replace("\0", "").expandtabs()
        bare = line.strip()
        if not bare and not goes_on:
            continue
        if not goes_on and bare[0] not in ")]}":
            close(len(line) - len(line.lstrip()))
        last = n
        declared = next(((m.group(1), type_) for type_, pattern in _PATTERNS["python"] if (m := pattern.match(bare)) and _header_parses(bare)), None)
        caller = open_[-1][6] if open_ else ""
        if declared and not goes_on:
            name, type_ = declared
            owner = open_[-1][0] if open_ and open_[-1][1] == "class" else None
            own = caller if type_ == "class" else f"{owner}.{name}" if owner else name
            if type_ == "class" and (m := _PY_BASES.match(bare)):
                calls += [(name, base.strip()[:LONGEST_CALLEE], None, n, "extends") for base in m.group(1).split(",") if base.strip() and "=" not in base]
            open_.append([name, "method" if owner and type_ == "function" else type_, n, len(line) - len(line.lstrip()), owner if type_ == "function" else None, 0, own])
            caller = own
        branches = len(_PY_BRANCH.findall(bare))
        for o in open_:
            o[5] += branches
        for m in _PY_CALL.finditer(bare):
            callee = m.group(1)[:LONGEST_CALLEE]
            if not keyword.iskeyword(callee) and not re.search(r"\b(?:def|class)\s+$", bare[: m.start()]):
                calls.append((caller, callee, callee.split(".")[0] if "." in callee else None, n, "call"))
    close(-1)
    return sorted(symbols, key=lambda s: (s[2], s[0])), calls


def brace_facts(text: str, kind: str) -> tuple[list[Symbol], list[Call]]:
    """Symbols and calls of a brace language."""
    code = _OPAQUE[kind].sub(lambda m: ("" if m.group()[:2] in ("//", "/*") else '""') + "\n" * m.group().count("\n"), text)
    lines = code.split("\n")
    symbols: list[Symbol] = []
    calls: list[Call] = []
    open_: list[list] = []  # [name, type, first line, depth, parent, branches, entered]
    depth = 0
    for n, line in enumerate(lines, start=1):
        bare = line.strip()
        declared = None
        for type_, pattern in _PATTERNS.get(kind, []):
            if m := pattern.match(bare):
                declared = m.group(1), type_
                break
        owner = next((o[0] for o in reversed(open_) if o[1] == "class"), None)
        if declared is None and kind == "script" and open_ and open_[-1][1] == "class" and (m := _METHOD.match(line)) and m.group(1) not in _NO_CALL:
            declared = m.group(1), "method"
        if declared:
            name, type_ = declared
            inside = bool(open_) and open_[-1][1] == "class"
            parent = owner if inside else None
            if kind == "rust" and not parent and (m := next((o for o in reversed(open_) if o[1] == "impl"), None)):
                parent = m[0]
            if kind == "go" and type_ == "function" and (m := _RECEIVER.match(bare)):
                parent = m.group(1)
            if type_ == "function" and parent:
                type_ = "method"
            open_.append([name, type_, n, depth, parent, 0, False])
        elif kind == "rust" and (m := re.match(r"impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(\w+)", bare)):
            open_.append([m.group(1), "impl", n, depth, None, 0, False])
        branches = len(_BRANCH.findall(bare))
        for o in open_:
            o[5] += branches
        scope = next((o for o in reversed(open_) if o[1] in ("function", "method")), None)
        caller = (f"{scope[4]}.{scope[0]}" if scope[4] else scope[0]) if scope else ""
        for m in _CALL.finditer(bare):
            callee = m.group(2)[:LONGEST_CALLEE]
            if callee in _NO_CALL or (declared and callee == declared[0]):
                continue
            root = re.split(r"\.|::", callee)[0]
            calls.append((caller, callee, root if root != callee else None, n, "new" if m.group(1) else "call"))
        for m in _RELATION.finditer(bare):
            for base in m.group(2).split(","):
                calls.append((declared[0] if declared else caller, base.strip(), None, n, m.group(1)))
        for c in line:
            if c == "{":
                depth += 1
                for o in open_:
                    o[6] |= depth > o[3]
            elif c == "}":
                depth -= 1
                while open_ and open_[-1][6] and depth <= open_[-1][3]:
                    name, type_, first, _, parent, count, _ = open_.pop()
                    if type_ != "impl":
                        symbols.append((name, type_, first, n, parent, 1 + count))
        if open_ and not open_[-1][6] and bare.endswith(";"):  # a declaration without a body
            name, type_, first, _, parent, count, _ = open_.pop()
            symbols.append((name, type_, first, n, parent, 1 + count))
    symbols += [(o[0], o[1], o[2], len(lines), o[4], 1 + o[5]) for o in open_ if o[1] != "impl"]
    return sorted(symbols, key=lambda s: (s[2], s[0])), calls


def facts(text: str, kind: str) -> tuple[list[Symbol], list[Call], str]:
    """Symbols, calls and the parser used; Python that does not parse is read by its lines."""
    text = text.replace("\r\n", "\n")
    if kind != "python":
        return *brace_facts(text, kind), "braces"
    try:
        return *python_facts(text), "ast"
    except (SyntaxError, ValueError, RecursionError):
        return *python_lines(text), "regex"


def _parsed(files: DataFrame, calls: bool, schema: str) -> DataFrame:
    rows = files.filter("content is not null and content <> ''").select("file_id", family(F.col("language")).alias("kind"), "content").filter(F.col("kind").isin("python", *_PATTERNS))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in schema.split(", ")]
        kinds = [{"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[part.split()[1]] for part in schema.split(", ")]
        for batch in batches:
            out: list[tuple] = []
            for i, kind, text in zip(*(c.to_pylist() for c in batch.columns)):
                symbols, sites, parser = facts(text, kind)
                out += [(i, *s) for s in sites] if calls else [(i, *s, parser) for s in symbols]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * len(names), kinds)], names)

    return rows.mapInArrow(parse, schema)


def parsed_symbols(files: DataFrame) -> DataFrame:
    """(file_id, name, type, line, end_line, body_size, parent_symbol, complexity, parser) of each declaration.

    ``files`` is ``live_files(files, "content")``. Null and empty contents and other
    languages have none. Python that does not parse is read by its lines (parser
    ``regex``).
    """
    rows = _parsed(files, False, "file_id bigint, name string, type string, line int, end_line int, parent_symbol string, complexity int, parser string")
    return rows.withColumn("body_size", F.col("end_line") - F.col("line") + 1)


def parsed_calls(files: DataFrame) -> DataFrame:
    """(file_id, caller, callee, callee_root, line, kind) of each call site; '' calls from outside any function."""
    return _parsed(files, True, "file_id bigint, caller string, callee string, callee_root string, line int, kind string")
