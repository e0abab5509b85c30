"""Functions paired with their documentation.

Signatures are found with one pattern for each language. A body ends where an
indentation stack (Python) or a brace stack over the blanked code (the others)
returns to the signature's level. Documentation is the docstring in Python and
else the documentation comment at line distance one above the signature, with
only annotations or attributes between.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.syntax import LANGUAGES, Fault, blank, extension

#: Words that must remain beside the words of the name.
MIN_WORDS = 3

# Words that open a bracket but name no function.
_NOT_NAMES = frozenset("if for while switch catch return function with do else new throw await typeof super constructor_ synchronized try case in of".split())
SIGNATURES = {
    "python": re.compile(r"(?m)^[ \t]*(?:async[ \t]+)?def[ \t]+(\w+)"),
    "go": re.compile(r"(?m)^func[ \t]*(?:\([^()\n]*\)[ \t]*)?([^\W\d]\w*)[ \t]*[\[(]"),
    "rust": re.compile(r'(?m)^[ \t]*(?:pub(?:\([^()\n]*\))?[ \t]+)?(?:(?:default|const|async|unsafe|extern(?:[ \t]+"[^"\n]*")?)[ \t]+)*fn[ \t]+(?:r#)?(\w+)'),
    "java": re.compile(r"(?m)^[ \t]*(?:@\w+(?:\([^()\n]*\))?[ \t]+)*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)[ \t]+)*(?:<[^()\n]*>[ \t]*)?(?:[\w.$]+(?:<[^()\n]*>)?(?:\[\])*[ \t]+)?([A-Za-z_$][\w$]*)[ \t]*\("),
    "javascript": re.compile(
        r"(?m)^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?(?:"
        r"(?:async[ \t]+)?function[ \t]*\*?[ \t]*([\w$]+)"
        r"|(?:const|let|var)[ \t]+([\w$]+)[^=\n;]*=[ \t]*(?:async\b[ \t]*)?(?:function\b|\(|<|[\w$]+[ \t]*=>)"
        r"|(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set)[ \t]+)*\*?(?:(?:async)[ \t]+)?([#\w$]+)[ \t]*(?:<[^()\n]*>)?\((?![^\n]*;[ \t]*\r?$))"
    ),
}
SIGNATURES["typescript"] = SIGNATURES["javascript"]

_TRIPLE = r'"""(?:[^"\\]|\\.|"(?!""))*"""|' + r"'''(?:[^'\\]|\\.|'(?!''))*'''"
_PLAIN = r'"(?:[^"\\\n]|\\.)*"|' + r"'(?:[^'\\\n]|\\.)*'"
_HEAD = re.compile(rf"{_TRIPLE}|{_PLAIN}|\#[^\n]*|[()\[\]{{}}:]", re.S)
_DOCSTRING = re.compile(rf"(?:[ \t]*(?:\#[^\n]*)?\r?\n)*[ \t]*[rRuU]?({_TRIPLE}|{_PLAIN})[ \t]*(?:\#[^\n]*)?(?=\r?\n|;|\Z)", re.S)
_ANNOTATION = re.compile(r"@[\w.]+(?:\s*\(.*\))?\s*$|#!?\[.*\]\s*$")
_TAG = re.compile(r"(?:@\w+|:\w+(?:[ \t]+[\w.*]+)*:|\\\w+\b)")
_WORD = re.compile(r"[^\W_]+")
_PART = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+|[^\W\d_]+")
_BRACE = re.compile(r"[{};]")


def name_words(name: str) -> set[str]:
    """The words of an identifier, and the identifier itself, in lower case."""
    return {w.lower() for w in _PART.findall(name)} | {w.lower() for w in _WORD.findall(name)}


def is_trivial(doc: str, name: str, min_words: int = MIN_WORDS) -> bool:
    """Whether fewer than ``min_words`` words remain beside tag lines and the words of the name."""
    own, left = name_words(name), 0
    for line in doc.split("\n"):
        if not _TAG.match(line.strip()):
            left += sum(w.lower() not in own for w in _WORD.findall(line))
    return left < min_words


def _strip_block(lines: list[str]) -> str:
    text = "\n".join(lines).strip()
    text = text[3:-2] if text.endswith("*/") else text[3:]
    return "\n".join(re.sub(r"^\s*\*?[ \t]?", "", x).rstrip() for x in text.split("\n")).strip()


def doc_above(lines: list[str], k: int, language: str) -> str | None:
    """The documentation comment that ends directly above line ``k`` (from 0), without marks; None if there is none."""
    j = k - 1
    mark = {"go": "//", "rust": "///"}.get(language)
    attribute = 0  # attributes are as much as the language has them
    while j >= 0 and language != "go":
        bare = lines[j].strip()
        if _ANNOTATION.match(bare):
            j -= 1
            continue
        # the last line of an annotation over several lines
        if bare and bare[-1] in ")]" and not bare.startswith(("//", "*", "/*")):
            depth, i = 0, j
            while i >= 0:
                depth += sum(map(lines[i].count, ")]")) - sum(map(lines[i].count, "(["))
                if depth <= 0:
                    break
                i -= 1
            if i >= 0 and depth <= 0 and re.match(r"@\w|#!?\[", lines[i].strip()):
                j, attribute = i - 1, attribute + 1
                continue
        break
    if mark:
        run = []
        while j >= 0:
            bare = lines[j].strip()
            if bare.startswith(mark) and not (language == "rust" and bare.startswith("////")):
                if not (language == "go" and re.match(r"//(?:go:|nolint|\s*\+build)", bare)):
                    run.append(bare[len(mark) :].strip())
            elif not (language == "rust" and run and _ANNOTATION.match(bare)):
                break
            j -= 1
        return "\n".join(reversed(run)) if run else None
    if j < 0 or not lines[j].rstrip().endswith("*/"):
        return None
    i = j
    while i >= 0 and "/*" not in lines[i]:
        i -= 1
    if i < 0:
        return None
    start = lines[i].rfind("/*")
    block = [lines[i][start:], *lines[i + 1 : j + 1]]
    if lines[i][:start].strip() or not block[0].startswith("/**") or block[0].startswith("/**/"):
        return None
    return _strip_block(block)


def _python_doc(text: str, at: int) -> tuple[str | None, int]:
    """(docstring, offset after the header's colon) of the def whose name ends at ``at``."""
    depth = 0
    for m in _HEAD.finditer(text, at):
        c = m.group()
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == ":" and depth <= 0:
            found = _DOCSTRING.match(text, m.end())
            if not found:
                return None, m.end()
            s = found.group(1)
            return s[3:-3] if s[:3] in ('"""', "'''") else s[1:-1], m.end()
    return None, len(text)


def _python_end(lines: list[str], k: int, first: int) -> int:
    """Last line (from 0) of the block whose header starts at line ``k``; the body is deeper than the header."""
    indent = len(lines[k]) - len(lines[k].lstrip())
    last = first
    for j in range(first + 1, len(lines)):
        bare = lines[j].strip()
        if bare:
            if len(lines[j]) - len(lines[j].lstrip()) <= indent and bare[0] not in ")]}#":
                break
            last = j
    return last


def functions(text: str, ext: str) -> Iterator[tuple[str, int, int, str, str]]:
    """(name, line, end line, documentation, code) of each documented function; lines count from 1."""
    language = LANGUAGES.get(ext)
    if language not in SIGNATURES:
        return
    text = text.replace("\r\n", "\n")
    lines = text.split("\n")
    code = None
    seen, at_line, at = set(), 0, 0
    for m in SIGNATURES[language].finditer(text):
        group = m.lastindex
        name = m.group(group)
        if name in _NOT_NAMES and language in ("java", "javascript", "typescript"):  # the others begin with a word of their own
            continue
        at_line += text.count("\n", at, m.start(group))
        at = m.start(group)
        if (at_line, name) in seen:
            continue
        seen.add((at_line, name))
        if language == "python":
            doc, after = _python_doc(text, m.end(group))
            if doc is None:
                continue
            end = _python_end(lines, at_line, text.count("\n", 0, after))
        else:
            doc = doc_above(lines, at_line, language)
            if doc is None:
                continue
            if code is None:
                try:
                    code = blank(text, language).split("\n")
                except Fault:
                    code = lines
            depth, end = 0, at_line
            for j in range(at_line, len(code)):
                for b in _BRACE.findall(code[j]):
                    depth += {"{": 1, "}": -1}.get(b, 0)
                    if depth <= 0:
                        break
                else:
                    continue
                end = j
                break
            else:
                end = len(lines) - 1
        yield name, at_line + 1, end + 1, doc.strip(), "\n".join(lines[at_line : end + 1])


def documented_functions(files: DataFrame, symbols: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(file_id, name, line, end_line, documentation, code) of each function or method in ``symbols`` with non-trivial documentation.

    A symbol must be of type function or method and not removed, and its
    signature must stand in its line of the file's content. Null and empty
    contents, and languages without documentation comments, give no pair.
    Repeated rows count once.
    """
    rows = files.select("file_id", extension(F.col("path")).alias("ext"), "content").filter("content is not null and content <> ''")
    rows = rows.filter(F.col("ext").isin(*(e for e, name in LANGUAGES.items() if name in SIGNATURES)))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file_id", "name", "line", "end_line", "documentation", "code"]
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                piece = batch.slice(start, 500)
                out = [
                    (i, *f)
                    for i, e, t in zip(*(c.to_pylist() for c in piece.columns))
                    for f in functions(t, e)
                    if not is_trivial(f[3], f[0], min_words)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 6, kinds)], names)

    found = rows.mapInArrow(pairs, "file_id bigint, name string, line int, end_line int, documentation string, code string")
    wanted = symbols.filter(F.col("type").isin("function", "method") & F.col("removed_at").isNull()).select("file_id", "name", F.col("line").cast("int").alias("line"))
    return found.join(wanted, ["file_id", "name", "line"], "left_semi").dropDuplicates(["file_id", "name", "line"])
