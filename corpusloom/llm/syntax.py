"""Source files that do not parse.

Each language has its own lexer: one pattern finds the next opaque piece (a
comment, a string, a character, a regular expression, an element of JSX) or what
cannot be finished as one, and the text between goes to a pushdown stack of
delimiters. What is left of the code is read as classes of tokens: which class
may follow which, which may begin or end a statement, and what the delimiter on
top of the stack allows before it closes. Block headers, indentation, the end of
the file and merge-conflict and patch marks have rules of their own. The first
fault found is reported with its line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Languages by extension.
LANGUAGES = {
    "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript",
    "go": "go", "java": "java", "rs": "rust", "yml": "yaml", "yaml": "yaml", "json": "json",
}

# Words after which, or before which, another word may stand.
SCRIPT_WORDS = frozenset(
    "abstract any as asserts async await break case catch class const continue debugger declare default delete do else enum export extends finally for from function get if implements import in infer instanceof interface is keyof let module namespace new of out override package private protected public readonly require return satisfies set static super switch throw try type typeof unique using var void while with yield".split()
)
RUST_WORDS = frozenset(
    "as async await box break const continue crate dyn else enum extern fn for if impl in let loop macro match mod move mut pub ref return static struct super trait type union unsafe use where while yield".split()
)
PLAIN_WORDS = frozenset(
    "abstract boolean break byte case catch char class continue default do double else enum extends final finally float for if implements import instanceof int interface long native new non package permits private protected public record return sealed short static strictfp super switch synchronized this throw throws transient try var void volatile while yield chan const defer fallthrough func go goto map range select struct type string bool error any".split()
)
#: Words that may stand between a number and what follows it.
INFIX = frozenset("if else for in is and or not as of instanceof do then until step".split())

# Words that begin a statement of another language.
ALIEN = {
    "java": "def|elif|func|fn|function|let|const|use|from|impl|mod|struct|async|export|pub|trait",
    "go": "def|elif|fn|function|class|public|private|protected|let|use|from|impl|async|export|pub|trait|extends|interface|void",
    "rust": "def|elif|func|function|class|public|private|protected|import|package|export|var|void|from|interface",
    "typescript": "def|elif|func|fn|use|impl|struct|pub|trait|package|fun",
    "javascript": "def|elif|func|fn|use|impl|struct|pub|trait|package|fun|interface|public|private|protected",
}

_OPEN = {"(": ")", "[": "]", "{": "}"}
_BRACKET = re.compile(r"[()\[\]{}]")
_MARKER = re.compile(r"(?m)^(?:<{7}|>{7}|\|{7})(?: |\r?$)|^={7}\r?$|^@@ -\d|^diff --git |^\+\+\+ b/|^--- a/")
_ODD = re.compile("[“”‘’‚‛„«»‹›…–—′″＂＇�\x00\x01\x04-\x08\x0b\x0e-\x1f]")
#: Characters that stand only inside opaque pieces.
_FOREIGN = {"java": re.compile(r"[`#\\]"), "go": re.compile(r"[#$?@\\]"), "rust": re.compile(r"[`\\]"), "python": re.compile(r"[`$?]"), "javascript": re.compile(r"\\"), "typescript": re.compile(r"\\")}
_NUMBER_WORD = re.compile(r"(?<![\w.\"'$#])\d[\w.]*[ \t]+(?=[A-Za-z_$\x02])([A-Za-z_$]\w*)?")
_WORDS = re.compile(r"(?<![\w.$@#'])([A-Za-z_$][\w$]*)[ \t]+(?=[A-Za-z_$\x02])([A-Za-z_$][\w$]*)?")
_THREE = re.compile(r"(?<![\w.$@'])([A-Za-z_$][\w$]*)(?=[ \t]+([A-Za-z_$][\w$]*)[ \t]+([A-Za-z_$][\w$]*))|(?m:^)[ \t]*(\.\.\.)[ \t]*\w")
_DANGLING = re.compile(r"(?<![+\-*/.=<>!&|?])(?:[+\-/%&|^]|[=<>!+\-*/%&|^]=|=|&&|\|\||,[ \t\r\n]*,)[ \t\r\n]*[)\]};]")
_LEADING = re.compile(r"(?:^|[;{}])\s*\n[ \t]*(?:>(?=[\s\w])|[=%^|](?![=>|}])|\+(?=\s*(?:\}|import|export|const|let|var|return|func|package|public|private|use|fn|pub|if|for|type|class)\b))")
_TAIL = re.compile(r"(?:[=+\-*/%&|^<!?:,.(\[{@\\]|=>|->|\b(?:function|class|const|let|var|def|func|fn|import|from|new|extends|implements|interface|package|pub|use|struct|impl|enum|type|public|private|protected|static|final|async|export|if|else|for|while|in|of|and|or|not|is|lambda|with|as))\s*\Z")

_BLOCK = r"/\*[^*]*\*+(?:[^/*][^*]*\*+)*/"
_DOUBLE = r'"(?:[^"\\\n]|\\.|\\\n)*"'
_SINGLE = r"'(?:[^'\\\n]|\\.|\\\n)*'"


def _lexer(comments: str, strings: str, bad: str) -> re.Pattern[str]:
    return re.compile(f"(?P<c>{comments})|(?P<s>{strings})|(?P<b>{bad})", re.S)


_TRIPLE = r"'''(?:[^'\\]|\\.|'(?!''))*'''|" + r'"""(?:[^"\\]|\\.|"(?!""))*"""'
_SCRIPT = _lexer(rf"//[^\n]*|{_BLOCK}|\A#![^\n]*", rf"{_DOUBLE}|{_SINGLE}|`(?:[^`\\$]|\\.|\$(?!\{{))*`|`|/(?!\*)", r"/\*|[\"']")
_JSX = re.compile(_SCRIPT.pattern.replace("|/(?!\\*))", "|/(?!\\*)|<(?=[A-Za-z>]))"), re.S)
LEXERS = {
    "jsx": _JSX,
    "python": _lexer(r"\#[^\n]*", rf"\b[rRbBuUfFtT]{{0,2}}(?:{_TRIPLE}|{_DOUBLE}|{_SINGLE})|{_TRIPLE}|{_DOUBLE}|{_SINGLE}", r"[\"']"),
    "javascript": _SCRIPT,
    "typescript": _SCRIPT,
    "go": _lexer(rf"//[^\n]*|{_BLOCK}", rf"{_DOUBLE}|`[^`]*`|'(?:[^'\\\n]|\\(?:[0-7]{{3}}|x..|u.{{4}}|U.{{8}}|.))'", r"/\*|[\"'`]"),
    "java": _lexer(rf"//[^\n]*|{_BLOCK}", r'"""(?:[^"\\]|\\.|"(?!""))*"""|' + rf"{_DOUBLE}|'(?:[^'\\\n]|\\u+[0-9a-fA-F]{{4}}|\\[0-7]{{1,3}}|\\.)'", r"/\*|[\"']"),
    "rust": _lexer(r"//[^\n]*", r'\bb?r(?P<h>#*)".*?"(?P=h)|b?"(?:[^"\\]|\\.)*"|b?\'(?:[^\'\\\n]|\\(?:x..|u\{[^}]*\}|.))\'|\'[A-Za-z_]\w*(?!\')', r"/\*|[\"']"),
}

_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_REGEX_BEFORE = re.compile(r"(?:\A|[(,=:\[!&|?{};+\-*%<>~^\n]|\b(?:return|typeof|case|in|of|do|else|void|yield|await))[ \t]*\Z")
_TEMPLATE = re.compile(r"\\.|\$\{|`", re.S)
_NESTED = re.compile(r"[{}`]|" + _DOUBLE + "|" + _SINGLE, re.S)
_RUST_COMMENT = re.compile(r"/\*|\*/")


class Fault(Exception):
    """A syntax fault: kind and offset."""


def _template_end(text: str, at: int) -> int:
    """Offset after the template literal whose inside begins at ``at``."""
    while m := _TEMPLATE.search(text, at):
        at = m.end()
        if m.group() == "`":
            return at
        if m.group() == "${":
            depth = 1
            while depth:
                n = _NESTED.search(text, at)
                if not n:
                    raise Fault("unterminated template", at)
                at = n.end()
                if n.group() == "`":
                    at = _template_end(text, at)
                else:
                    depth += {"{": 1, "}": -1}.get(n.group(), 0)
    raise Fault("unterminated template", at)


def _rust_comment_end(text: str, at: int) -> int:
    depth = 1
    while depth:
        m = _RUST_COMMENT.search(text, at)
        if not m:
            raise Fault("unterminated comment", at)
        depth += 1 if m.group() == "/*" else -1
        at = m.end()
    return at


_JSX_TAG = re.compile(r"<(/?)([\w.:-]*)")
_JSX_INSIDE = re.compile(rf"(/?>)|(\{{)|{_DOUBLE.replace('[^', '[^', 1)}|\"[^\"]*\"|'[^']*'|{_BLOCK}|<", re.S)
_JSX_CODE = re.compile(rf"[{{}}`]|//[^\n]*|{_BLOCK}|{_DOUBLE}|{_SINGLE}|<(?=[A-Za-z>])", re.S)


def _jsx_code_end(text: str, at: int) -> int:
    """Offset after the brace that closes the code whose inside begins at ``at``."""
    depth = 1
    while m := _JSX_CODE.search(text, at):
        start, at, c = m.start(), m.end(), m.group()
        if c == "`":
            at = _template_end(text, at)
        elif c == "<":
            if _REGEX_BEFORE.search(text[max(0, start - 80) : start]):
                at = _jsx_end(text, start)
        else:
            depth += {"{": 1, "}": -1}.get(c, 0)
            if not depth:
                return at
    raise Fault("premature end", at)


def _jsx_end(text: str, start: int) -> int:
    """Offset after the element that begins at ``start``; its open tags are a stack."""
    tags: list[str] = []
    at = start
    while True:
        tag = _JSX_TAG.match(text, at)
        at = tag.end()
        closing, name = tag.groups()
        if closing and (not tags or tags.pop() != name):
            raise Fault("unbalanced delimiter", tag.start())
        while True:  # attributes
            m = _JSX_INSIDE.search(text, at)
            if not m or m.group() == "<":
                raise Fault("premature end", tag.start())
            at = m.end()
            if m.group(2):
                at = _jsx_code_end(text, at)
            elif m.group(1):
                break
        if not closing and m.group(1) == ">":
            tags.append(name)
        while tags:  # the text of the innermost element, in which quotes are no delimiters
            nearest = [k for k in (text.find("<", at), text.find("{", at)) if k >= 0]
            if not nearest:
                raise Fault("premature end", start)
            at = min(nearest)
            if text[at] == "<":
                break
            at = _jsx_code_end(text, at + 1)
        if not tags:
            return at


_FORMATTED = re.compile(r"[rRbBuU]?[fFtT][rRbB]?(\"\"\"|'''|[\"'])")
_FIELD = re.compile(r"\{\{|\}\}|\{|\\.", re.S)
_IN_FIELD = re.compile(rf"[{{}}\[\]()]|\b[rRbBuUfFtT]{{0,2}}(?:{_TRIPLE}|{_DOUBLE}|{_SINGLE})|{_TRIPLE}|{_DOUBLE}|{_SINGLE}", re.S)


def _formatted_end(text: str, start: int) -> int:
    """Offset after the formatted string at ``start``, whose fields may hold strings of the same quotes; -1 if it has no end."""
    opening = _FORMATTED.match(text, start)
    quote, at, depth = opening.group(1), opening.end(), 0
    while True:
        if not depth:
            stop = text.find(quote, at)
            m = _FIELD.search(text, at)
            if stop < 0 or (len(quote) == 1 and "\n" in text[at:stop].replace("\\\n", "") and not (m and m.start() < stop)):
                return -1
            if not m or stop < m.start():
                return stop + len(quote)
            depth, at = int(m.group() == "{"), m.end()
        else:
            m = _IN_FIELD.search(text, at)
            if not m:
                return -1
            c, at = m.group(), m.end()
            if c[0] in "fFtTrRbB" and _FORMATTED.match(c):
                at = _formatted_end(text, m.start())
                if at < 0:
                    return -1
            depth += 1 if c in _OPEN else -1 if c in ")]}" else 0


def blank(text: str, language: str, jsx: bool = False) -> str:
    """The code with comments blanked and each string as one mark, line breaks kept; raises on a piece without end.

    The lines of a string in Python are joined, as it does not end its statement.
    """
    search, out, at = LEXERS["jsx" if jsx else language].search, [], 0
    script = language in ("javascript", "typescript")
    while m := search(text, at):
        start, end, kind = m.start(), m.end(), m.lastgroup
        piece = m.group()
        if kind == "b":
            if language == "rust" and piece == "/*":
                end, kind = _rust_comment_end(text, end), "c"
            else:
                raise Fault("unterminated comment" if piece == "/*" else "unterminated literal", start)
        elif language == "python" and kind == "s" and _FORMATTED.match(piece):
            end = _formatted_end(text, start)
            if end < 0:
                raise Fault("unterminated literal", start)
        elif script and piece == "`":
            end = _template_end(text, end)
        elif script and piece in ("/", "<"):
            before = text[at:start] or (out[-1] if out else "")
            found = _REGEX_BEFORE.search(before)
            if found and piece == "<" and not re.match(r"<\w+(?:,|\s+extends\b)", text[start : start + 80]):
                end = _jsx_end(text, start)
            elif found and piece == "/" and (literal := _REGEX.match(text, start)):
                end = literal.end()
            else:
                out.append(text[at:end])
                at = end
                continue
        out.append(text[at:start])
        breaks = text.count("\n", start, end)
        if kind == "c":
            out.append("\n" * breaks or " ")
        elif language == "rust" and piece[0] == "'" and piece[-1] != "'":
            out.append(" ")  # a lifetime
        else:
            out.append("\x02" + ("\\\n" if language == "python" else "\n") * breaks)
        at = end
    out.append(text[at:])
    return "".join(out)


def _balance(code: str) -> dict[int, int]:
    """The offset of the opening delimiter of each closing one; raises where they do not match."""
    stack: list[tuple[str, int]] = []
    opened = {}
    for m in _BRACKET.finditer(code):
        c = m.group()
        if c in _OPEN:
            stack.append((_OPEN[c], m.start()))
        else:
            want, at = stack.pop() if stack else ("", 0)
            if want != c:
                raise Fault("unbalanced delimiter", m.start())
            opened[m.start()] = at
    if stack:
        raise Fault("premature end", stack[-1][1])
    return opened


def _neighbours(code: str, language: str) -> None:
    words = RUST_WORDS if language == "rust" else SCRIPT_WORDS
    for m in _NUMBER_WORD.finditer(code):
        if m.group(1) not in INFIX:
            raise Fault("misplaced token", m.start())
    if language in ("javascript", "typescript", "rust"):
        for m in _WORDS.finditer(code):
            first, second = m.group(1), m.group(2)
            if first not in words and second not in words:
                raise Fault("misplaced token", m.start())
    if language in ("java", "go"):
        for m in _THREE.finditer(code):
            if m.group(4) or not PLAIN_WORDS.intersection(m.groups()):
                raise Fault("misplaced token", m.start())
    if m := re.search(rf"(?m)^[ \t]*(?:{ALIEN[language]})[ \t]+[A-Za-z_{{*]", code):
        raise Fault("another language", m.start())
    if m := _DANGLING.search(code):
        if not (language == "rust" and "|" in m.group()) and not (language == "typescript" and m.group()[0] in "|&"):
            raise Fault("misplaced token", m.start())
    if m := _LEADING.search(code):
        raise Fault("misplaced token", m.end())
    if m := _UNNAMED[language].search(code) or _TWICE.search(code):
        raise Fault("misplaced token", m.start())
    if m := _TAIL.search(code):
        raise Fault("premature end", m.start())


# Words of Python by the class of token that they are; all other words are operands.
_PYTHON_CLASS = {
    "if": "I", "else": "E", "for": "F", "in": "N", "is": "S", "and": "A", "or": "A", "not": "T", "lambda": "L", "await": "W", "yield": "Y", "from": "f", "async": "y", "as": "x", "import": "m",
    "def": "K", "class": "K", "elif": "K", "while": "K", "with": "K", "try": "K", "except": "K", "finally": "K", "return": "K", "global": "K", "nonlocal": "K", "del": "K", "assert": "K", "raise": "K",
    "pass": "K", "break": "K", "continue": "K", "*": "*", "**": "*", "+": "-", "-": "-", "~": "~", "@": "@", "/": "/", "->": ">", ":=": "w", "=": "=", "...": "0", "\x02": "s", "<>": "?",
    "//": "b", "%": "b", "<<": "b", ">>": "b", "&": "b", "|": "b", "^": "b", "<": "b", ">": "b", "==": "b", "!=": "b", "<=": "b", ">=": "b",
}
_PYTHON_TOKEN = re.compile(
    r"[^\W\d]\w*|0[xXoObB][0-9a-fA-F_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[jJ]?|\.\.\.|->|:=|<>|(?:\*\*|//|<<|>>|[-+*/%@&|^=!<>])=|\*\*|//|<<|>>|[^\s\\]"
)
#: What may not follow what: a second operand, an operator without one of its operands, a keyword inside an expression.
_PYTHON_PAIR = re.compile(
    r"[a0)\]}][a0s{~LWYK]|s[a0{~LWYK]|[a0s)\]}](?:T(?!N)|y(?!F))"
    r"|[b~=gwAISEFNW@.-](?=[])},;bgw=AISEFNKxfm/]|$|:)(?<!^E)(?<!^yF)|[*/](?=[]};bgw=AISENKxfm]|$)|[(\[{](?=[,bgw=AISENxKm.])|,(?=[,bgwAISExKm.])|[({](?=[:F])|:[bgw=AS.]|[(\[{:,][>?]|\.(?!a)|(?<![a0s)\]}])\.|[a)\]}s]\[\]|KK|T(?=[])},;bgwASEFK:]|$)|L(?=[])},;bgw=AISENK]|$)|\?|!|\$|`"
)
_PYTHON_START = re.compile(r"[bgw=ASN.,:)\]}/x>]")
_PYTHON_END = re.compile(r"[-b~=gwATISFN@.*/Lxfm(\[{>]$")
_COMPOUND = re.compile(r"(?:async[ \t]+)?(def|class|if|elif|else|for|while|with|try|except|finally)\b")
_DEF = re.compile(r"(?:async[ \t]+)?def[ \t]+\w+[ \t]*(?:\x03[ \t]*)?\x03[ \t]*(?:->[^:]+)?:")
_CLASS = re.compile(r"class[ \t]+\w+[ \t]*(?:\x03[ \t]*){0,2}:")
_SOFT = re.compile(r"(?:match|case|type)\b[ \t]*(?=[\w\x02(\[{*.-])(?!(?:in|is|and|or|if|else|not)\b)")


def _class(token: str) -> str:
    first = _PYTHON_CLASS.get(token)
    if first is None:
        first = "0" if token[0].isdigit() or (token[0] == "." and len(token) > 1) else "a" if token[0].isalpha() or token[0] == "_" else "g" if token[-1] == "=" else token
    return first


def _folded(line: str) -> str:
    """The line with one mark for each outermost pair of brackets and what it holds."""
    out, depth, at = [], 0, 0
    for m in _BRACKET.finditer(line):
        if m.group() in _OPEN:
            if not depth:
                out += line[at : m.start()], "\x03"
            depth += 1
        else:
            depth -= 1
            if not depth:
                at = m.end()
    return "".join([*out, line[at:]])


# The heads that a clause of a compound statement may follow.
_AFTER = {
    "elif": ("if", "elif"), "else": ("if", "elif", "for", "while", "except"), "except": ("try", "except"), "finally": ("try", "except", "else"),
}


def _python_statement(line: str, start: int, heads: list[str]) -> bool:
    """Hold a logical line against the rules; whether it opens a block. ``heads`` has the last statement's head of each open block."""
    flat = _folded(line)
    compound = _COMPOUND.match(flat)
    soft = _SOFT.match(line) and (flat.endswith(":") or line.startswith("type") and "=" in flat)
    classes = "".join(map(_class, _PYTHON_TOKEN.findall(line[_SOFT.match(line).end() :] if soft else line)))
    imports = classes[:1] in ("m", "f")
    if imports:
        _follows("", start, heads)
        if not re.match(r"import[ \t]+[\w.]+(?:[ \t]+as[ \t]+\w+)?(?:[ \t]*,[ \t]*[\w.]+(?:[ \t]+as[ \t]+\w+)?)*[ \t]*(?:;|$)|from[ \t]*[\w. \t]+[ \t]import[ \t]*[\w(*]|from[ \t]*\.+[ \t]*import[ \t]*[\w(*]", line):
            raise Fault("misplaced token", start)
        return False
    _follows(compound.group(1) if compound else "", start, heads)
    if compound and ":" not in flat:
        raise Fault("missing colon", start)
    if compound and (compound.group(1) == "def" and not _DEF.match(flat) or compound.group(1) == "class" and not _CLASS.match(flat)):
        raise Fault("bad header", start)
    if _PYTHON_START.match(classes) or _PYTHON_PAIR.search(classes) or (_PYTHON_END.search(classes) and classes not in ("Y",)):
        raise Fault("misplaced token", start)
    opens = flat.endswith(":")
    if opens and not compound and not soft:
        raise Fault("misplaced token", start)
    return opens


def _follows(head: str, start: int, heads: list[str]) -> None:
    """Hold the head of a statement against the statement before it in the same block, and take its place."""
    before = heads[-1]
    if head in _AFTER and before not in _AFTER[head] or before == "try" and head not in ("except", "finally"):
        raise Fault("missing block", start)
    heads[-1] = head


def _python_lines(code: str) -> None:
    """Indentation stack, block headers and statements of Python code."""
    indents, header, depth, at, joined = [0], False, 0, 0, False
    heads = [""]
    started, logical = 0, []
    for line in code.split("\n"):
        start, at = at, at + len(line) + 1
        bare = line.strip()
        if not bare:
            if joined and not depth:  # what was joined ends here
                header, joined = _python_statement(" ".join(logical).strip(), started, heads), False
            continue
        if not depth and not joined:
            wide = line.expandtabs(8)
            width = len(wide) - len(wide.lstrip(" \f"))
            if header:
                if width <= indents[-1]:
                    raise Fault("missing block", start)
                indents.append(width)
                heads.append("")
            else:
                if width > indents[-1]:
                    raise Fault("indentation", start)
                while width < indents[-1]:
                    indents.pop()
                    if heads.pop() == "try":
                        raise Fault("missing block", start)
                if width != indents[-1]:
                    raise Fault("indentation", start)
            logical, started = [], start
        joined = bare.endswith("\\")
        logical.append(bare[:-1] if joined else bare)
        depth += sum(map(bare.count, "([{")) - sum(map(bare.count, ")]}"))
        if depth or joined:
            continue
        header = _python_statement(" ".join(logical).strip(), started, heads)
    if header or joined or "try" in heads:
        raise Fault("premature end", len(code))


# Words that need a name before a delimiter or an assignment.
_UNNAMED = {
    "javascript": re.compile(r"(?<![\w.$#])(?:(?<!as )(?:const|let|var)[ \t]*(?:=(?!=)|;|,|\))|function[ \t]*\*?[ \t]*\{|(?:extends|import|new)[ \t]*[;=)])"),
    "go": re.compile(r"(?<![\w.])(?:func[ \t]*\{|(?:var|type|const)[ \t]*=|package[ \t]*(?:;|\n))"),
    "java": re.compile(r"(?<![\w.])(?:(?:class|interface|enum|extends|implements|package|import)[ \t]*[{;=(]|new[ \t]*[;)=])"),
    "rust": re.compile(r"(?<![\w.#])(?:fn[ \t]*\{|let[ \t]*[=;]|(?:struct|enum|trait|mod)[ \t]*[{;=(])"),
}
_UNNAMED["typescript"] = _UNNAMED["javascript"]
#: Two operators of which the second cannot begin an operand, apart by a blank.
_TWICE = re.compile(r"(?<![=!<>+\-*/%&|^?:])(?:=|[=!]==?|&&|[<>]=|[-+*/%^|&]=)[ \t]+(?:=(?!>)|[=!]=|[/%^](?![/*])|&&|[<>]=)")
_JAVA_OPERAND = re.compile(r"[\w\x02)\]][ \t\r\n]*\}")
_JAVA_LIST = re.compile(r"[=,({\]][ \t\r\n]*\Z|\benum\s+\w+[^{};()=]*\Z")


def _java_ends(code: str, opened: dict[int, int]) -> None:
    """A statement or field ends before the brace that closes its block; only lists of values and constants hold none."""
    for m in _JAVA_OPERAND.finditer(code):
        if m.group()[0] == ")" and re.search(r"@\w+(?:\.\w+)*\s*\([^()]*\Z", code[max(0, m.start() - 400) : m.start()]):
            continue
        if not _JAVA_LIST.search(code[:opened[m.end() - 1]][-4000:]):
            raise Fault("misplaced token", m.start())


_GO_TOP = re.compile(r"(?:package|import|func|type|var|const)\b")
_RUST_TOP = re.compile(r"(?:#|pub|fn|use|mod|struct|enum|impl|trait|const|static|type|extern|unsafe|async|macro_rules|union|\w+!|crate)")
_JAVA_END = re.compile(r"[;{}(,@]$|^@\w|[=+\-*/&|?:.)\]>\x02\w]$")


def _top_level(code: str, language: str) -> None:
    """Statements outside any braces must be declarations where the language says so."""
    if language == "go":
        first = code.strip()
        if first and not first.startswith("package"):
            raise Fault("missing package clause", 0)
    if language not in ("go", "rust", "java"):
        return
    depth, at = 0, 0
    fresh = True
    for line in code.split("\n"):
        start, at = at, at + len(line) + 1
        bare = line.strip()
        if not bare:
            continue
        if not depth and fresh:
            if language == "go" and not _GO_TOP.match(bare) and bare[0] not in ")};":
                raise Fault("misplaced token", start)
            if language == "rust" and not _RUST_TOP.match(bare) and bare[0] not in ")};":
                raise Fault("misplaced token", start)
        if language == "java" and (re.match(r"(?:package|import)\b", bare) and not bare.endswith(";") or (bare.endswith(":") and not re.match(r"(?:case|default|\w+[ \t]*:)", bare) and "?" not in bare)):
            raise Fault("misplaced token", start)
        if language == "go" and bare.endswith(":") and not re.match(r"(?:case|default|\w+[ \t]*:)", bare):
            raise Fault("misplaced token", start)
        depth += sum(map(bare.count, "([{")) - sum(map(bare.count, ")]}"))
        fresh = bare[-1] in ";})]" or language == "go"
        if language == "go" and not depth and bare[-1] in ",=":
            fresh = False
    if language in ("java", "rust") and (tail := code.strip()) and tail[-1] not in ";}":
        raise Fault("premature end", len(code))


# A token of JSON, or anything else as one wrong character.
_JSON = re.compile(r'\s+|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)|([{}\[\],:])|(.)', re.S)


def _json(text: str) -> None:
    """A pushdown automaton over JSON tokens; ``want`` is what may come next."""
    stack: list[str] = []
    want = "value"
    for m in _JSON.finditer(text.removeprefix("﻿")):
        kind = m.lastindex
        if kind is None:
            continue
        token = m.group()
        if kind == 4:
            raise Fault("unterminated literal" if token == '"' else "misplaced token", m.start())
        if kind == 3 and token in "{[" and want in ("value", "value or ]"):
            stack.append(token)
            want = "key or }" if token == "{" else "value or ]"
        elif kind == 3 and token in "}]" and stack and stack[-1] == ("{" if token == "}" else "[") and want in ("end", "key or }" if token == "}" else "value or ]"):
            stack.pop()
            want = "end"
        elif kind == 3 and token == "," and stack and want == "end":
            want = "key" if stack[-1] == "{" else "value"
        elif kind == 3 and token == ":" and want == ":":
            want = "value"
        elif kind == 1 and want in ("key", "key or }"):
            want = ":"
        elif kind in (1, 2) and want in ("value", "value or ]"):
            want = "end"
        else:
            raise Fault("misplaced token", m.start())
    if stack or want != "end":
        raise Fault("premature end", len(text))


_YAML_KEY = re.compile(r"(?:- +)*(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[^\s\"'#&*!|>%@`\[\]{},?:-][^#\n]*?|-[^\s][^#\n]*?)[ \t]*:(?=\s|$)")
_YAML_COMMENT = re.compile(r"(?:^|[ \t])#.*$")
_YAML_DOUBLE = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_YAML_SINGLE = re.compile(r"'(?:[^']|'')*'", re.S)


def _yaml(text: str) -> None:
    """Indentation stack, keys, quotes and flow delimiters of block-style YAML."""
    lines = text.split("\n")
    indents: list[tuple[int, str]] = []
    at, k = 0, 0
    scalar = plain = -1  # indentation of the key of a block scalar, of a plain one
    can_nest = True
    while k < len(lines):
        line = lines[k].rstrip("\r")
        start, at, k = at, at + len(lines[k]) + 1, k + 1
        if not line.strip():
            continue
        width = len(line) - len(line.lstrip(" "))
        if scalar >= 0:
            if width > scalar:
                continue
            scalar = -1
        bare = line.strip()
        if bare[0] == "#" or (not width and bare in ("---", "...")) or (not width and bare[0] == "%"):
            continue
        if line[width] == "\t":
            raise Fault("indentation", start)
        if 0 <= plain < width and not _YAML_KEY.match(bare) and not re.match(r"-(?:\s|$)", bare):
            continue  # the scalar goes on
        plain = -1
        while indents and indents[-1][0] > width:
            indents.pop()
            can_nest = False
        kind = "item" if re.match(r"-(?:\s|$)", bare) else "key"
        if not indents or indents[-1][0] < width:
            if indents and not can_nest:
                raise Fault("indentation", start)
            if not indents and width and start and at > 0 and can_nest is False:
                raise Fault("indentation", start)
            indents.append((width, kind))
        elif kind == "item" and indents[-1][1] == "key" and not can_nest:
            raise Fault("misplaced token", start)
        key = _YAML_KEY.match(bare)
        if kind == "key" and not key:
            if len(indents) == 1 and indents[0][0] == width and start == 0 and bare[0] in "[{\"'":
                return _flow(text)
            raise Fault("misplaced token", start)
        value = bare[key.end() :].strip() if key else bare[1:].strip()
        if value[:1] in "\"'" and value:
            pattern = _YAML_DOUBLE if value[0] == '"' else _YAML_SINGLE
            offset = text.index(value, start)
            m = pattern.match(text, offset)
            if not m:
                raise Fault("unterminated literal", offset)
            skipped = text.count("\n", offset, m.end())
            for _ in range(skipped):
                at += len(lines[k]) + 1
                k += 1
                if _YAML_KEY.match(lines[k - 1].strip()):
                    raise Fault("unterminated literal", offset)
            rest = text[m.end() : text.find("\n", m.end()) if text.find("\n", m.end()) >= 0 else len(text)].strip()
            if rest and rest[0] != "#":
                raise Fault("misplaced token", m.end())
            can_nest = False
            continue
        value = _YAML_COMMENT.sub("", value).strip()
        if re.fullmatch(r"[|>][+-]?\d?[+-]?", value):
            scalar, can_nest = width, False
            continue
        if value[:1] and value[0] in "[{":
            depth, piece = 0, value
            while True:
                bared = _YAML_SINGLE.sub("", _YAML_DOUBLE.sub("", piece))
                depth += sum(map(bared.count, "[{")) - sum(map(bared.count, "]}"))
                if depth <= 0 or k >= len(lines):
                    break
                piece = lines[k]
                at, k = at + len(lines[k]) + 1, k + 1
            if depth:
                raise Fault("unbalanced delimiter" if depth < 0 else "premature end", start)
            can_nest = False
            continue
        if value and value[0] in "@`%" or re.search(r":\s", value) and not (kind == "item" and not key):
            raise Fault("misplaced token", start)
        can_nest = not value or value[0] in "&!" or kind == "item"
        plain = width if value and value[0] not in "&!*" else -1


def _flow(text: str) -> None:
    _balance(_YAML_SINGLE.sub("\x02", _YAML_DOUBLE.sub("\x02", text)))


def fault(text: str | None, extension: str | None) -> tuple[str, int] | None:
    """(kind, line from 1) of the first fault, or None. Null, empty and blank texts, and other extensions, have none."""
    language = LANGUAGES.get((extension or "").lower())
    if not text or not text.strip() or not language:
        return None
    try:
        text = text.replace("\r\n", "\n")
        if language == "json":
            _json(text)
        elif language == "yaml":
            if m := _MARKER.search(text):
                raise Fault("conflict or patch mark", m.start())
            _yaml(text)
        else:
            text = code = blank(text.removeprefix("﻿"), language, (extension or "").lower() in ("jsx", "tsx", "js", "mjs"))  # the same lines
            if m := _MARKER.search(code):
                raise Fault("conflict or patch mark", m.start())
            if m := _ODD.search(code) or _FOREIGN[language].search(code):
                raise Fault("misplaced token", m.start())
            opened = _balance(code)
            if language == "python":
                _python_lines(code)
                return None
            _neighbours(code, language)
            if language == "java":
                _java_ends(code, opened)
            _top_level(code, language)
    except Fault as x:
        return x.args[0], text.count("\n", 0, x.args[1]) + 1
    return None


def extension(path: Column) -> Column:
    """Lower-case extension of a path."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def invalid_files(files: DataFrame) -> DataFrame:
    """(file_id, repo, path, language, fault, line) of the files that do not parse.

    The extension of ``path`` decides on the language. Null and empty contents
    and other extensions are no case; repeated rows count once.
    """
    return _checked(files, True).dropDuplicates(["file_id"])


def checked_rates(files: DataFrame) -> DataFrame:
    """(repo, language, files, invalid, rate) in one pass over the files with content, each once."""
    checked = _checked(files, False).groupBy("file_id").agg(F.first("repo").alias("repo"), F.first("language").alias("language"), F.count("fault").alias("faults"))
    counts = checked.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("faults") > 0).alias("invalid"))
    return counts.withColumn("rate", F.col("invalid") / F.col("files"))


def _checked(files: DataFrame, faulty: bool) -> DataFrame:
    """(file_id, repo, path, language, fault, line) of every file with content, or only of those with a fault."""
    rows = files.select("file_id", "repo", "path", "content").filter("content is not null and content <> ''")
    rows = rows.select("file_id", "repo", "path", extension(F.col("path")).alias("ext"), "content").filter(F.col("ext").isin(*LANGUAGES))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ext, content = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            found = [(k, LANGUAGES[e], *(f or (None, None))) for k, (e, t) in enumerate(zip(ext, content)) if (f := fault(t, e)) or not faulty]
            keep = pa.array([f[0] for f in found], pa.int64())
            own = [pa.array([f[k] for f in found], t) for k, t in ((1, pa.string()), (2, pa.string()), (3, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(keep) for k in range(3)), *own], ["file_id", "repo", "path", "language", "fault", "line"])

    return rows.mapInArrow(check, "file_id bigint, repo string, path string, language string, fault string, line int")


def invalid_rates(files: DataFrame, invalid: DataFrame) -> DataFrame:
    """(repo, language, files, invalid, rate) over the files with content, each once."""
    language = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])[extension(F.col("path"))]
    known = files.filter("content is not null and content <> ''").select("file_id", "repo", language.alias("language")).filter("language is not null").distinct()
    bad = invalid.select("file_id", F.lit(1).alias("bad"))
    return (
        known.join(bad, "file_id", "left")
        .groupBy("repo", "language")
        .agg(F.count(F.lit(1)).alias("files"), F.count("bad").alias("invalid"))
        .withColumn("rate", F.col("invalid") / F.col("files"))
    )
