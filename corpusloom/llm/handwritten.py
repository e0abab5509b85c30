"""Source files that nobody wrote by hand: generated, minified, vendored, data tables.

Path rules come first and need no content. Then the comments before the first
and after the last line of code are searched with one automaton for all notices; a hit counts if
the notice opens its comment line and is not quoted. Last come the shapes of
minified code and of data tables, measured over the whole content.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.syntax import extension

# Extensions of source code; configuration is no case.
SOURCE = ("py", "ts", "tsx", "js", "jsx", "mjs", "cjs", "go", "java", "rs", "rb", "php", "cs", "c", "h", "cc", "cpp", "kt", "swift", "scala")

# Folders that hold third-party packages, each in a folder of its own.
VENDOR_DIRS = "vendor|_vendor|vendored|third_party|third-party|thirdparty|3rdparty|3rd_party|node_modules|bower_components|jspm_packages|deps|external|externals|site-packages|dist-packages|Godeps|Pods|Carthage"

# Names of generated, minified and lock files.
GENERATED_NAME = r"(?:_pb2(?:_grpc)?\.pyi?|\.pb(?:\.gw)?\.go|\.pb\.(?:cc|h)|\.generated\.\w+|\.gen\.\w+|\.g\.(?:cs|dart|ts|go)|_generated\.\w+|\.designer\.cs|_string\.go)$"
MINIFIED_NAME = r"[.-]min\.(?:js|mjs|cjs|jsx|css)$|\.bundle\.js$"
LOCK_NAME = r"(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.ya?ml|Cargo\.lock|poetry\.lock|Pipfile\.lock|composer\.lock|Gemfile\.lock|go\.sum|gradle\.lockfile)$"

# Notices by which tools and package authors mark a file; each opens its line.
GENERATED = (
    "code generated by", "code generated from", "@generated", "<auto-generated", "<autogenerated", "autogenerated by", "autogenerated from", "auto-generated by", "auto-generated from",
    "auto-generated file", "autogenerated file", "automatically generated", "auto generated", "generated by", "generated from", "generated on", "generated automatically", "generated code",
    "this file was automatically generated", "this file was generated", "this file was auto-generated", "this file is generated", "this file is auto-generated", "this file is automatically generated",
    "this code was generated", "this code is generated", "this class was generated", "machine-made by", "machine generated", "machine-generated", "produced by", "created by", "built by",
    "do not edit", "do not modify", "dieser code wurde", "diese datei wurde", "ce fichier a été généré", "ce code a été généré", "este archivo fue generado", "este código fue generado",
)
THIRD_PARTY = ("bundled copy of", "vendored from", "vendored copy of", "imported from upstream", "copied from upstream", "this file is part of", "third-party code", "third party code")
#: Openers that need one of these behind them in the same comment line.
WEAK = {
    "produced by": r"overwritten|do not|lost|regenerat", "created by": r"overwritten|do not|lost|regenerat", "built by": r"overwritten|do not|lost|regenerat",
    "generated on": r"^generated on \S*\d", "generated by": r".", "dieser code wurde": r"erzeugt|generiert", "diese datei wurde": r"erzeugt|generiert",
    "this file is part of": r"\(?version|v?\d+\.\d+", "auto generated": r"\bby\b|\bfrom\b|do not",
}
_RELEASE = re.compile(r"^[\w.@/-]+ v?\d+\.\d+(?:\.\d+)*\b(?:\s*\||\s*$)")
_RIGHTS = re.compile(r"(?:\bcopyright\b.*\b(?:contributors|authors)\b.*\b(?:license|licence)|\(c\) \d{4} .*\b(?:authors|contributors)\b.*license)", re.I)
_COMMENT = re.compile(r"[ \t]*(?://[/!]?|#+!?|/\*+!?|\*+/?|--+|<!--)?[ \t]*(.*?)[ \t]*(?:\*+/|-->)?[ \t]*$")

# A whole run of literals between commas, and one literal.
_LITERAL = re.compile(r"""(?:"[^"\n]*"|'[^'\n]*'|-?\b(?:0[xX][0-9a-fA-F]+|\d[\d_.eE]*)[uUlLfF]?\b)\s*,\s*""")


def header(text: str) -> list[str]:
    """The texts of the comment lines before the first line of code."""
    out, inside = [], ""
    for line in text.split("\n"):
        bare = line.strip()
        if inside:
            out.append(_COMMENT.match(line).group(1))
            if inside in bare:
                inside = ""
            continue
        if not bare:
            continue
        if bare.startswith("/*") or bare.startswith("<!--"):
            close = "*/" if bare[0] == "/" else "-->"
            inside = "" if close in bare[2:] else close
        elif bare[:3] in ('"""', "'''"):
            inside = "" if bare[:3] in bare[3:] else bare[:3]
            out.append(bare.strip("\"' "))
            continue
        elif not (bare.startswith("//") or (bare[0] == "#" and not bare.startswith("#[")) or bare.startswith("--")):
            break
        out.append(_COMMENT.match(line).group(1))
    return out


def footer(text: str) -> list[str]:
    """The texts of the comment lines after the last line of code."""
    out: list[str] = []
    for line in reversed(text.rstrip().split("\n")):
        bare = line.strip()
        if bare and not bare.startswith(("//", "#", "/*", "*", "--", "<!--")):
            break
        out.append(_COMMENT.match(line).group(1))
    return out[::-1]


class Notices:
    """One automaton for all notices."""

    def __init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for kind, phrases in (("generated", GENERATED), ("third party", THIRD_PARTY)):
            for phrase in phrases:
                self.automaton.add_word(phrase, (kind, phrase))
        self.automaton.make_automaton()

    def find(self, lines: list[str]) -> str | None:
        """The kind of the first notice that opens a line, or None."""
        for k, line in enumerate(lines):
            low = line.lower()
            for end, (kind, phrase) in self.automaton.iter(low):
                if end + 1 != len(phrase):
                    continue
                if phrase in WEAK and not re.search(WEAK[phrase], low):
                    continue
                return kind
            if _RIGHTS.search(low) and (_RELEASE.match(low) or any(_RELEASE.match(x.lower()) for x in lines[max(0, k - 2) : k])):
                return "third party"
        return None


def minified(text: str) -> bool:
    """Whether most of the text stands in very long lines of code without blanks."""
    dense = 0
    for line in text.split("\n"):
        if len(line) >= 300 and sum(map(line.count, " \t")) < 0.1 * len(line) and sum(map(line.count, ";{}()=,")) > 0.08 * len(line):
            dense += len(line)
    return dense * 2 > len(text)


def data_table(text: str) -> bool:
    """Whether most of the text is a list of literals."""
    found = [m.end() - m.start() for m in _LITERAL.finditer(text)]
    return len(found) >= 16 and sum(found) >= 0.6 * len(text.strip())


def path_kind(path: Column) -> Column:
    """Kind that the path alone tells, or null."""
    p = F.regexp_replace(path, r"\\", "/")
    return (
        F.when(p.rlike(rf"(?:^|/)(?:{VENDOR_DIRS})/[^/]+/"), "third party")
        .when(p.rlike(GENERATED_NAME), "generated")
        .when(p.rlike(MINIFIED_NAME), "minified")
        .when(p.rlike(LOCK_NAME), "generated")
    )


def machine_files(files: DataFrame) -> DataFrame:
    """(file_id, path, kind) of the source files that nobody wrote by hand.

    ``kind`` is generated, minified, third party or data table. YAML, JSON and
    other non-source extensions are no case. Null and empty contents can still
    be told by their path; repeated rows count once.
    """
    rows = files.select("file_id", "path", "content").filter(extension(F.col("path")).isin(*SOURCE)).withColumn("kind", path_kind(F.col("path")))
    by_path = rows.filter("kind is not null").select("file_id", "path", "kind")
    rest = rows.filter("kind is null and content is not null and content <> ''").select("file_id", "path", "content")

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notices = Notices()
        for batch in batches:
            kinds = [notices.find(header(t)) or notices.find(footer(t)) or ("minified" if minified(t) else "data table" if data_table(t) else None) for t in batch.column(2).to_pylist()]
            keep = pa.array([k for k, kind in enumerate(kinds) if kind], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array([k for k in kinds if k], pa.string())], ["file_id", "path", "kind"])

    return by_path.unionByName(rest.mapInArrow(classify, "file_id bigint, path string, kind string")).dropDuplicates(["file_id"])


def handwritten_files(files: DataFrame, machine: DataFrame) -> DataFrame:
    """The source files that remain."""
    return files.filter(extension(F.col("path")).isin(*SOURCE)).join(machine.select("file_id"), "file_id", "left_anti")
