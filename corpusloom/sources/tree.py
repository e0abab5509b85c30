"""Source trees as a table, by a Spark data source of their own.

Spark's file sources drop names that begin with ``_`` or ``.``; a source tree
needs them. The driver lists paths only; contents are read and hashed where the
partitions run.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusloom.functions.paths import LANGUAGE_OF, SOURCE_EXTENSIONS, gitignore_globs, glob_regex

MAX_BYTES = 1 << 20
KEPT_HIDDEN = (".github", ".cursor", ".vscode")
PER_PARTITION = 256


def list_tree(root: str, exclude: list[str], max_bytes: int = MAX_BYTES, max_files: int | None = None) -> Iterator[str]:
    """Relative paths of the source files that a scan keeps, folder by folder in name order.

    Excluded folders and hidden ones but three are not entered; empty and too
    large files and other extensions are left out.
    """
    ignore = os.path.join(root, ".gitignore")
    lines = open(ignore, encoding="utf-8", errors="replace").read().split("\n") if os.path.isfile(ignore) else []
    patterns = [re.compile(glob_regex(g)) for g in [*exclude, *gitignore_globs(lines)]]
    out = lambda p: any(x.match(p) for x in patterns)
    kept = 0
    for folder, names, files in os.walk(root):
        at = os.path.relpath(folder, root).replace(os.sep, "/")
        rel = lambda n, at=at: n if at == "." else f"{at}/{n}"
        names[:] = sorted(n for n in names if not out(rel(n)) and not out(rel(n) + "/") and (not n.startswith(".") or n in KEPT_HIDDEN))
        for n in sorted(files):
            if out(rel(n)) or n.rsplit(".", 1)[-1].lower() not in SOURCE_EXTENSIONS or "." not in n:
                continue
            if not 0 < os.path.getsize(os.path.join(folder, n)) <= max_bytes:
                continue
            if max_files is not None and kept >= max_files:
                return
            kept += 1
            yield rel(n)


class _Paths(InputPartition):
    def __init__(self, start: int, paths: list[str]) -> None:
        self.start, self.paths = start, paths


class TreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.repo = options.get("repo", os.path.basename(os.path.abspath(self.root)))
        self.exclude = [x for x in options.get("exclude", "").split("\n") if x]
        self.max_bytes = int(options.get("maxbytes", MAX_BYTES))
        self.max_files = int(options["maxfiles"]) if "maxfiles" in options else None

    def partitions(self) -> list[InputPartition]:
        paths = list(list_tree(self.root, self.exclude, self.max_bytes, self.max_files))
        return [_Paths(k, paths[k : k + PER_PARTITION]) for k in range(0, len(paths), PER_PARTITION)] or [_Paths(0, [])]

    def read(self, partition: _Paths) -> Iterator[tuple]:
        import hashlib

        for k, path in enumerate(partition.paths):
            whole = os.path.join(self.root, path)
            with open(whole, "rb") as f:
                data = f.read()
            yield self.repo, path, whole, LANGUAGE_OF.get(path.rsplit(".", 1)[-1].lower(), "unknown"), len(data), hashlib.sha256(data).hexdigest()[:16], partition.start + k, data.decode("utf-8", "replace")


class TreeSource(DataSource):
    """Format ``source_tree``: option ``path`` is the root; ``repo``, ``exclude`` (globs by line), ``maxBytes`` and ``maxFiles`` may be given."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "repo string, path string, absolute_path string, language string, size bigint, hash string, ord bigint, content string"

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)


def read_tree(spark: SparkSession, root: str, exclude: list[str] | None = None, **options: str) -> DataFrame:
    """The source files of a tree."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("source_tree").options(exclude="\n".join(exclude or []), **options).load(root)
