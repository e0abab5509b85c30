"""Commit logs and diffs of git repositories as tables."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LIMIT = 200
_FORMAT = "%H%x1f%an%x1f%ae%x1f%aI%x1f%s"


def run(folder: str, *arguments: str) -> str:
    """Output of a git command, '' if it fails; arguments never pass a shell."""
    done = subprocess.run(["git", "-C", folder, *arguments], capture_output=True, text=True, errors="replace", check=False)
    return done.stdout if done.returncode == 0 else ""


class _Repo(InputPartition):
    def __init__(self, folder: str) -> None:
        self.folder = folder


class GitReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folders = options["path"].split("\n")
        self.what, self.limit, self.file, self.range = options.get("what", "log"), options.get("limit", str(LIMIT)), options.get("file"), options.get("range", "HEAD~1")

    def partitions(self) -> list[InputPartition]:
        return [_Repo(f) for f in self.folders]

    def read(self, partition: _Repo) -> Iterator[tuple]:
        only = ["--", self.file] if self.file else []
        if self.what == "diff":
            arguments = ["diff", "--cached"] if self.range == "staged" else ["diff", self.range]
            yield partition.folder, run(partition.folder, *arguments, *only)
            return
        for line in run(partition.folder, "log", f"-n{self.limit}", f"--format={_FORMAT}", *only).split("\n"):
            if line:
                yield (partition.folder, *line.split("\x1f", 4))


class GitSource(DataSource):
    """Format ``git``: ``path`` has one repository a line, each read as a partition; ``what`` is log or diff."""

    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        return "repo string, diff string" if self.options.get("what") == "diff" else "repo string, hash string, author string, email string, date string, message string"

    def reader(self, schema) -> DataSourceReader:
        return GitReader(self.options)


def read_log(spark: SparkSession, folders: list[str], limit: int = LIMIT, file: str | None = None) -> DataFrame:
    """(repo, hash, author, email, date, message) of the last ``limit`` commits of each repository, or of one file of it."""
    spark.dataSource.register(GitSource)
    options = {"limit": str(limit)} | ({"file": file} if file else {})
    return spark.read.format("git").options(**options).load("\n".join(folders))


def read_diff(spark: SparkSession, folders: list[str], range: str = "HEAD~1") -> DataFrame:  # noqa: A002
    """(repo, diff) against a revision, between two (``a..b``), or of what is staged."""
    spark.dataSource.register(GitSource)
    return spark.read.format("git").options(what="diff", range=range).load("\n".join(folders))


def parse_log_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """(hash, author, date, message) of ``|``-separated log lines: fewer than four parts give no row, the date is the fourth part or else the third, the message the last."""
    p = F.transform(F.split(column, r"\|"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    rows = lines.select(p.alias("p")).filter(F.size("p") >= 4)
    return rows.select(F.col("p")[0].alias("hash"), F.col("p")[1].alias("author"), F.when(F.col("p")[3] != "", F.col("p")[3]).otherwise(F.col("p")[2]).alias("date"), F.element_at("p", -1).alias("message"))


def authors(log: DataFrame) -> DataFrame:
    """(repo, author, commits, last): distinct authors with their commits."""
    return log.groupBy("repo", "author").agg(F.count(F.lit(1)).alias("commits"), F.max(F.to_timestamp("date")).alias("last"))
