"""The live state of a scanned corpus, and its breakdowns.

Every function takes the raw tables, counts a repeated row once, and treats each
``repo`` as a project of its own. A file, symbol or path is live if it is not
removed; of several live files of one path, the latest scan stands.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import paths
from corpusloom.session import durable


#: Bytes of a file that a scan keeps at most.
MOST_BYTES = 1 << 20
#: Rows that are broadcast to be left out of a scan; more are joined.
BROADCAST_ROWS = 1_000_000


def live_files(files: DataFrame, *columns: str) -> DataFrame:
    """(repo, path, language, file_id, ord, *columns) of live files; ``path`` is normalised. Null paths are left out.

    Which rows lose, being older or repeated, is found from narrow columns; a
    table's contents are then scanned once without them and never shuffled. Rows
    that no file holds, as in tests, have no place to be told by and are grouped.
    """
    live = files.filter("removed_at is null and path is not null")
    npath = paths.norm_path(F.col("path"))
    if not set(columns) & {"content"} or not _is_stored(files):
        rows = live.select("repo", npath.alias("npath"), F.struct("file_id", "ord", *columns).alias("v"), F.struct("scanned_at", "file_id").alias("w"))
        latest = rows.groupBy("repo", "npath").agg(F.max_by("v", "w").alias("v"))
        return latest.select("repo", F.col("npath").alias("path"), paths.language(F.col("npath")).alias("language"), "v.*")
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    narrow = live.select("repo", npath.alias("npath"), "scanned_at", "file_id", *place)
    order = Window.partitionBy("repo", "npath").orderBy(F.desc_nulls_last("scanned_at"), F.desc_nulls_last("file_id"), "_file", "_row")
    lost = durable(narrow.withColumn("_n", F.row_number().over(order)).filter("_n > 1").select("_file", "_row"))
    lost = F.broadcast(lost) if lost.count() <= BROADCAST_ROWS else lost
    kept = live.select("repo", npath.alias("path"), "file_id", "ord", *columns, *place).join(lost, ["_file", "_row"], "left_anti")
    return kept.select("repo", "path", paths.language(F.col("path")).alias("language"), "file_id", "ord", *columns)


def _is_stored(rows: DataFrame) -> bool:
    """Whether the rows come from files, so that each has a place in one."""
    try:
        rows.select("_metadata.row_index").schema  # noqa: B018
    except AnalysisException:
        return False
    return True


def symbol_rows(symbols: DataFrame) -> DataFrame:
    """Live symbols with normalised paths, repeated rows included."""
    return symbols.filter("removed_at is null and name is not null").withColumn("path", paths.norm_path(F.col("path")))


def live_symbols(symbols: DataFrame) -> DataFrame:
    """Live symbols, each once, with normalised paths."""
    return symbol_rows(symbols).distinct()


def import_rows(imports: DataFrame) -> DataFrame:
    """Imports with normalised paths, repeated rows included."""
    return imports.withColumn("path", paths.norm_path(F.col("path"))).withColumn("resolved_path", paths.norm_path(F.col("resolved_path")))


def live_imports(imports: DataFrame) -> DataFrame:
    """Imports, each once, with normalised paths."""
    return import_rows(imports).distinct()


def row_key(rows: DataFrame) -> Column:
    """A 64-bit hash of all columns, by which repeated rows are told without moving them whole; nulls count, also those in arrays."""
    arrays = [F.to_json(c) for c, kind in rows.dtypes if kind.startswith("array")]
    return F.xxhash64(*rows.columns, *[F.col(c).isNull() for c in rows.columns], *arrays)


def language_breakdown(files: DataFrame) -> DataFrame:
    """(repo, language, files)."""
    return live_files(files).groupBy("repo", "language").agg(F.count(F.lit(1)).alias("files"))


def top_directories(files: DataFrame, least: int = 2, top: int = 12) -> DataFrame:
    """(repo, dir, files, language): directories of at least ``least`` files, the ``top`` largest of a repository, with their main language.

    Ties go to the smaller name.
    """
    per = live_files(files).withColumn("dir", paths.dirname(F.col("path"))).filter("dir <> ''").groupBy("repo", "dir", "language").agg(F.count(F.lit(1)).alias("n"))
    dirs = per.groupBy("repo", "dir").agg(F.sum("n").alias("files"), F.min_by("language", F.struct((-F.col("n")).alias("n"), "language")).alias("language")).filter(F.col("files") >= least)
    order = Window.partitionBy("repo").orderBy(F.desc("files"), "dir")
    return dirs.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top).drop("r")


def content_copies(files: DataFrame) -> DataFrame:
    """(hash, files, repos): contents that stand in more than one live file, by the first 16 digits of their SHA-256."""
    rows = live_files(files, "content").filter("content is not null and content <> ''").select("repo", F.substring(F.sha2("content", 256), 1, 16).alias("hash"))
    return rows.groupBy("hash").agg(F.count(F.lit(1)).alias("files"), F.count_distinct("repo").alias("repos")).filter("files > 1")


def incremental_scan(files: DataFrame, since: str = "2026-01-01") -> DataFrame:
    """(repo, reuse, parse): live files whose parse before ``since`` can be reused, and those to parse again.

    The state before is the latest scan of a path before ``since``; it is reused
    if path and content hash are the same.
    """
    before = files.filter(F.col("scanned_at") < F.lit(since).cast("timestamp")).filter("path is not null")
    cached = before.groupBy("repo", paths.norm_path(F.col("path")).alias("path")).agg(F.max_by("hash", F.struct("scanned_at", "file_id")).alias("was"))
    both = live_files(files, "hash").join(cached, ["repo", "path"], "left")
    same = F.coalesce(F.col("hash") == F.col("was"), F.lit(False))
    return both.groupBy("repo").agg(F.count_if(same).alias("reuse"), F.count_if(~same).alias("parse"))


def scannable_files(files: DataFrame, exclude: list[str], max_bytes: int = MOST_BYTES) -> DataFrame:
    """(file_id, path): live source files that a scan keeps: not excluded, in no hidden folder but three, not empty and not too large."""
    hidden = F.exists(F.filter(F.split("path", "/"), lambda s: s.startswith(".")), lambda s: ~s.isin(".github", ".cursor", ".vscode"))
    size = F.octet_length("content")
    keep = paths.is_source(F.col("path")) & ~paths.matches_any(F.col("path"), exclude) & ~hidden & (size > 0) & (size <= max_bytes)
    return live_files(files, "content").filter(keep).select("file_id", "path")


def totals(files: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(repo, files, symbols, imports)."""
    parts = [live_files(files).select("repo", F.lit("f").alias("k")), live_symbols(symbols).select("repo", F.lit("s").alias("k")), live_imports(imports).select("repo", F.lit("i").alias("k"))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("repo").agg(*[F.count_if(F.col("k") == k).alias(n) for k, n in (("f", "files"), ("s", "symbols"), ("i", "imports"))])
