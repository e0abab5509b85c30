"""Scans that arrive as streams of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import paths
from corpusloom.operators import extract


def file_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """Files of scans that are added to a folder as Parquet."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def latest_files(files: DataFrame, lateness: str = "60 days") -> DataFrame:
    """Each file id once, although scans repeat rows; state older than the watermark is dropped."""
    once = files.withColumn("scanned_at", F.col("scanned_at").cast("timestamp")).withWatermark("scanned_at", lateness).dropDuplicatesWithinWatermark(["file_id"])
    path = paths.norm_path(F.col("path"))
    return once.withColumn("path", path).withColumn("language", paths.language(path))


def symbol_stream(files: DataFrame) -> DataFrame:
    """Symbols of each new file, read from its lines."""
    return extract.line_symbols(files)


def language_counts(files: DataFrame, window: str = "7 days") -> DataFrame:
    """(start, language, files) of files by time window of their scan; late rows within the watermark still count."""
    counts = files.groupBy(F.window("scanned_at", window), "language").agg(F.count(F.lit(1)).alias("files"))
    return counts.select(F.col("window.start").alias("start"), "language", "files")
