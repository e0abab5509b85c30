"""Tables and documents written out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, folder: str, name: str, mode: str = "overwrite", by: str | None = None) -> None:
    """One Parquet table, in folders by a column if asked; skewed values of it are spread over files by size."""
    writer = df.write.mode(mode)
    (writer.partitionBy(by) if by else writer).parquet(f"{folder}/{name}.parquet")


def write_documents(documents: DataFrame, folder: str, key: str = "repo", text: str = "document") -> None:
    """A text of each key as JSON lines of (key, text)."""
    documents.select(key, text).write.mode("overwrite").json(folder)


def rounded_weights(weights: DataFrame) -> DataFrame:
    """Weights to four digits, as an index is stored."""
    return weights.withColumn("weight", F.floor(F.col("weight") * 10000 + 0.5) / 10000)
