"""Named queries of this subpackage; each takes (spark, folder) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import clusters, credentials, docpairs, handwritten, leakage, neighbours, spam, syntax, tokens
from corpusloom.sources.tables import table


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of each document."""
    return tokens.encode_corpus(table(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a passage of an evaluation item."""
    return leakage.leaked_passages(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p9_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that hold no passage of an evaluation item."""
    documents = table(spark, folder, "documents")
    leaked = leakage.leaked_passages(documents, table(spark, folder, "eval_items"))
    return leakage.clean_documents(documents, leaked).select("doc_id").distinct()


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that are mostly keywords, links or product tags."""
    return spam.spam_pages(table(spark, folder, "documents")).select("doc_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Source files that do not parse."""
    return syntax.invalid_files(table(spark, folder, "files")).select("file_id")


def p4_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Files that do not parse by repository and language."""
    return syntax.checked_rates(table(spark, folder, "files"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Generated, minified and third-party files and data tables."""
    return handwritten.machine_files(table(spark, folder, "files")).select("file_id")


def p5_handwritten(spark: SparkSession, folder: str) -> DataFrame:
    """The source files that remain."""
    files = table(spark, folder, "files")
    return handwritten.handwritten_files(files, handwritten.machine_files(files)).select("file_id").distinct()


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Functions and methods with non-trivial documentation."""
    return docpairs.documented_functions(table(spark, folder, "files"), table(spark, folder, "symbols")).select("file_id", "name", "line")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Credentials in files and in the evidence of rules."""
    return credentials.found_credentials(table(spark, folder, "files"), table(spark, folder, "rules"))


def p7_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """The files with their credentials written over."""
    return credentials.redacted_files(table(spark, folder, "files")).select("file_id", "absolute_path", "content")


def p7_redacted_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The rules with the credentials of their evidence written over."""
    return credentials.redacted_rules(table(spark, folder, "rules")).select("rule_no", "evidence")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Units in clusters of at least two, by Markov clustering of their terms."""
    return clusters.cluster_units(table(spark, folder, "file_terms")).select("cluster_key", "unit_id")


def p1_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Each cluster with its size, cohesion, most typical terms and members."""
    units = table(spark, folder, "file_terms")
    return clusters.describe_clusters(clusters.cluster_units(units, flows=True), units)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of vectors that are among each other's five most similar, with a cosine of at least 0.8."""
    near = neighbours.nearest(table(spark, folder, "file_vectors"), k=5, min_cosine=0.8)
    return neighbours.mutual(near, 0.8).select("vec_a", "vec_b")


def p2_top5(spark: SparkSession, folder: str) -> DataFrame:
    """The five most similar others of each vector, however low their cosine."""
    return neighbours.exact_nearest(table(spark, folder, "file_vectors"), k=5)


QUERIES = {"p1_found": p1_found, "p1_clusters": p1_clusters, "p2_found": p2_found, "p2_top5": p2_top5, "p7_found": p7_found, "p7_redacted": p7_redacted, "p7_redacted_rules": p7_redacted_rules, "p5_found": p5_found, "p5_handwritten": p5_handwritten, "p6_found": p6_found, "p4_found": p4_found, "p4_rates": p4_rates, "p10_found": p10_found, "p8_ids": p8_ids, "p9_found": p9_found, "p9_clean": p9_clean}
SQL: dict[str, str] = {}
