import pytest
from pyspark.sql import functions as F

from corpusloom.functions import identifiers, paths


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(("name", "words"), [("getUserById", ["user"]), ("parse_http_request", ["parse", "http", "request"]), ("HTTPServerConfig", ["http", "server", "config"]), ("", [])])
def test_split_identifier(spark, name, words):
    assert one(spark, identifiers.split_identifier(F.col("v")), v=name) == words


def test_slug(spark):
    assert one(spark, identifiers.slug(F.col("v")), v="Feat: Adopt  the New--Thing! and more words here") == "feat-adopt-the-new-thing-and-m"


@pytest.mark.parametrize(("path", "want"), [(".\\a\\b//c.ts", "a/b/c.ts"), ("././x", "x"), ("/abs//x", "/abs/x"), ("", "")])
def test_norm_path(spark, path, want):
    assert one(spark, paths.norm_path(F.col("p")), p=path) == want


def test_path_parts(spark):
    row = spark.createDataFrame([("a/b/c.test.ts",), ("Makefile",), (".env",)], "p string").select(paths.extension(F.col("p")).alias("e"), paths.basename(F.col("p")).alias("b"), paths.stem(F.col("p")).alias("s"), paths.dirname(F.col("p")).alias("d"), paths.language(F.col("p")).alias("l"), paths.is_source(F.col("p")).alias("i")).collect()
    assert tuple(row[0]) == ("ts", "c.test.ts", "c.test", "a/b", "typescript", True)
    assert tuple(row[1]) == ("", "Makefile", "Makefile", "", "unknown", False)
    assert row[2].s == ".env"


@pytest.mark.parametrize(("glob", "path", "hit"), [("**/*.ts", "a/b.ts", True), ("*.ts", "a/b.ts", False), ("node_modules/**", "node_modules/x/y.js", True), ("node_modules/**", "a/node_modules/x", False), ("a?.py", "ab.py", True)])
def test_globs(spark, glob, path, hit):
    assert one(spark, paths.matches_any(F.col("p"), [glob]), p=path) is hit
    assert one(spark, F.expr("p rlike g"), p=path, g=paths.glob_regex(glob)) is hit
    assert one(spark, paths.glob_column(F.col("g")), g=glob) == paths.glob_regex(glob)


def test_gitignore_and_invalid_globs(spark):
    assert paths.gitignore_globs(["gen", "dist/", "# c", "", "!keep", "a/b", "*.log"]) == ["**/gen", "dist/**", "a/b", "*.log"]
    with pytest.raises(Exception, match="unterminated|missing|unbalanced"):
        paths.matches_any(F.col("p"), ["a("])
