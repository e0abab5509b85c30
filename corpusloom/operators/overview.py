"""What a repository is made of: framework, entry points, packages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import paths

# Import prefixes of frameworks; the first that any import of a repository begins with names it.
FRAMEWORKS = (
    ("next", "Next.js"), ("next/", "Next.js"), ("react", "React"), ("react-dom", "React"), ("@angular/core", "Angular"), ("vue", "Vue.js"), ("svelte", "Svelte"), ("express", "Express"), ("fastify", "Fastify"), ("nestjs", "NestJS"),
    ("@nestjs/core", "NestJS"), ("django", "Django"), ("flask", "Flask"), ("fastapi", "FastAPI"), ("gin-gonic/gin", "Gin"), ("spring", "Spring Boot"),
)
# Names of files where programs start.
ENTRY_NAMES = ("main.go", "main.py", "__main__.py", "app.py", "manage.py", "main.ts", "index.ts", "main.rs", "Main.java", "server.ts", "server.js", "index.js")


def frameworks(imports: DataFrame) -> DataFrame:
    """(repo, framework) of repositories whose imports name one."""
    rank = F.lit(None).cast("int")
    for k, (prefix, _) in reversed(list(enumerate(FRAMEWORKS))):
        rank = F.when(F.col("source").startswith(prefix), F.lit(k)).otherwise(rank)
    best = imports.filter("source is not null").groupBy("repo").agg(F.min(rank).alias("k")).filter("k is not null")
    return best.select("repo", F.element_at(F.array(*[F.lit(n) for _, n in FRAMEWORKS]), F.col("k") + 1).alias("framework"))


def entry_points(files: DataFrame, top: int = 8) -> DataFrame:
    """(repo, path): up to ``top`` files of each repository where programs start, nearest to the root first, then by path."""
    p = F.col("path")
    hit = paths.basename(p).isin(*ENTRY_NAMES) | (p.rlike("^cmd/[^/]+/[^/]+$") & (paths.language(p) == "go"))
    rows = files.filter(hit).withColumn("depth", F.size(F.split("path", "/")))
    order = Window.partitionBy("repo").orderBy("depth", "path")
    return rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top).select("repo", "path")


def external_packages(imports: DataFrame, least: int = 2) -> DataFrame:
    """(repo, package, files): packages from outside and the files that import them, at least ``least``; a scope counts with its name."""
    outside = imports.filter("source is not null and resolved_path is null and not source rlike '^[./#~]|^@/'")
    package = F.when(F.col("source").startswith("@"), F.regexp_extract("source", r"^(@[^/]+/[^/]+)", 1)).otherwise(F.substring_index("source", "/", 1))
    return outside.select("repo", package.alias("package"), "path").distinct().groupBy("repo", "package").agg(F.count(F.lit(1)).alias("files")).filter(F.col("files") >= least)
