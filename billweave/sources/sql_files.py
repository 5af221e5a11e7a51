"""Folders of SQL text and of model projects."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def outermost(paths: list[str]) -> list[str]:
    """Drop repeated paths and those inside another given path, so that no file is read twice."""
    tidy = {posixpath.normpath(path) if "://" not in path else path.rstrip("/")
            for path in paths}

    def parents(path: str):
        while (path := posixpath.dirname(path)) not in ("", "/") and not path.endswith(":/"):
            yield path

    return sorted(path for path in tidy if tidy.isdisjoint(parents(path)))


def _read_texts(spark: SparkSession, paths: list[str], pattern: str) -> DataFrame:
    return (spark.read.option("recursiveFileLookup", True)
            .option("pathGlobFilter", pattern).text(paths, wholetext=True)
            .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def read_sql_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Every .sql file in the given files and folders, each once: path, sql."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return _read_texts(spark, outermost(paths), "*.sql").withColumnRenamed("text", "sql")


def _decoded(path: Column) -> Column:
    """File paths come in URL form; a plus sign stands for itself."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _within_project(texts: DataFrame, base: str, depth: int) -> DataFrame:
    """Split <base>/<project>/<...>: the project is the ``depth`` folders below ``base``."""
    tail = base.rstrip("/").rpartition("://")[2]
    plain = _decoded(F.col("path"))
    below = F.substr(plain, F.instr(plain, f"{tail}/") + len(tail) + 1)
    parts = r"^((?:[^/]+/){%d}[^/]+)/(.+)$" % (depth - 1)
    return (texts.withColumn("project", F.regexp_extract(below, parts, 1))
            .withColumn("path", F.regexp_extract(below, parts, 2)))


def _below(base: str, depth: int, *more: str) -> str:
    return "/".join([base.rstrip("/"), *["*"] * depth, *more])


def read_model_files(spark: SparkSession, base: str, depth: int = 1) -> DataFrame:
    """SQL models of every project folder, ``depth`` folders below ``base``: project, path, name,
    sql."""
    texts = _within_project(_read_texts(spark, [_below(base, depth, "models")], "*.sql"), base, depth)
    return texts.select("project", "path",
                        F.regexp_extract("path", r"([^/]+)\.sql$", 1).alias("name"),
                        F.col("text").alias("sql"))


def read_schema_files(spark: SparkSession, base: str, depth: int = 1) -> DataFrame:
    """YAML files beside the models: project, path, yaml."""
    texts = _read_texts(spark, [_below(base, depth, "models")], "*.yml")
    return _within_project(texts, base, depth).select("project", "path", F.col("text").alias("yaml"))


def read_project_roots(spark: SparkSession, base: str, projects: DataFrame,
                       depth: int = 1) -> DataFrame:
    """Which of the expected ``projects`` hold a project file directly in their folder."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "dbt_project.yml")
             .load(_below(base, depth)).select("path"))
    marked = (_within_project(files, base, depth).filter(F.col("path") == "dbt_project.yml")
              .select("project").distinct().withColumn("has_marker", F.lit(True)))
    return (projects.select("project").distinct().join(marked, "project", "left")
            .select("project", F.coalesce("has_marker", F.lit(False)).alias("has_marker")))
