"""Rules on projects of SQL models: tests, descriptions, freshness, SELECT *.

Inputs: ``files (project, path, name, sql)``, ``model_meta (project, name, has_description,
has_tests)``, ``source_meta (project, source, table, has_freshness)`` and ``roots (project,
has_marker)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billweave.functions.money import percent
from billweave.functions.text import fill
from billweave.functions.wording import DEFAULT_LANG, phrases
from billweave.operators.findings import emit, finding, union_findings
from billweave.operators.ranking import top_per_group

# Fixed value: the shape of a query that reads every column.
SELECT_STAR = r"(?i)select\s+\*\s+from"
EXAMPLES = 5


def missing_marker(roots: DataFrame) -> DataFrame:
    return roots.filter(~F.col("has_marker")).select("project")


def with_marker(df: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of projects that have their project file; of the others nothing more is reported.

    Joined by a struct: partitioning by project must not carry over to what follows, so that
    adaptive execution may split a large project.
    """
    root = F.struct("project").alias("root")
    marked = roots.filter("has_marker").select(root)
    return df.select(root, "*").join(marked, "root", "left_semi").drop("root")


def model_status(files: DataFrame, model_meta: DataFrame) -> DataFrame:
    """One row per project and model name (files of one name in several folders are one model)
    with what the metadata says about it."""
    said = model_meta.groupBy("project", "name").agg(
        F.max("has_description").alias("described"), F.max("has_tests").alias("tested"))
    no = F.lit(False)
    return (files.select("project", "name").distinct()
            .join(said, ["project", "name"], "left")
            .select("project", "name", F.coalesce("tested", no).alias("tested"),
                    F.coalesce("described", no).alias("described")))


def model_coverage(status: DataFrame) -> DataFrame:
    every = F.count(F.lit(1))
    untested, undescribed = F.count_if(~F.col("tested")), F.count_if(~F.col("described"))
    return status.groupBy("project").agg(
        every.alias("models"), untested.alias("untested"), undescribed.alias("undescribed"),
        ((every - untested) * 100 / every).alias("coverage_pct"),
        (undescribed / every).alias("undescribed_share"))


def untested_models(files: DataFrame, model_meta: DataFrame) -> DataFrame:
    tested = model_meta.filter("has_tests").select("project", "name")
    return (files.select("project", "name").distinct()
            .join(tested, ["project", "name"], "left_anti"))


def undescribed_models(files: DataFrame, model_meta: DataFrame) -> DataFrame:
    described = model_meta.filter("has_description").select("project", "name")
    return (files.select("project", "name").distinct()
            .join(described, ["project", "name"], "left_anti"))


def table_freshness(tables: DataFrame, sources: DataFrame) -> DataFrame:
    """Tables with a freshness rule of their own or of their source.

    ``tables``: project, source, table, has_freshness; ``sources``: project, source, has_freshness,
    one row or more each. A table whose source is not among them has only its own.
    """
    by_source = (sources.groupBy("project", "source")
                 .agg(F.bool_or("has_freshness").alias("source_has_freshness")))
    return (tables.join(by_source, ["project", "source"], "left")
            .select("project", "source", "table",
                    (F.coalesce("has_freshness", F.lit(False))
                     | F.coalesce("source_has_freshness", F.lit(False))).alias("has_freshness")))


def source_freshness(source_meta: DataFrame) -> DataFrame:
    every, fresh = F.count(F.lit(1)), F.count_if("has_freshness")
    return source_meta.groupBy("project").agg(
        every.alias("tables"), fresh.alias("fresh"), (fresh / every).alias("fresh_share"))


def select_star(files: DataFrame, pattern: str = SELECT_STAR,
                allowed: Column | None = None) -> DataFrame:
    """Models that match ``pattern``; those with 'staging' in their path are allowed to."""
    allowed = F.col("path").contains("staging") if allowed is None else allowed
    return files.filter(~allowed & F.col("sql").rlike(pattern))


def first_names(rows: DataFrame, group: list[str], order: str, n: int = EXAMPLES) -> DataFrame:
    """The first n names per group as one text; only n rows per group are ever collected."""
    kept = top_per_group(rows, group, [order], n)
    return (kept.groupBy(*group)
            .agg(F.array_sort(F.collect_list(F.struct("position", "name"))).alias("kept"))
            .select(*group, F.array_join(F.transform("kept", lambda k: k["name"]), ", ")
                    .alias("names")))


def gap_examples(status: DataFrame) -> DataFrame:
    """Per project the first untested and the first undescribed models, in one pass."""
    gaps = F.array_compact(F.array(F.when(~F.col("tested"), "tests"),
                                   F.when(~F.col("described"), "docs")))
    names = first_names(status.select("project", "name", F.explode(gaps).alias("gap")),
                        ["project", "gap"], "name")
    return names.groupBy("project").agg(
        *[F.max(F.when(F.col("gap") == gap, F.col("names"))).alias(f"{gap}_names")
          for gap in ("tests", "docs")])


def model_findings(files: DataFrame, model_meta: DataFrame, source_meta: DataFrame,
                   roots: DataFrame, pattern: str = SELECT_STAR, allowed: Column | None = None,
                   coverage: float = 60, low_coverage: float = 30, undescribed: float = 0.5,
                   fresh: float = 0.5, lang: str = DEFAULT_LANG) -> DataFrame:
    """DBT-00, AP-G02, AP-G02b, AP-AI01 and AP-C02, each at most once per project."""
    say = phrases(lang)
    project = F.col("project")
    lost = missing_marker(roots).select(*finding(
        project, "DBT-00", fill(say["DBT-00"], project=project), "high", "architecture",
        evidence=project))

    status = with_marker(model_status(files, model_meta), roots)
    covered = model_coverage(status).join(gap_examples(status), "project", "left")

    def examples(names: str) -> Column:
        return fill(say["examples"], names=F.col(names))

    pct = F.col("coverage_pct")
    tests = finding(
        project, "AP-G02",
        fill(say["AP-G02"], pct=percent(pct), untested=F.col("untested"), all=F.col("models")),
        F.when(pct < low_coverage, "high").otherwise("medium"), "quality",
        evidence=examples("tests_names"), fix=say["fix_AP-G02"], metric=pct, threshold=coverage)
    docs = finding(
        project, "AP-G02b",
        fill(say["AP-G02b"], undescribed=F.col("undescribed"), all=F.col("models")),
        "medium", "governance", evidence=examples("docs_names"), fix=say["fix_AP-G02b"],
        metric=F.col("undescribed_share"), threshold=undescribed)
    gaps = emit(covered, (pct < coverage, tests),
                (F.col("undescribed_share") > undescribed, docs))
    stale = (with_marker(source_freshness(source_meta), roots)
             .filter(F.col("fresh_share") < fresh)
             .select(*finding(
                 project, "AP-AI01",
                 fill(say["AP-AI01"], fresh=F.col("fresh"), all=F.col("tables")),
                 "medium", "ai_readiness", fix=say["fix_AP-AI01"],
                 metric=F.col("fresh_share"), threshold=fresh)))
    # Texts are matched in the scan. What is left of a match is small and shuffled once; counting
    # and the choice of examples both read that shuffle, for which they need the same columns.
    starred = (with_marker(select_star(files, pattern, allowed), roots)
               .select("project", "path", "name").repartition("project", "path"))
    counted = starred.groupBy("project").agg(F.count("name").alias("n"))
    stars = counted.join(first_names(starred, ["project"], "path"), "project").select(*finding(
        project, "AP-C02", fill(say["AP-C02_models"], n=F.col("n")), "medium", "cost",
        evidence=examples("names"), fix=say["fix_AP-C02_models"], metric=F.col("n")))
    return union_findings(lost, gaps, stale, stars)
