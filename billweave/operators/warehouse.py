"""Rules on a warehouse's table catalog and job log."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billweave.functions.money import GB, TB
from billweave.functions.text import fill
from billweave.functions.wording import DEFAULT_LANG, phrases
from billweave.operators.findings import finding
from billweave.operators.ranking import top_per_group


def unpartitioned_tables(catalog: DataFrame, gb: float = 10) -> DataFrame:
    """Tables of at least ``gb`` GB with neither time nor range partitioning."""
    plain = ~(F.coalesce("time_partitioned", F.lit(False))
              | F.coalesce("range_partitioned", F.lit(False)))
    return (catalog.filter(plain & (F.col("num_bytes") >= gb * GB))
            .withColumn("size_gb", F.col("num_bytes") / F.lit(GB)))


def catalog_findings(catalog: DataFrame, gb: float = 10, high_gb: float = 100,
                     lang: str = DEFAULT_LANG) -> DataFrame:
    """AP-C01, one per table."""
    say = phrases(lang)
    size = F.col("size_gb")
    return unpartitioned_tables(catalog, gb).select(*finding(
        F.col("project"), "AP-C01",
        fill(say["AP-C01"], dataset=F.col("dataset"), table=F.col("table"),
             gb=F.translate(F.format_number(size, 1), ",", "")),
        F.when(size > high_gb, "high").otherwise("medium"), "cost",
        item=F.concat_ws(".", "dataset", "table"),
        evidence=fill(say["AP-C01_evidence"], bytes=F.col("num_bytes")),
        fix=say["fix_AP-C01"], metric=size, threshold=gb))


def job_usage(jobs: DataFrame, as_of: dt.datetime, days: int = 30) -> DataFrame:
    """Bytes billed and number of SELECT queries per project and user in the last ``days``."""
    since = F.lit((as_of - dt.timedelta(days=days)).isoformat(sep=" "))
    recent = jobs.filter((F.col("created") > since.cast(jobs.schema["created"].dataType))
                         & (F.col("job_type") == "QUERY")
                         & (F.col("statement_type") == "SELECT"))
    return (recent.groupBy("project", "user")
            .agg(F.sum("bytes_billed").alias("bytes_billed"), F.count(F.lit(1)).alias("jobs"))
            .withColumn("tb_billed", F.col("bytes_billed") / F.lit(TB)))


def top_users(usage: DataFrame, limit: int = 10) -> DataFrame:
    return top_per_group(usage, ["project"], [F.desc_nulls_last("tb_billed"), "user"], limit,
                         "rank")


def heavy_users(usage: DataFrame, tb: float = 1) -> DataFrame:
    """How many of a project's users are above ``tb`` TB, and the largest of them."""
    largest = F.struct(F.col("tb_billed"), F.col("user"))
    first = F.struct(-F.col("tb_billed"), F.col("user"))
    return (usage.filter(F.col("tb_billed") > tb).groupBy("project")
            .agg(F.count(F.lit(1)).alias("n_users"), F.min_by(largest, first).alias("top"))
            .select("project", "n_users", F.col("top.user").alias("top_user"),
                    F.col("top.tb_billed").alias("top_tb")))


def job_findings(jobs: DataFrame, as_of: dt.datetime, days: int = 30, tb: float = 1,
                 lang: str = DEFAULT_LANG) -> DataFrame:
    """AP-C02 on the job log, at most one per project."""
    say = phrases(lang)
    heavy = heavy_users(job_usage(jobs, as_of, days), tb)
    return heavy.select(*finding(
        F.col("project"), "AP-C02",
        fill(say["AP-C02_jobs"], n=F.col("n_users"), tb=F.lit(f"{tb:g}"), days=F.lit(str(days)),
             user=F.col("top_user"), top=F.translate(F.format_number("top_tb", 1), ",", "")),
        "high", "cost", item=F.col("top_user"),
        evidence=F.lit(say["AP-C02_jobs_evidence"].format(days=days)),
        fix=say["fix_AP-C02_jobs"], metric=F.col("top_tb"), threshold=tb))
