"""The common shape of findings and what is done with them once rules have produced them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billweave.functions.text import fill, severity_icon, severity_rank
from billweave.functions.wording import DEFAULT_LANG, phrases

# subject = account, project or platform under review; item = what within it the finding is about.
FINDING_COLUMNS = ["subject", "period", "item", "code", "title", "severity", "dimension",
                   "evidence", "fix", "impact_usd", "metric", "threshold"]


def finding(subject: Column, code: str, title: Column, severity: Column | str, dimension: str, *,
            period: Column | None = None, item: Column | None = None,
            evidence: Column | None = None, fix: str = "", metric: Column | None = None,
            threshold: float | None = None) -> list[Column]:
    """The columns of one finding, in FINDING_COLUMNS order."""
    empty = F.lit("")
    return [
        subject.cast("string").alias("subject"),
        (F.lit(None) if period is None else period).cast("date").alias("period"),
        (empty if item is None else item).cast("string").alias("item"),
        F.lit(code).alias("code"),
        title.alias("title"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        F.lit(dimension).alias("dimension"),
        (empty if evidence is None else evidence).alias("evidence"),
        F.lit(fix).alias("fix"),
        empty.alias("impact_usd"),
        (F.lit(None) if metric is None else metric).cast("double").alias("metric"),
        F.lit(threshold).cast("double").alias("threshold"),
    ]


def emit(df: DataFrame, *rules: tuple[Column, list[Column]]) -> DataFrame:
    """One finding per row and rule whose condition holds, all rules in one pass over ``df``."""
    found = F.array_compact(F.array(*[F.when(condition, F.struct(*columns))
                                      for condition, columns in rules]))
    return df.select(F.inline(found))


def union_findings(*found: DataFrame) -> DataFrame:
    """All findings in one table, whatever extra columns a rule carries."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def by_severity() -> list[Column]:
    """Most severe first, then a fixed order."""
    return [severity_rank(F.col("severity")), F.col("code"), F.col("subject"), F.col("period"),
            F.col("item")]


def finding_text(lang: str = DEFAULT_LANG) -> Column:
    """Printed form of a finding; empty parts are left out."""
    say = phrases(lang)
    head = F.concat(severity_icon(F.col("severity")), F.lit(" ["), "code", F.lit("] "), "title")

    def part(name: str, column: str) -> Column:
        return F.when(F.col(column) != "", fill(say[name], text=F.col(column)))

    # concat_ws leaves NULLs out.
    return F.concat_ws("\n", head, part("evidence", "evidence"), part("impact", "impact_usd"),
                       part("fix", "fix"))


def high_severity_count(findings: DataFrame) -> DataFrame:
    """Number of critical and high findings per subject, 0 included."""
    return findings.groupBy("subject").agg(
        F.count_if(F.col("severity").isin("critical", "high")).alias("n_high"))
