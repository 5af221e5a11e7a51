"""The registered queries: every operator over the whole sample tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billweave.functions import money as m
from billweave.functions import text as t
from billweave.operators import (anonymize, apportion, bill_rules, diff, findings, hooks, models,
                                 querycost, reports, rewrite, scorecard, spend, usage, warehouse)
from billweave.plans import bindings as b
from billweave.operators.ranking import numbered
from billweave.operators.store import new_table
from billweave.sources.billing_csv import normalize_export, parse_lines, rejected_lines
from billweave.sources.rubric import default_rubric

# The bound bills count cents.
CENTS = 100
LIMIT_USD = 500.0

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def _lines(spark, sf_dir, ranked=False):
    return diff.delta_lines(b.billing_fact(spark, sf_dir), ranked)


def _bill_findings(spark, sf_dir):
    return bill_rules.bill_findings(_lines(spark, sf_dir), unit=CENTS)


# ---- sources: the four export formats ---------------------------------------------------------

def _normalized(raw: DataFrame) -> DataFrame:
    return (normalize_export(raw).groupBy("source_format", "service", "project")
            .agg(F.count(F.lit(1)).alias("n"),
                 (F.sum("cost") * 100).cast("bigint").alias("cost_cents")))


@query
def normalize_gcp(spark, sf_dir):
    return _normalized(b.gcp_export(spark, sf_dir))


@query
def normalize_cur(spark, sf_dir):
    return _normalized(b.cur_export(spark, sf_dir))


@query
def normalize_cost_explorer(spark, sf_dir):
    return _normalized(b.ce_export(spark, sf_dir))


@query
def normalize_generic(spark, sf_dir):
    return _normalized(b.generic_export(spark, sf_dir))


@query
def union_of_formats(spark, sf_dir):
    exports = (b.gcp_export, b.cur_export, b.ce_export, b.generic_export)
    parts = [normalize_export(export(spark, sf_dir)) for export in exports]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("source_format").agg(
        F.count(F.lit(1)).alias("n"), (F.sum("cost") * 100).cast("bigint").alias("cost_cents"))


@query
def csv_files(spark, sf_dir):
    return (parse_lines(b.csv_lines(spark, sf_dir)).groupBy("source_format", "service", "project")
            .agg(F.count(F.lit(1)).alias("n"), (F.sum("cost") * 100).cast("bigint").alias("cost_cents")))


@query
def csv_line_breaks(spark, sf_dir):
    return (parse_lines(b.broken_csv_lines(spark, sf_dir)).groupBy("service", "project")
            .agg(F.count(F.lit(1)).alias("n"), (F.sum("cost") * 100).cast("bigint").alias("cost_cents")))


@query
def rejected_cells(spark, sf_dir):
    return (rejected_lines(b.csv_lines(spark, sf_dir)).groupBy("source_format", "service", "cell", "reason")
            .agg(F.count(F.lit(1)).alias("n")))


@query
def parsed_cells(spark, sf_dir):
    cells = b.cost_cells(spark, sf_dir).select("project", "cell", m.parse_money(F.col("cell")).alias("cost"))
    reason = F.when(F.col("cost").isNull(), m.reject_reason(F.col("cell")))
    return (cells.withColumn("reason", reason).groupBy("project", "reason")
            .agg(F.count(F.lit(1)).alias("n"), (F.sum("cost") * 100).cast("bigint").alias("cents")))


@query
def parse_money(spark, sf_dir):
    items = b.generic_export(spark, sf_dir)
    parsed = m.parse_money(F.col("cost"))
    return items.groupBy("project").agg(
        F.count(F.lit(1)).alias("n"), F.count(parsed).alias("n_parsed"),
        (F.sum(parsed) * 100).cast("bigint").alias("cents"))


@query
def total_rows(spark, sf_dir):
    items = b.generic_export(spark, sf_dir)
    return items.groupBy("project").agg(
        F.count_if(m.is_total_row(m.strip(F.col("service")))).alias("n_total_rows"))


# ---- bill comparison --------------------------------------------------------------------------

@query
def total_cost(spark, sf_dir):
    return diff.total_cost(b.billing_fact(spark, sf_dir))


@query
def cost_by_service(spark, sf_dir):
    return diff.cost_by_service(b.billing_fact(spark, sf_dir))


@query
def cost_by_project(spark, sf_dir):
    return diff.cost_by_project(b.billing_fact(spark, sf_dir))


@query
def cost_by_grain(spark, sf_dir):
    return diff.cost_by_grain(b.billing_fact(spark, sf_dir))


@query
def pair_totals(spark, sf_dir):
    return diff.pair_totals(b.billing_fact(spark, sf_dir))


@query
def delta_lines(spark, sf_dir):
    return _lines(spark, sf_dir)


@query
def ranked_lines(spark, sf_dir):
    return _lines(spark, sf_dir, ranked=True).select(
        *diff.GRAIN, "key", "delta", "rank", "driver_rank", "counter_rank")


@query
def diff_two_months(spark, sf_dir):
    return diff.diff_two(*b.two_months(spark, sf_dir), period=b.LATER[0])


@query
def diff_two_totals(spark, sf_dir):
    return diff.diff_two_totals(*b.two_months(spark, sf_dir), period=b.LATER[0])


@query
def drivers(spark, sf_dir):
    return diff.drivers(_lines(spark, sf_dir)).select(
        *diff.PAIR, "position", "key", "delta", "share_pct")


@query
def counter_movers(spark, sf_dir):
    return diff.counter_movers(_lines(spark, sf_dir)).select(
        *diff.PAIR, "key", "delta", "share_pct")


@query
def top_project(spark, sf_dir):
    return diff.top_project(_lines(spark, sf_dir)).select(*diff.PAIR, "key", "delta", "share_pct")


@query
def driver_coverage(spark, sf_dir):
    return diff.driver_coverage(_lines(spark, sf_dir))


@query
def top_services(spark, sf_dir):
    return diff.top_services(b.billing_fact(spark, sf_dir))


@query
def money_formats(spark, sf_dir):
    delta = m.amount(F.col("delta"), CENTS)
    return _lines(spark, sf_dir).select(
        *diff.GRAIN, "key", m.money(m.amount(F.col("after"), CENTS)).alias("after_text"),
        m.signed_money(delta).alias("delta_text"), m.percent(F.col("share_pct")).alias("share"),
        m.coarse_amount(delta).alias("coarse"),
        reports.driver_label().alias("label"), reports.driver_detail(CENTS).alias("detail"))


@query
def headlines(spark, sf_dir):
    return diff.pair_totals(b.billing_fact(spark, sf_dir)).select(
        *diff.PAIR, reports.headline(CENTS).alias("headline"),
        reports.headline(CENTS, "en").alias("headline_en"))


@query
def bill_findings(spark, sf_dir):
    return _bill_findings(spark, sf_dir)


def _one_rule(code: str):
    def build(spark, sf_dir):
        return _bill_findings(spark, sf_dir).filter(F.col("code") == code).select(
            "subject", "period", "item", "severity", "metric")
    return build


QUERIES["bill_spike"] = _one_rule("BILL-01")
QUERIES["bill_new_service"] = _one_rule("BILL-02")
QUERIES["bill_project_share"] = _one_rule("BILL-03")


# ---- reports ----------------------------------------------------------------------------------

@query
def report_text(spark, sf_dir):
    return reports.report_text(_lines(spark, sf_dir, ranked=True), unit=CENTS)


@query
def report_markdown(spark, sf_dir):
    return reports.report_markdown(_lines(spark, sf_dir), unit=CENTS)


@query
def report_json(spark, sf_dir):
    return reports.report_json(_lines(spark, sf_dir, ranked=True), unit=CENTS)


@query
def anonymous_lines(spark, sf_dir):
    coarse = {name: f"{name}_text" for name in ("before", "after", "delta")}
    return anonymize.anonymize(_lines(spark, sf_dir, ranked=True),
                               unit=CENTS).withColumnsRenamed(coarse)


@query
def project_aliases(spark, sf_dir):
    return anonymize.project_aliases(_lines(spark, sf_dir, ranked=True))


@query
def lessons(spark, sf_dir):
    return anonymize.lessons(_lines(spark, sf_dir, ranked=True))


@query
def anonymous_report(spark, sf_dir):
    return anonymize.anonymous_report(_lines(spark, sf_dir, ranked=True), sector="retail",
                                      unit=CENTS)


@query
def anonymous_breakdown(spark, sf_dir):
    return anonymize.anonymous_breakdown(b.billing_fact(spark, sf_dir), unit=CENTS)


# ---- spend rules ------------------------------------------------------------------------------

@query
def spend_by_service(spark, sf_dir):
    return spend.spend_by_service(b.spend_fact(spark, sf_dir), b.AS_OF)


@query
def spend_by_account(spark, sf_dir):
    return spend.spend_by_account(spend.spend_by_service(b.spend_fact(spark, sf_dir), b.AS_OF))


@query
def projected_growth(spark, sf_dir):
    return spend.projected_growth(spend_by_account(spark, sf_dir), b.AS_OF).select(
        "account", "last_month", "this_month", "projected", "growth_pct")


@query
def untagged_share(spark, sf_dir):
    return spend.untagged_share(spend_by_account(spark, sf_dir)).select(
        "account", "untagged", "untagged_share")


@query
def top_spend_services(spark, sf_dir):
    return spend.top_spend_services(spend_by_service(spark, sf_dir)).select(
        "account", "rank", "service", "last_month")


@query
def spend_findings(spark, sf_dir):
    return spend.spend_findings(b.spend_fact(spark, sf_dir), b.AS_OF, unit=CENTS)


# ---- warehouse rules --------------------------------------------------------------------------

@query
def unpartitioned_tables(spark, sf_dir):
    return warehouse.unpartitioned_tables(b.catalog(spark, sf_dir)).select(
        "dataset", "table", "num_bytes", "size_gb")


@query
def catalog_findings(spark, sf_dir):
    return warehouse.catalog_findings(b.catalog(spark, sf_dir))


@query
def job_usage(spark, sf_dir):
    return warehouse.job_usage(b.job_log(spark, sf_dir), b.JOBS_AS_OF)


@query
def top_users(spark, sf_dir):
    return warehouse.top_users(job_usage(spark, sf_dir)).select("user", "rank", "tb_billed")


@query
def heavy_users(spark, sf_dir):
    return warehouse.heavy_users(job_usage(spark, sf_dir))


@query
def job_findings(spark, sf_dir):
    return warehouse.job_findings(b.job_log(spark, sf_dir), b.JOBS_AS_OF)


# ---- model rules ------------------------------------------------------------------------------

@query
def table_idleness(spark, sf_dir):
    return usage.table_idleness(b.dated_catalog(spark, sf_dir), b.reading_jobs(spark, sf_dir), b.SNAPSHOTS)


@query
def retention_bands(spark, sf_dir):
    bands = spark.createDataFrame(b.BANDS, "lower int, upper int, action string")
    return usage.retention(b.dated_catalog(spark, sf_dir), b.reading_jobs(spark, sf_dir), bands, b.RETENTION_DAY)


@query
def repartition_check(spark, sf_dir):
    """lineitem rewritten by day, read back and compared with what it was."""
    items, path = b.table(spark, sf_dir, "lineitem"), new_table(spark)
    rewrite.rewrite_by_day(items, path, "l_shipdate", cluster=["l_orderkey"])
    return rewrite.reconcile(items, spark.read.parquet(path), "l_shipdate")


@query
def component_parts(spark, sf_dir):
    return apportion.apportion(b.query_parts(spark, sf_dir), ["suite", "query"])


@query
def component_costs(spark, sf_dir):
    return apportion.component_costs(b.query_parts(spark, sf_dir), ["suite", "query"], ["suite"])


@query
def missing_marker(spark, sf_dir):
    return models.missing_marker(b.project_roots(spark, sf_dir))


@query
def model_coverage(spark, sf_dir):
    status = models.model_status(b.model_files(spark, sf_dir), b.model_meta(spark, sf_dir))
    return models.model_coverage(status)


@query
def untested_models(spark, sf_dir):
    return models.untested_models(b.model_files(spark, sf_dir), b.model_meta(spark, sf_dir))


@query
def undescribed_models(spark, sf_dir):
    return models.undescribed_models(b.model_files(spark, sf_dir), b.model_meta(spark, sf_dir))


@query
def table_freshness(spark, sf_dir):
    return models.table_freshness(b.source_meta(spark, sf_dir), b.sources(spark, sf_dir))


@query
def source_freshness(spark, sf_dir):
    return models.source_freshness(b.source_meta(spark, sf_dir))


@query
def pattern_models(spark, sf_dir):
    return models.select_star(b.model_files(spark, sf_dir), b.MODEL_PATTERN).select(
        "project", "path", "name")


@query
def select_star_models(spark, sf_dir):
    """Stands for the real pattern: each text is turned into a query that reads every column,
    with two blanks on some and another list on others."""
    files = b.model_files(spark, sf_dir)
    odd = F.length("sql") % 3
    sql = F.concat(F.when(odd == 0, "SELECT  * \n FROM ").when(odd == 1, "select id, * from ")
                   .otherwise("Select * From "), F.col("sql"))
    starred = models.select_star(files.withColumn("sql", sql))
    return starred.groupBy("project").agg(F.count(F.lit(1)).alias("n"))


@query
def model_findings(spark, sf_dir):
    return models.model_findings(
        b.model_files(spark, sf_dir), b.model_meta(spark, sf_dir), b.source_meta(spark, sf_dir),
        b.project_roots(spark, sf_dir), pattern=b.MODEL_PATTERN)


# ---- query cost -------------------------------------------------------------------------------

def _priced(spark, sf_dir):
    return querycost.price_queries(b.query_log(spark, sf_dir))


@query
def query_prices(spark, sf_dir):
    return _priced(spark, sf_dir).withColumn("usd", F.col("usd").cast("double"))


@query
def cost_gate(spark, sf_dir):
    return querycost.cost_gate(_priced(spark, sf_dir), ["suite"], LIMIT_USD)


@query
def cost_cells(spark, sf_dir):
    return querycost.cost_cells(_priced(spark, sf_dir), 50.0).select("path", "scans", "costs")


@query
def cost_report_text(spark, sf_dir):
    return querycost.cost_report(_priced(spark, sf_dir), ["suite"], LIMIT_USD)


@query
def cost_report_github(spark, sf_dir):
    return querycost.cost_report(_priced(spark, sf_dir), ["suite"], LIMIT_USD, "github")


@query
def cost_json(spark, sf_dir):
    return querycost.cost_json(_priced(spark, sf_dir), ["suite"])


# ---- scorecard --------------------------------------------------------------------------------

def _scores(spark, sf_dir):
    return scorecard.dimension_scores(b.answers(spark, sf_dir), default_rubric(spark))


@query
def dimension_scores(spark, sf_dir):
    return _scores(spark, sf_dir)


@query
def overall_scores(spark, sf_dir):
    return scorecard.overall_scores(_scores(spark, sf_dir), default_rubric(spark))


@query
def scorecard_report(spark, sf_dir):
    return scorecard.scorecard_report(_scores(spark, sf_dir), default_rubric(spark))


@query
def scorecard_with_findings(spark, sf_dir):
    """Users have scores, accounts have findings; the report covers both."""
    return scorecard.scorecard_report(
        _scores(spark, sf_dir), default_rubric(spark),
        spend.spend_findings(b.spend_fact(spark, sf_dir), b.AS_OF, unit=CENTS))


# ---- findings of all rules --------------------------------------------------------------------

def _all_findings(spark, sf_dir):
    return findings.union_findings(
        _bill_findings(spark, sf_dir), spend_findings(spark, sf_dir),
        catalog_findings(spark, sf_dir), job_findings(spark, sf_dir),
        model_findings(spark, sf_dir))


@query
def all_findings(spark, sf_dir):
    return _all_findings(spark, sf_dir).groupBy("code", "severity", "dimension").agg(
        F.count(F.lit(1)).alias("n"))


@query
def high_severity_count(spark, sf_dir):
    return findings.high_severity_count(_all_findings(spark, sf_dir))


@query
def finding_texts(spark, sf_dir):
    return _all_findings(spark, sf_dir).select(
        "subject", "period", "item", "code",
        t.severity_rank(F.col("severity")).alias("severity_rank"),
        findings.finding_text().alias("text"))


@query
def findings_by_severity(spark, sf_dir):
    """All findings in order; the position makes the order part of the result."""
    found = _all_findings(spark, sf_dir)
    everything = found.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("list", F.lit("all"))
    rank = t.severity_rank(F.col("severity")).alias("rank")
    month = F.coalesce(F.col("period").cast("string"), F.lit("")).alias("month")
    placed = numbered(found.select("*", rank, month, F.lit("all").alias("list")), everything,
                      ["list"], ["rank", "code", "subject", "month", "item"],
                      {"position": F.lit(1)})
    return placed.select("position", "subject", "period", "item", "code", "severity")


@query
def quantified_findings(spark, sf_dir):
    """A quantifier that prices each new-service finding with what the service costs in a year."""
    lines = _lines(spark, sf_dir)
    yearly = lines.filter((F.col("grain") == "service") & F.col("is_new")).select(
        F.col("account").alias("subject"), "period", F.col("key").alias("item"),
        m.money(m.amount(F.col("after") * 12, CENTS)).alias("yearly"))

    def price_newcomers(found: DataFrame) -> DataFrame:
        impact = F.when(F.col("code") == "BILL-02", F.col("yearly")).otherwise(F.col("impact_usd"))
        return (found.join(yearly, ["subject", "period", "item"], "left")
                .withColumn("impact_usd", impact).drop("yearly"))

    priced = hooks.apply_quantifiers(bill_rules.bill_findings(lines, unit=CENTS), price_newcomers)
    return priced.select("subject", "period", "item", "code", "impact_usd")


@query
def rendered_findings(spark, sf_dir):
    """A caller's own renderer: one line per account from its findings and the comparison."""
    def digest(found: DataFrame, context: dict[str, DataFrame]) -> DataFrame:
        per_account = found.groupBy("subject").agg(F.count(F.lit(1)).alias("n"))
        months = (context["totals"].groupBy(F.col("account").alias("subject"))
                  .agg(F.count(F.lit(1)).alias("months")))
        return per_account.join(months, "subject").select(
            "subject", F.concat_ws(" / ", F.col("n").cast("string"),
                                   F.col("months").cast("string")).alias("digest"))

    fact = b.billing_fact(spark, sf_dir)
    return hooks.render({"digest": digest}, "digest", _bill_findings(spark, sf_dir),
                        {"totals": diff.pair_totals(fact)})


@query
def template_report(spark, sf_dir):
    """A caller's own template; being the only one, it replaces the default."""
    def short(lines: DataFrame) -> DataFrame:
        leaders = diff.top_project(lines)
        return leaders.select(*diff.PAIR, m.percent(F.abs("share_pct")).alias("share"))

    template = hooks.choose({"short": short}, "default",
                            {"default": anonymize.anonymous_report})
    return template(_lines(spark, sf_dir))
