"""How the sample tables stand in for bills, logs, catalogs and models.

Every binding reads whole tables and names only the columns it needs, so that the scans prune.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billweave.operators.store import stored
from billweave.sources.rubric import DIMENSIONS

# Day on which the spend rules look back.
AS_OF = dt.date(2000, 6, 15)
# Moment at which the job-log rule looks back.
JOBS_AS_OF = dt.datetime(2024, 1, 31)


# Given, so that no job reads file footers before the plan exists.
TABLES = {
    "nation": "n_nationkey int, n_name string",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint",
    "part": "p_partkey bigint, p_type string",
    "lineitem": ("l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, "
                 "l_extendedprice double, l_returnflag string, l_shipdate timestamp_ntz"),
    "events": ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
               "value double"),
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its account (nation), project (segment) and service (part type)."""
    owners = (table(spark, sf_dir, "customer")
              .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
              .select("c_custkey", F.col("n_name").alias("account"),
                      F.col("c_mktsegment").alias("project")))
    orders = (table(spark, sf_dir, "orders")
              .join(owners, F.col("o_custkey") == F.col("c_custkey"))
              .select("o_orderkey", "account", "project"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("service"))
    return (table(spark, sf_dir, "lineitem")
            .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(parts, F.col("l_partkey") == F.col("p_partkey"))
            .withColumn("cost", F.round(F.col("l_extendedprice") * 100).cast("bigint")))


def billing_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost in whole cents."""
    return _sales(spark, sf_dir).select(
        "account", F.trunc(F.col("l_shipdate").cast("date"), "MM").alias("period"),
        "service", "project", "cost")


def spend_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily spend with a team tag, cost in whole cents."""
    return _sales(spark, sf_dir).select(
        "account", F.col("l_shipdate").alias("used_at"), "service",
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("team_tag"), "cost")


# The two months compared directly, by their first days and the days after their last.
EARLIER = (dt.date(1999, 1, 1), dt.date(1999, 2, 1))
LATER = (dt.date(2000, 1, 1), dt.date(2000, 2, 1))


def two_months(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots to compare directly; the month filter is on the scanned column."""
    shipped = F.col("used_at")

    def month(first: dt.date, end: dt.date) -> DataFrame:
        sales = _sales(spark, sf_dir).withColumnRenamed("l_shipdate", "used_at")
        kind = sales.schema["used_at"].dataType
        return sales.filter((shipped >= F.lit(first.isoformat()).cast(kind))
                            & (shipped < F.lit(end.isoformat()).cast(kind))).select(
            "account", F.lit(first).alias("period"), "service", "project", "cost")

    return month(*EARLIER), month(*LATER)


def _line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with the service, and with total rows and unreadable costs among the cells."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    line = F.col("l_linenumber")
    price = F.format_number("l_extendedprice", 2)
    return (table(spark, sf_dir, "lineitem")
            .join(parts, F.col("l_partkey") == F.col("p_partkey"))
            .select(
                F.when(line == 6, " Total ").when(line == 7, "")
                 .when(line == 5, F.concat(F.lit("\u00a0"), "p_type", F.lit("\u2003")))
                 .otherwise(F.col("p_type")).alias("service"),
                F.when(F.col("l_quantity") == 1, "n/a").when(F.col("l_quantity") == 2, "nan")
                 .when(F.col("l_quantity") == 3, F.concat(F.lit(" $ "), price))
                 .when(F.col("l_quantity") == 4, F.concat(F.lit("\u00a0$\u00a0"), price,
                                                          F.lit("\u00a0")))
                 .otherwise(price).alias("cost"),
                F.concat(F.lit(" "), "l_returnflag", F.lit(" ")).alias("project"),
                F.col("l_orderkey").cast("string").alias("line_id"),
                (line % 2 == 0).alias("even")))


def gcp_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_items(spark, sf_dir).select(
        F.col("project").alias("Project name"), F.col("line_id").alias("Project ID"),
        F.col("service").alias("Service description"), F.lit("1.00").alias("Cost ($)"),
        F.col("cost").alias("Subtotal ($)"))


def cur_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_items(spark, sf_dir).select(
        F.col("line_id").alias("identity/LineItemId"),
        F.col("project").alias("lineItem/UsageAccountId"),
        F.col("service").alias("lineItem/ProductCode"),
        F.col("cost").alias("lineItem/UnblendedCost"))


def ce_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cost is in the last or, on even lines, in the last but one cell."""
    return _line_items(spark, sf_dir).select(
        F.col("service").alias("Service"), F.lit("5.00").alias("2000-05-01"),
        F.when(F.col("even"), F.col("cost")).otherwise("7.00").alias("2000-06-01"),
        F.when(~F.col("even"), F.col("cost")).alias("Total costs ($)"))


def generic_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_items(spark, sf_dir).select("service", "cost", "project")


def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of four CSV files, one for each layout: quoted cells with commas, short rows and, in
    every fifth row of the third file, a cell beyond the header that holds the cost."""
    # Dealt out as the splits of files are, also where most rows are of one order or of none or are copies of one
    # another, and written once: the lines are read more than once, as files are.
    cells = ("service", "cost", "project", "line_id")
    items = stored(_line_items(spark, sf_dir).select(*cells).hint("rebalance", *cells))
    quoted = F.concat(F.lit('"'), "cost", F.lit('"'))
    number = F.col("line_id").cast("bigint")
    short = number % 7 == 0

    def text(*cells) -> Column:
        return F.concat_ws(",", *[F.lit(c) if isinstance(c, str) else c for c in cells])

    service, project = F.col("service"), F.col("project")
    files = {
        "gcp": ("\ufeffProject name,Project ID,Service description,Cost ($),Subtotal ($)",
                F.when(short, text(project, "id", service)).otherwise(
                    text(project, "id", service, "1.00", quoted))),
        "cur": ("identity/LineItemId,lineItem/UsageAccountId,lineItem/ProductCode,"
                "lineItem/UnblendedCost",
                F.when(short, text("id", project)).otherwise(text("id", project, service, quoted))),
        "ce": ("Service,2000-06-01,Total costs ($)",
               F.when(short, text(service)).when(number % 5 == 0, text(service, "2", "", quoted))
                .otherwise(text(service, "3", quoted))),
        "generic": ("service,cost,project",
                    F.when(short, text(service)).otherwise(text(service, quoted, project)))}
    every = F.explode(F.array(*[F.struct(F.lit(name).alias("source_path"), row.alias("line"))
                                for name, (_, row) in files.items()])).alias("row")
    body = (items.select(F.lit(1).alias("at"), every)
            .select("row.source_path", "at", "row.line"))
    heads = spark.createDataFrame([(name, 0, head) for name, (head, _) in files.items()],
                                  "source_path string, at int, line string")
    return heads.unionByName(body)


# Lines of a split of the file with breaks; its records are four lines long.
SPLIT_LINES = 1001


def broken_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a file whose cells hold line breaks, marks and commas inside quotes, one record for each
    line number of an order, cut into splits wherever they happen to fall."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    record = F.concat(F.lit('"'), "p_type", F.lit("\nline "), "l_linenumber", F.lit('","'),
                      F.format_number(F.col("cents") / 100, 2), F.lit('","unit ""'), "l_linenumber",
                      F.lit('""\n\n,x"'))
    number = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 4 + F.col("pos")
    lines = (table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber")
             .agg(F.min("l_partkey").alias("p_partkey"),
                  F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"))
             .join(parts, "p_partkey")
             .select("l_orderkey", "l_linenumber", F.posexplode(F.split(record, "\n")).alias("pos", "line"))
             .select(F.struct(F.floor(number / SPLIT_LINES).alias("split"), number.alias("number")).alias("at"),
                     "line"))
    head = spark.sql("SELECT struct(-1L AS split, -1L AS number) AS at, 'service,cost,project' AS line")
    return head.unionByName(lines).select(F.lit("orders.csv").alias("source_path"), "at", "line")


def cost_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the generic export, with some that are too large, too small or empty."""
    quantity = F.col("l_quantity")
    price = F.format_number("l_extendedprice", 2)
    cell = (F.when(quantity == 1, "n/a").when(quantity == 2, "nan").when(quantity == 3, F.lit(" \u00a0"))
            .when(quantity == 4, F.concat(F.lit("$"), price, F.lit("e14"))).when(quantity == 5, "1e-11")
            .when(quantity == 6, F.concat(F.lit("-"), price)).when(quantity == 7, F.lit(None)).otherwise(price))
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("project"), cell.alias("cell"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.lit("warehouse").alias("project"), F.col("source").alias("dataset"),
        F.col("doc_id").cast("string").alias("table"),
        (F.col("n_chars") * 10_000_000).alias("num_bytes"),
        (F.col("lang") == "en").alias("time_partitioned"),
        F.lit(False).alias("range_partitioned"))


def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_query = F.col("event_type").isin("view", "click")
    return table(spark, sf_dir, "events").select(
        F.lit("warehouse").alias("project"), F.col("user_id").cast("string").alias("user"),
        (F.round(F.col("value") * 100).cast("bigint") * 10_000_000).alias("bytes_billed"),
        F.col("ts").alias("created"),
        F.when(is_query, "QUERY").otherwise("LOAD").alias("job_type"),
        F.lit("SELECT").alias("statement_type"))


# Snapshots of the catalog, and the day on which retention is looked at.
SNAPSHOTS = [dt.date(2024, 1, 10), dt.date(2024, 2, 20), dt.date(2024, 4, 15)]
RETENTION_DAY = dt.date(2024, 3, 1)
# Bands of days, and what is to be done with tables that are in them.
BANDS = [(0, 7, "hot"), (7, 30, "warm"), (30, 90, "cold"), (90, 365, "archive"), (365, None, "delete")]


def dated_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog with a day on which each table was made, some of them after the last snapshot."""
    made = F.date_sub(F.lit(RETENTION_DAY), (F.col("doc_id") * 37 % 500 - 20).cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.lit("warehouse").alias("project"), F.col("source").alias("dataset"),
        F.col("doc_id").cast("string").alias("table"), (F.col("n_chars") * 1000).alias("num_bytes"),
        made.alias("created"))


def reading_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event reads two tables: that with the number of its user, which is often, and one that
    its own number gives; not all of them are in the catalog."""
    tables = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_doc"), "source")
    jobs = table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").alias("created"),
        F.explode(F.array("user_id", F.col("event_id") * 13 % 1201)).alias("_doc"))
    read = jobs.join(tables, "_doc", "left").select(
        "created", "event_id", F.struct(F.coalesce("source", F.lit("gone")).alias("dataset"),
                                        F.col("_doc").cast("string").alias("table")).alias("read"))
    return (read.groupBy("event_id", "created").agg(F.collect_set("read").alias("tables"))
            .select(F.lit("warehouse").alias("project"), "created", "tables"))


def query_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a query that costs its price, and touches a component for each of its lines' parts'
    types, by quantity; lines with discounts of a tenth have no weight. Returned lines are credits."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("component"))
    lines = spark.read.schema("l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, "
                              "l_extendedprice double, l_returnflag string").parquet(f"{sf_dir}/lineitem.parquet")
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    queries = lines.groupBy("l_orderkey", "l_returnflag").agg(cents.alias("cents")).withColumn(
        "cents", F.when(F.col("l_returnflag") == "R", -F.col("cents")).otherwise(F.col("cents")))
    weight = F.when(F.col("l_linenumber") == 7, 0).otherwise(F.col("l_quantity").cast("bigint"))
    return (lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
            .select("l_orderkey", "l_returnflag", "component", weight.alias("bytes"))
            .join(queries, ["l_orderkey", "l_returnflag"])
            .select(F.col("l_returnflag").alias("suite"), F.col("l_orderkey").alias("query"), "component", "bytes",
                    "cents"))


def model_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("doc_id").cast("string")
    folder = F.when(F.col("source") == "src0", "models/staging/").otherwise("models/marts/")
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("project"), F.concat(folder, name, F.lit(".sql")).alias("path"),
        name.alias("name"), F.col("text").alias("sql"))


# The pattern that stands in for SELECT *, which no sample text holds.
MODEL_PATTERN = "(?i)licen[sc]e"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
            .join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id",
                  "left"))


def model_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (_labelled(spark, sf_dir).filter(F.col("quality").isNotNull())
            .select(F.col("source").alias("project"), F.col("doc_id").cast("string").alias("name"),
                    F.lit(True).alias("has_description"),
                    (F.col("quality") == 1).alias("has_tests")))


def source_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select(
        F.col("source").alias("project"), F.col("lang").alias("source"),
        F.col("doc_id").cast("string").alias("table"),
        F.col("quality").isNotNull().alias("has_freshness"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source per project and language; those with a rated, good document are fresh."""
    return (_labelled(spark, sf_dir)
            .groupBy(F.col("source").alias("project"), F.col("lang").alias("source"))
            .agg((F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)) > 15).alias("has_freshness")))


def project_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "documents").select(F.col("source").alias("project")).distinct()
            .withColumn("has_marker", F.col("project") != "src7"))


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per document; Spanish ones are templates, some others failed."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return (table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
            .select(F.col("source").alias("suite"),
                    F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".sql"))
                     .alias("path"),
                    F.when(F.col("lang") == "es", F.concat(F.lit("{{ config() }} "), "text"))
                     .otherwise(F.col("text")).alias("sql"),
                    (F.col("n_chars") * 1_000_000_000).alias("bytes_processed"),
                    F.when(F.col("toxic") == 1, "syntax").alias("error")))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Platform = user; every event answers one of the 28 criteria, the last answer counts. A
    criterion that no event of the user falls on stays open."""
    ids = [criterion for _, _, criteria in DIMENSIONS for criterion in criteria]
    slot = (F.col("event_id") % len(ids)).cast("int") + 1
    return (table(spark, sf_dir, "events")
            .groupBy(F.col("user_id").cast("string").alias("platform"), slot.alias("slot"))
            .agg(F.max_by(F.floor("value") % 3, "event_id").cast("int").alias("score"))
            .select("platform", F.element_at(F.array(*[F.lit(i) for i in ids]), F.col("slot"))
                    .alias("criterion_id"), "score"))
