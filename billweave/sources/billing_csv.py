"""Billing exports in CSV -> the billing fact.

The header decides the format. Spark would apply one file's header to all files of a read, so files
are read as lines in one distributed read: each file's first line is found by grouping, the few
different headers are looked at, and of every row the two or three cells that its file's layout needs
are taken by position. Files with line breaks inside quotes are found on the way, and only their
lines are put together into records.
"""

from __future__ import annotations

import csv
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from billweave.functions.money import BLANKS, is_total_label, parse_money, quick_strip, reject_reason, strip
from billweave.sources import csv_records

# More headers than this in one read are an error; a layout is shared by many files.
MAX_HEADERS = 1000

# Format names and the header cells that give them away.
GCP, CUR, CE, GENERIC = "gcp-cost-table", "aws-cur", "aws-ce", "generic"
GCP_SERVICE, GCP_COST, GCP_PROJECTS = "service description", "subtotal ($)", ("project name",
                                                                              "project id")
CUR_SERVICE, CUR_COST, CUR_PROJECT = ("lineitem/productcode", "lineitem/unblendedcost",
                                      "lineitem/usageaccountid")
GENERIC_HEADERS = (["service", "cost"], ["service", "cost", "project"])


class BillingFormatError(ValueError):
    """The CSV matches no known billing format."""


class Layout(NamedTuple):
    """Where the three fields are. cost None = the last numeric cell of each row."""
    format: str
    service: int
    cost: int | None
    project: int | None
    width: int


def _plain(header: list[str]) -> list[str]:
    return [(name or "").strip().lower() for name in header]


def detect_format(header: list[str]) -> str | None:
    names = _plain(header)
    known = {
        GCP: GCP_SERVICE in names,
        CUR: CUR_COST in names,
        GENERIC: names in GENERIC_HEADERS,
        CE: names[:1] == ["service"],
    }
    return next((name for name, matches in known.items() if matches), None)


def detect_layout(header: list[str], source: str = "header") -> Layout:
    names = _plain(header)

    def find(*wanted: str) -> int | None:
        return next((names.index(name) for name in wanted if name in names), None)

    def need(position: int | None, what: str) -> int:
        if position is None:
            raise BillingFormatError(f"{source}: no {what} column among {header}")
        return position

    kind, width = detect_format(header), len(header)
    if kind == GCP:
        first_cost = next((i for i, name in enumerate(names) if name.startswith("cost")), None)
        subtotal = find(GCP_COST)
        cost = need(first_cost if subtotal is None else subtotal, "cost")
        return Layout(kind, need(find(GCP_SERVICE), "service"), cost, find(*GCP_PROJECTS), width)
    if kind == CUR:
        return Layout(kind, need(find(CUR_SERVICE), "product code"), need(find(CUR_COST), "cost"),
                      find(CUR_PROJECT), width)
    if kind == GENERIC:
        return Layout(kind, 0, 1, 2 if width == 3 else None, width)
    if kind == CE:
        return Layout(kind, 0, None, None, width)
    raise BillingFormatError(
        f"{source}: unknown columns {header[:6]}. Known formats: {GCP} (a column 'Service "
        f"description'), {CUR} (a column 'lineItem/UnblendedCost'), {CE} (first column "
        f"'Service'), {GENERIC} (exactly service,cost[,project])")


def _kept(records: DataFrame) -> DataFrame:
    return records.filter(F.col("cost").isNotNull() & ~is_total_label(F.col("service")))


def _bound(rows: DataFrame, fields: dict[str, Column], *keep: str) -> DataFrame:
    """The fields as rows of their own: filters look at them instead of working them out again."""
    return rows.select(F.inline(F.array(F.struct(*[v.alias(k) for k, v in fields.items()]))), *keep)


def _last_number(cells: Column, decimal_mark: str) -> Column:
    numbers = F.filter(F.transform(cells, lambda cell: parse_money(cell, decimal_mark)),
                       lambda number: number.isNotNull())
    return F.try_element_at(numbers, F.lit(-1))


def normalize(raw: DataFrame, layout: Layout, keep: list[str] | None = None,
              decimal_mark: str = ".") -> DataFrame:
    """Raw STRING cells in export order (then the ``keep`` columns) -> service, project, cost.

    Total rows, rows without a service and rows without a readable cost are left out. Nothing but
    the three fields survives, and the scan reads only their columns.
    """
    keep = keep or []
    cells = raw.toDF(*[f"c{i}" for i in range(layout.width)], *keep)
    if layout.cost is None:
        numbers = F.array(*[F.col(f"c{i}") for i in range(1, layout.width)]).cast("array<string>")
        cost = _last_number(numbers, decimal_mark)
    else:
        cost = parse_money(F.col(f"c{layout.cost}"), decimal_mark)
    project = (F.lit("") if layout.project is None
               else F.coalesce(strip(F.col(f"c{layout.project}")), F.lit("")))
    fields = {"service": strip(F.col(f"c{layout.service}")), "project": project, "cost": cost,
              "source_format": F.lit(layout.format)}
    return _kept(_bound(cells, fields, *keep)).select("service", "project", "cost", *keep, "source_format")


def normalize_export(raw: DataFrame, decimal_mark: str = ".") -> DataFrame:
    """The same for a DataFrame whose column names are the export's header."""
    return normalize(raw, detect_layout(raw.columns), decimal_mark=decimal_mark)


def _header_cells(line: str) -> list[str]:
    return next(csv.reader([line.lstrip("\ufeff")]), [])


def _files(lines: DataFrame) -> DataFrame:
    """For each file its first line, where that is, whether a line ends inside quotes or none does, and
    whether the first does. With a set, Spark sums by hashes; with text and flags alone it would sort all
    lines by file first."""
    inside = F.array_max(F.collect_set("inside"))
    return (lines.withColumn("inside", csv_records.ends_inside(F.col("line"))).groupBy("source_path").agg(F.min_by("line", "at").alias("header"), F.min("at").alias("first"),
                                             inside.alias("broken"))
            .withColumns({"plain": ~F.col("broken"), "open": csv_records.ends_inside(F.col("header"))}))


def _firsts(lines: DataFrame) -> DataFrame:
    """For each file where its first line is. Numbers are summed by hashes, which structs are not."""
    number = F.min(F.coalesce("at.number", F.lit(-1 << 63).cast("bigint")))
    return (lines.filter(F.col("at").isNotNull()).groupBy("source_path", "at.split").agg(number.alias("number"))
            .groupBy("source_path").agg(F.min(F.struct("split", "number")).alias("first")))


def _found(files: DataFrame) -> tuple[list, bool]:
    """The files, if they are few, or else a row for each different header; and whether they are few."""
    found = files.limit(MAX_HEADERS + 1).collect()
    if len(found) <= MAX_HEADERS:
        return found, True
    found = (files.groupBy("header").agg(F.min("source_path").alias("source_path"),
                                         *[F.max(name).alias(name) for name in ("broken", "plain", "open")])
             .limit(MAX_HEADERS + 1).collect())
    if len(found) > MAX_HEADERS:
        raise BillingFormatError(f"more than {MAX_HEADERS} different headers")
    return found, False


def _of_files(lines: DataFrame, known: DataFrame, few: bool) -> DataFrame:
    """Lines with what is known of their files. What is known of few files goes to the lines, which stay where
    they are; with many, both are shuffled by a key that nothing else uses, so that adaptive execution can
    split a large file."""
    if few:
        return lines.join(F.broadcast(known), "source_path")
    key = F.struct("source_path").alias("_file")
    known = known.filter(F.col("source_path").isNotNull()).select(key, *[c for c in known.columns if c != "source_path"])
    return lines.select("*", key).join(known, "_file").drop("_file")


def _whole(lines: DataFrame, files: DataFrame, found: list, few: bool) -> DataFrame:
    """The records of the files with line breaks inside quotes."""
    if few and all(r.broken for r in found):
        return csv_records.whole_records(lines)
    if few:
        broken = lines.sparkSession.createDataFrame([(r.source_path,) for r in found if r.broken], "source_path string")
    else:
        broken = files.filter("broken").select("source_path")
    return csv_records.whole_records(_of_files(lines, broken, few).select("source_path", "at", "line"))


def _rows(lines: DataFrame) -> tuple[DataFrame, dict[Layout, int]]:
    """source_path, at, line and the number of the layout of all records after the headers, and the layouts."""
    spark, columns = lines.sparkSession, ("source_path", "at", "line")
    files = _files(lines)
    found, few = _found(files)
    broken, plain = (any(r[kind] for r in found) for kind in ("broken", "plain"))
    if any(r.open for r in found):  # a header that holds line breaks itself
        records = _whole(lines, files, found, few)
        if plain:
            kept = (spark.createDataFrame([(r.source_path,) for r in found if r.plain], "source_path string") if few
                    else files.filter("plain").select("source_path"))
            records = _of_files(lines, kept, few).select(*columns).unionByName(records)
        lines, broken, plain = records, False, True
        files = _files(lines)
        found, few = _found(files)
    layouts: dict[Layout, int] = {}
    numbers = {}  # of the layout of each header
    for r in found:
        layout = detect_layout(_header_cells(r.header), r.source_path)._replace(width=0)
        numbers[r.header] = layouts.setdefault(layout, len(layouts))
    if few:
        known = spark.createDataFrame([(r.source_path, bool(r.broken), r.first.split, numbers[r.header]) for r in found],
                                      "source_path string, broken boolean, split bigint, layout int")
    else:
        of = spark.createDataFrame([*numbers.items()], "header string, layout int")
        known = files.join(F.broadcast(of), "header").select("source_path", "broken", "first", "first.split", "layout")
    rows = []
    if plain or not broken:
        # Lines may be numbered otherwise when they are read again, so where a file begins is looked up again.
        of = known if not broken else known.filter(~F.col("broken"))
        if few:
            of = _firsts(lines).join(F.broadcast(of), "source_path")
        rows.append(_of_files(lines, of.select("source_path", "first", "layout"), few).filter(F.col("at") > F.col("first")))
    if broken:
        # Records are counted from 1.
        first = F.struct("split", F.lit(1).cast("bigint").alias("number")).alias("first")
        rows.append(_of_files(_whole(lines, files, found, few), known.filter("broken").select("source_path", first, "layout"), few)
                    .filter(F.col("at") > F.col("first")))
    every = rows[0].select(*columns, "layout")
    for more in rows[1:]:
        every = every.unionByName(more.select(*columns, "layout"))
    return every.filter(F.substring("line", 1, 1).between("!", "~") | (F.ltrim("line", F.lit(BLANKS)) != "")), layouts


def parse_cells(lines: DataFrame, decimal_mark: str = ".") -> DataFrame:
    """source_path, at (the order of a file's lines) and line -> service, project, cost, cell,
    source_format, source_path, at, of every row of every file.

    ``cell`` is the text that the cost was read from, NULL where it is the last number of the row.
    ``at`` is (split, number); anything else orders a file that is one split. One job looks at every file;
    what comes to the driver are headers, at most ``MAX_HEADERS`` of them. Only more files than that, and
    headers that hold line breaks themselves, take a second job of that kind. No file is dealt to one task.
    """
    if not isinstance(lines.schema["at"].dataType, StructType):
        lines = lines.withColumn("at", F.struct(F.lit(0).cast("bigint").alias("split"),
                                                F.col("at").cast("bigint").alias("number")))
    rows, layouts = _rows(lines)

    def of_layout(values: list, kind: str) -> Column:
        return F.get(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("layout"))

    line, flat, cells = F.col("line"), F.col("flat"), F.col("cells")
    places = {f"{name}_at": of_layout([getattr(layout, of) for layout in layouts], "int")
              for name, of in (("service", "service"), ("project", "project"), ("cell", "cost"))}
    # Few lines are not flat; only theirs are found by patterns, as far as they are needed.
    by_place, needed = F.col("cell_at").isNotNull(), 1 + max([0, *(n for layout in layouts for n in layout[1:4] if n is not None)])
    found = F.transform(csv_records.raw_cells(line, places["cell_at"].isNotNull(), needed), csv_records.unquoted)
    rows = rows.select("source_path", "at", "line", csv_records.flat(line).alias("flat"),
                       F.when(csv_records.flat(line).isNull(), found).alias("cells"),
                       of_layout([layout.format for layout in layouts], "string").alias("source_format"),
                       *[place.alias(name) for name, place in places.items()])

    def said(at: Column) -> Column:
        return (F.when(flat.isNotNull(), csv_records.flat_cell(flat, line, at))
                .otherwise(F.coalesce(F.get(cells, at), F.lit(""))))

    # Without a place, the cost is the last number. Mostly the last cell is one, and the others need not be looked at.
    last = (F.when(flat.isNull(), F.when(F.size(cells) > 1, F.try_element_at(cells, F.lit(-1))))
            .when(flat.contains(","), csv_records.last_flat_cell(flat, line)))
    rows = rows.select("source_path", "at", "line", "flat", "cells", "source_format", by_place.alias("by_place"),
                       said(F.col("service_at")).alias("service"), said(F.col("project_at")).alias("project"),
                       F.when(by_place, said(F.col("cell_at"))).otherwise(last).alias("text"))
    text, by_place = F.col("text"), F.col("by_place")
    every = F.coalesce(cells, csv_records.flat_cells(flat, line))
    others = _last_number(F.slice(every, 2, F.length(line) + 1), decimal_mark)
    cost = F.coalesce(parse_money(text, decimal_mark), F.when(~by_place, others))
    # Worked out before they are bound: a generator that holds a lambda is not compiled.
    fields = {"service": quick_strip(F.col("service")), "project": F.coalesce(quick_strip(F.col("project")), F.lit("")),
              "cost": cost, "cell": F.when(by_place, text), "source_format": F.col("source_format")}
    rows = rows.select(*[value.alias(name) for name, value in fields.items()], "source_path", "at")
    # Only what filters look at is bound; the others are left out where nobody wants them.
    rest = [name for name in rows.columns if name not in ("service", "cost")]
    return (_bound(rows, {name: F.col(name) for name in ("service", "cost")}, *rest)
            .select(*fields, "source_path", "at"))


def parse_lines(lines: DataFrame, decimal_mark: str = ".", observation: Observation | None = None) -> DataFrame:
    """source_path, at and line -> service, project, cost, source_format, source_path.

    Rows without a readable cost are left out, as are total rows; ``rejected_lines`` has the former.
    ``observation`` counts ``rows`` and ``rejected`` while the rows are read.
    """
    cells = parse_cells(lines, decimal_mark)
    if observation is not None:
        cells = cells.observe(observation, F.count(F.lit(1)).alias("rows"),
                              F.count_if(_is_rejected()).alias("rejected"))
    return _kept(cells).select("service", "project", "cost", "source_format", "source_path")


def _is_rejected() -> Column:
    return F.col("cost").isNull() & ~is_total_label(F.col("service"))


def rejected_lines(lines: DataFrame, decimal_mark: str = ".") -> DataFrame:
    """Rows of a service whose cost cannot be read: service, project, cell, reason, source_format,
    source_path and at, the place of the record in its file."""
    reason = reject_reason(F.col("cell"), decimal_mark)
    return parse_cells(lines, decimal_mark).filter(_is_rejected()).select(
        "service", "project", "cell", reason.alias("reason"), "source_format", "source_path", "at")


def read_lines(spark: SparkSession, paths: str | list[str], pattern: str = "*.csv") -> DataFrame:
    """source_path, at and line of all files; the files stay splittable."""
    paths = [paths] if isinstance(paths, str) else list(paths)

    def read(kind: str):
        return (spark.read.format(kind).option("recursiveFileLookup", True)
                .option("pathGlobFilter", pattern).load(paths))

    if not read("binaryFile").select("path").take(1):
        raise BillingFormatError(f"no file with content like {pattern} under {paths}")
    # Rows of one split keep their order; splits are told apart by where they start.
    return read("text").select(
        F.col("_metadata.file_path").alias("source_path"),
        F.struct(F.col("_metadata.file_block_start").alias("split"),
                 F.monotonically_increasing_id().alias("number")).alias("at"),
        F.col("value").alias("line"))


def read_billing(spark: SparkSession, paths: str | list[str], account: str | Column = "",
                 period: str | Column | None = None, decimal_mark: str = ".",
                 multi_line: bool | None = None, pattern: str = "*.csv",
                 observation: Observation | None = None) -> DataFrame:
    """Files and folders of exports, in any mix of formats -> one billing fact.

    ``account`` and ``period`` (a day of the month) are constants or columns over ``source_path``.
    The number of jobs does not depend on the number of files. Files without content are skipped by
    Spark; if there is no other, that is an error. Line breaks inside quotes are read in any case;
    ``multi_line`` is still accepted and changes nothing.
    """
    records = parse_lines(read_lines(spark, paths, pattern), decimal_mark, observation)
    month = F.lit(period) if period is None or isinstance(period, str) else period
    owner = F.lit(account) if isinstance(account, str) else account
    return records.select(owner.cast("string").alias("account"), month.cast("date").alias("period"),
                          "service", "project", "cost", "source_format", "source_path")


def read_rejected(spark: SparkSession, paths: str | list[str], decimal_mark: str = ".",
                  pattern: str = "*.csv") -> DataFrame:
    """The rows of the same files whose cost ``read_billing`` cannot read, with reason and place."""
    return rejected_lines(read_lines(spark, paths, pattern), decimal_mark)
