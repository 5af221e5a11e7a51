import pytest
from conftest import JULY, JUNE, gcp_csv, rows
from pyspark.sql import Observation
from pyspark.sql import functions as F

from billweave.functions.money import parse_money, strip
from billweave.sources.billing_csv import (BillingFormatError, detect_format, detect_layout,
                                           normalize_export, parse_lines, read_billing, read_rejected)

USAGE = [("900011", "SearchIndex", "310.25"), ("900011", "SearchIndex", "89.75"),
         ("900022", "QueueHub", "12.00"), ("900022", "QueueHub", "n/d"), ("900033", "CacheNode", "7.5")]
CUR = ("identity/LineItemId,lineItem/UsageAccountId,lineItem/ProductCode,lineItem/UnblendedCost\n"
       + "".join(f"row{i},{a},{p},{c}\n" for i, (a, p, c) in enumerate(USAGE)))
CE = ("Service,2026-03-01,2026-04-01,Total costs ($)\nRender farm,4,6,10\nArchive,1.25,,\n"
      "Total costs ($),5.25,6,10\n")
GENERIC = "service,cost,project\nFonts,12.5,web\nFonts,2,print\nIcons,0.5,web\n"


def write(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text, encoding="utf-8")
    return str(folder)


def by(df, column):
    return {key: float(cost) for key, cost in rows(df.groupBy(column).agg(F.sum("cost")))}


def test_formats_are_told_apart_by_header():
    assert detect_format(["SERVICE DESCRIPTION", "Cost ($)"]) == "gcp-cost-table"
    assert detect_format(["x", "lineItem/UnblendedCost"]) == "aws-cur"
    assert detect_format([" service", "cost", "Project "]) == "generic"
    assert detect_format(["service", "cost"]) == "generic"
    assert detect_format(["Service", "2026-03-01"]) == "aws-ce"
    assert detect_format(["color", "size"]) is None
    assert detect_format([]) is None


def test_gcp_takes_subtotals_and_leaves_total_rows(bills):
    for bill, given in zip(bills, (JUNE, JULY)):
        expected = {}
        for _, service, cents in given:
            expected[service] = expected.get(service, 0) + cents / 100
        assert by(bill, "service") == expected
        assert {r.source_format for r in bill.collect()} == {"gcp-cost-table"}


def test_gcp_without_subtotal_takes_first_cost_column():
    layout = detect_layout(["Service description", "Project ID", "Cost ($)", "Cost type"])
    assert (layout.cost, layout.project) == (2, 1)
    with pytest.raises(BillingFormatError, match="no cost column"):
        detect_layout(["Service description", "Amount"])


def test_cur_needs_a_product_code():
    with pytest.raises(BillingFormatError, match="product code"):
        detect_layout(["lineItem/UnblendedCost", "lineItem/UsageAccountId"])


def test_mixed_folder_is_read_by_layout(spark, tmp_path):
    folder = write(tmp_path, a=CUR, b=CE, c=GENERIC, d=gcp_csv(JUNE), e=gcp_csv(JULY, "﻿"))
    every = read_billing(spark, folder)
    readable = [float(c) for *_, c in USAGE if c != "n/d"]
    assert by(every, "source_format") == {
        "aws-cur": sum(readable), "aws-ce": 11.25, "generic": 15,
        "gcp-cost-table": sum(c for *_, c in JUNE + JULY) / 100}
    parts = {f: every.filter(F.col("source_format") == f) for f in ("aws-cur", "aws-ce", "generic")}
    assert by(parts["aws-cur"], "service") == {"SearchIndex": 400, "QueueHub": 12, "CacheNode": 7.5}
    assert by(parts["aws-cur"], "project")["900011"] == 400
    assert by(parts["generic"], "project") == {"web": 13, "print": 2}
    # Empty last cells: the last number of the row counts.
    assert by(parts["aws-ce"], "service") == {"Render farm": 10, "Archive": 1.25}
    assert by(parts["aws-ce"], "project") == {"": 11.25}


def test_jobs_do_not_depend_on_the_number_of_files(spark, tmp_path):
    tracker = spark.sparkContext.statusTracker()

    def jobs(n):
        folder = tmp_path / str(n)
        folder.mkdir()
        write(folder, **{f"f{i}": GENERIC for i in range(n)})
        group = f"files-{n}"
        spark.sparkContext.setJobGroup(group, group)
        assert read_billing(spark, str(folder)).count() == 3 * n
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(group))
    assert jobs(2) == jobs(25)


def test_account_and_period_can_come_from_the_path(spark, tmp_path):
    for account, month in (("x", "2026-01"), ("y", "2026-02")):
        folder = tmp_path / account / month
        folder.mkdir(parents=True)
        write(folder, bill=GENERIC)
    path = F.col("source_path")
    df = read_billing(spark, str(tmp_path),
                      account=F.regexp_extract(path, "/([^/]+)/[^/]+/[^/]+$", 1),
                      period=F.concat(F.regexp_extract(path, "/([^/]+)/[^/]+$", 1), F.lit("-01")))
    assert {(r.account, str(r.period)) for r in df.collect()} == {("x", "2026-01-01"),
                                                                  ("y", "2026-02-01")}


def test_unknown_and_empty_files_are_errors(spark, tmp_path):
    with pytest.raises(BillingFormatError, match="gcp-cost-table.*generic"):
        read_billing(spark, write(tmp_path, bad="color,size\nred,4\n"))
    empty = tmp_path / "empty"
    empty.mkdir()
    with pytest.raises(BillingFormatError, match="no file with content"):
        read_billing(spark, write(empty, none=""))
    nothing = tmp_path / "nothing"
    nothing.mkdir()
    with pytest.raises(BillingFormatError, match="no file"):
        read_billing(spark, str(nothing))


def test_ragged_rows_credits_and_odd_cells(spark, tmp_path):
    text = ("service,cost,project\n"
            "A,\"$1,000.50\",p\n"       # symbol and thousands mark
            "B,-20,p\n"                 # credit
            "C\n"                       # too short
            "D,5\n"                     # no project cell
            "E,nan,p\nF,inf,p\nG,1_000,p\nH,,p\n"   # unreadable
            " I , 7 , q \n"             # blanks around
            " K , 4 ,r \n"     # blanks of other kinds
            "J,3,p,surplus\n"
            ",9,p\nTOTAL,99,p\n\n")
    df = read_billing(spark, write(tmp_path, odd=text))
    assert {(s, p, float(c)) for s, p, c in rows(df, "service", "project", "cost")} == {
        ("A", "p", 1000.5), ("B", "p", -20), ("D", "", 5), ("I", "q", 7), ("J", "p", 3), ("K", "r", 4)}


def test_last_number_may_stand_beyond_the_header(spark, tmp_path):
    df = read_billing(spark, write(tmp_path, ce="Service,2026-03-01\nA,1,2\nB,1,x,\nC\n"))
    assert by(df, "service") == {"A": 2, "B": 1}


def test_numbers_out_of_range_are_rejected_by_name(spark, tmp_path):
    folder = write(tmp_path, big="service,cost\nA,123456789012345678\nB,1.2e-11\nC,n/d\nD\nTotal,x\nE,2\n")
    seen = Observation("cells")
    df = read_billing(spark, folder, observation=seen)
    assert by(df, "service") == {"B": 0, "E": 2}
    assert seen.get == {"rows": 6, "rejected": 3}
    bad = read_rejected(spark, folder)
    assert rows(bad, "service", "cell", "reason") == [
        ("A", "123456789012345678", "out of range"), ("C", "n/d", "not a number"), ("D", "", "missing")]
    assert {r.source_path.rsplit("/", 1)[1] for r in bad.collect()} == {"big.csv"}


def test_repeated_header_names_are_read_by_position(spark, tmp_path):
    text = "Service description,Cost ($),cost ($),Project ID\nA,1,2,p\n"
    df = read_billing(spark, write(tmp_path, twice=text))
    assert [(s, p, float(c)) for s, p, c in rows(df, "service", "project", "cost")] == [
        ("A", "p", 1)]


def test_quoted_line_breaks_with_multi_line(spark, tmp_path):
    df = read_billing(spark, write(tmp_path, broken='service,cost,project\n"A\nB",1,p\n', other=CE),
                      multi_line=True)
    assert rows(df, "service") == [("A\nB",), ("Archive",), ("Render farm",)]


def test_lines_of_one_large_file_and_of_none(spark):
    body = [("f", i, f"s{i % 3},{i},p") for i in range(1, 2001)]
    lines = spark.createDataFrame([("f", 0, "service,cost,project"), *body],
                                  "source_path string, at int, line string").repartition(8)
    assert by(parse_lines(lines), "service") == {
        f"s{k}": sum(i for i in range(1, 2001) if i % 3 == k) for k in range(3)}
    assert parse_lines(lines.limit(0)).count() == 0


def test_parse_money(spark):
    cells = {"12,450.5": 12450.5, "$ 3": 3, "-0.5": -0.5, "": None, "x": None, "1e3": 1000,
             "NaN": None, "(5)": None, "\t8 ": 8, " 9 ": 9, "0.0": 0, "5d": None}
    df = spark.createDataFrame([(c,) for c in cells], "cell string")
    got = {r.cell: r.cost for r in df.select("cell", parse_money(F.col("cell")).alias("cost"))
           .collect()}
    assert {c: None if v is None else float(v) for c, v in got.items()} == cells
    comma = df.select(parse_money(F.lit("1.234,56"), ",").alias("v")).first().v
    assert float(comma) == 1234.56
    # With a point as the mark, a comma always separates thousands.
    assert float(df.select(parse_money(F.lit("1.234,56")).alias("v")).first().v) == 1.23456
    assert df.select(strip(F.lit("  a b \n")).alias("v")).first().v == "a b"


def test_normalize_a_dataframe_with_export_names(spark):
    raw = spark.createDataFrame([("Fonts", "1.5"), ("Total", "9")], ["Service", "2026-03-01"])
    assert [(s, float(c)) for s, c in rows(normalize_export(raw), "service", "cost")] == [
        ("Fonts", 1.5)]
