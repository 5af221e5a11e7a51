import csv
import io
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from billweave.plans import bindings
from billweave.sources import billing_csv
from billweave.sources import csv_records as c
from billweave.sources.billing_csv import parse_lines, read_billing

LINES = ["", "a", "a,b", '"', '""', '"""', '""""', '"a', 'a"', 'a,"b', '"a","b', '"a,b"', '"a""b', '"a""', '"a"x,"',
         'x","y', ',"', '",', '"",""', 'a "b', '"a" "b', ',,', '"x""y",z', '"x"",y', 'é"ü', '"é,"","ü"']


def ends(line, inside):
    """Whether a line ends inside quotes, character by character."""
    state = "quoted" if inside else "start"
    for x in line:
        if state == "quoted":
            state = "mark" if x == '"' else "quoted"
        elif state == "mark" and x == '"':
            state = "quoted"
        elif x == ",":
            state = "start"
        elif state == "start" and x == '"':
            state = "quoted"
        else:
            state = "plain"
    return state == "quoted"


def test_states_of_lines(spark):
    r = random.Random(4)
    lines = LINES + ["".join(r.choices('",a ', k=r.randrange(1, 12))) for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    for row in df.select("line", c.ends_inside(F.col("line")).alias("a"), c.stays_inside(F.col("line")).alias("b")).collect():
        assert (row.a, row.b) == (ends(row.line, False), ends(row.line, True)), row.line


def test_cells_like_the_csv_module(spark):
    r = random.Random(5)
    lines = [x for x in LINES if x] + ["".join(r.choices('",ab ', k=r.randrange(1, 14))) for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = df.select("line", F.transform(c.raw_cells(F.col("line")), c.unquoted).alias("cells"),
                    *[c.unquoted(c.raw_cell(F.col("line"), n)).alias(f"c{n}") for n in range(4)]).collect()
    for row in got:
        expected = next(csv.reader([row.line]))
        assert row.cells == expected, row.line
        assert [row[f"c{n}"] for n in range(4)] == (expected + [""] * 4)[:4], row.line


@pytest.mark.parametrize("line", ["," * 200_000, '"a""' * 30_000, "x" * 1_000_000, '"' + '""' * 100_000, '"a",' * 50_000])
def test_long_lines_neither_recurse_nor_backtrack(spark, line):
    df = spark.createDataFrame([(line,)], "line string")
    got = df.select(c.ends_inside(F.col("line")).alias("a"), c.stays_inside(F.col("line")).alias("b"),
                    c.unquoted(c.raw_cell(F.col("line"), 2)).alias("c")).first()
    assert (got.a, got.b) == (ends(line, False), ends(line, True)) and got.c is not None


def split_up(text, path, size, order):
    """The lines of a file, dealt into splits at every `size` lines, in any order."""
    lines = [(path, (n // size, n), line) for n, line in enumerate(text.split("\n"))]
    order.shuffle(lines)
    return lines


@pytest.mark.parametrize("size", [1, 2, 3, 7, 10_000])
def test_records_across_splits(spark, size):
    r = random.Random(size)
    out = io.StringIO()
    table = [["service", "cost", "project"]]
    for n in range(400):
        service = "".join(r.choices(["a", "b", "\n", '"', ",", "\n\n", " x"], k=r.randrange(1, 9)))
        table.append([f"s{n % 7}{service}", f"{n}.5", r.choice(["p", "q\nr", '"'])])
    csv.writer(out, lineterminator="\n").writerows(table)
    plain = "service,cost,project\n" + "".join(f"t{n},1,p\n" for n in range(50))
    lines = split_up(out.getvalue(), "broken", size, r) + split_up(plain, "plain", size, r)
    df = spark.createDataFrame(lines, "source_path string, at struct<split:bigint,number:bigint>, line string")
    records = c.whole_records(df.filter("source_path = 'broken'").repartition(5)).orderBy("at").collect()
    assert [next(csv.reader([x.line], strict=False)) if "\n" not in x.line else next(csv.reader(io.StringIO(x.line)))
            for x in records if x.line] == table
    parsed = parse_lines(df.repartition(3))
    expected = [(s.strip(), p.strip(), float(cost)) for s, cost, p in table[1:]] + [(f"t{n}", "p", 1.0) for n in range(50)]
    assert sorted((x.service, x.project, float(x.cost)) for x in parsed.collect()) == sorted(expected)


def test_a_file_of_many_splits_is_read_whole(spark, tmp_path):
    body = "".join(f'"Long\nname {n % 5}",{n},"p\n\nq"\n' for n in range(3000))
    (tmp_path / "one.csv").write_text("service,cost,project\n" + body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        df = read_billing(spark, str(tmp_path))
        assert rows(df.groupBy("service", "project").agg(F.count("*"), F.sum("cost").cast("int"))) == [
            (f"Long\nname {k}", "p\n\nq", 600, sum(range(k, 3000, 5))) for k in range(5)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("header, body", [("service,cost", 'a,1\n'), ("service,cost", '"a\nb",1\n'), ("Service,2026-03-01", "a,x,1,\n")])
def test_lines_of_one_file_stay_spread(spark, header, body):
    """No task takes all lines of a file, though Spark is not free to broadcast."""
    text = header + "\n" + body * 4000
    lines = split_up(text.rstrip("\n"), "f", 50, random.Random(1))
    df = spark.createDataFrame(lines, "source_path string, at struct<split:bigint,number:bigint>, line string").repartition(8)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        tasks = [r["count"] for r in parse_lines(df).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for key in conf:
            spark.conf.unset(key)
    assert sum(tasks) == 4000 and max(tasks) < 1500


@pytest.mark.parametrize("most", [1, 1000])
def test_many_files_and_few_give_the_same(spark, monkeypatch, most):
    monkeypatch.setattr(billing_csv, "MAX_HEADERS", most)
    head = "service,cost,project\n"
    texts = {"a": head + "A,1,p\nB,2,q", "b": head + '"C\nD",3,p\nE,n/d,q', "c": head + "F,4,r"}
    def lines(more):
        every = [x for name, text in (texts | more).items() for x in split_up(text, name, 2, random.Random(1))]
        return spark.createDataFrame(every, "source_path string, at struct<split:bigint,number:bigint>, line string").repartition(3)
    assert rows(parse_lines(lines({})).withColumn("cost", F.col("cost").cast("int")), "source_path", "service", "cost") == [
        ("a", "A", 1), ("a", "B", 2), ("b", "C\nD", 3), ("c", "F", 4)]
    # a header that holds a line break itself
    odd = lines({"d": 'Service,"2026\n03"\nG,5'})
    if most == 1:
        with pytest.raises(billing_csv.BillingFormatError, match="more than 1 different"):
            parse_lines(odd)
    else:
        assert rows(parse_lines(odd), "service") == [("A",), ("B",), ("C\nD",), ("F",), ("G",)]


def test_a_mark_that_is_never_closed(spark, monkeypatch):
    monkeypatch.setattr(c, "MAX_RECORD", 1000)
    text = "service,cost\nA,1\n\"B,2\n" + "x,1\n" * 100
    schema = "source_path string, at struct<split:bigint,number:bigint>, line string"
    r = random.Random(1)
    short = spark.createDataFrame(split_up(text, "f", 9, r), schema)
    assert rows(parse_lines(short), "service") == [("A",)]
    long = spark.createDataFrame(split_up(text + "y,1\n" * 1000, "f", 400, r), schema)
    with pytest.raises(Exception, match="more than 1000 characters in f"):
        parse_lines(long).collect()


def test_flat_lines_say_what_patterns_find(spark):
    """Cells of lines with one quoted cell or none are taken without patterns, and no line that is not flat is."""
    r = random.Random(6)
    lines = [x for x in LINES if x] + ["".join(r.choices('",ab ', weights=[2, 3, 2, 2, 1], k=r.randrange(1, 14))) for _ in range(3000)]
    line = F.col("line")
    df = (spark.createDataFrame([(x,) for x in [*lines, 'é,"ü,é",ß', 'é', '"a,\nb",c']], "line string")
          .withColumn("flat", c.flat(line)).filter("flat IS NOT NULL"))
    flat = F.col("flat")
    got = df.select("line", c.flat_cells(flat, line).alias("cells"), c.last_flat_cell(flat, line).alias("last"),
                    *[c.flat_cell(flat, line, F.lit(n)).alias(f"c{n}") for n in range(4)]).collect()
    assert {x.line for x in got} >= {"a,b", '"a,b"', 'é,"ü,é",ß', '"a,\nb",c'} and not {x.line for x in got} & {'"', '"a""b"', 'a"', '"a"x,"'}
    for row in got:
        expected = next(csv.reader(io.StringIO(row.line)))
        assert (row.cells, row.last) == (expected, expected[-1]), row.line
        assert [row[f"c{n}"] for n in range(4)] == (expected + [""] * 4)[:4], row.line
        assert not ends(row.line, False)


def test_files_are_looked_at_without_a_sort(spark):
    """Neither a file's header nor its first place may need all lines sorted, and parsing stays compiled."""
    lines = spark.createDataFrame(split_up("service,cost,project\n" + "A,1,p\n" * 50, "f", 7, random.Random(1)),
                                  "source_path string, at struct<split:bigint,number:bigint>, line string")
    assert "Sort" not in billing_csv._files(lines)._jdf.queryExecution().sparkPlan().toString()
    for df in (billing_csv._firsts(lines), parse_lines(lines)):  # what is sorted has a row for each split
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert [x for x in plan.split("\n") if "Aggregate" in x][-1].strip(" +-:").startswith("HashAggregate")
    ce = spark.createDataFrame(split_up("Service,2026-03-01\n" + "A,1\n" * 50, "f", 7, random.Random(1)), lines.schema)
    plan = parse_lines(ce)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("\n") if "Generate inline" in x and "lambda" in x]


def test_rows_without_a_place_for_the_cost(spark):
    """The last number counts, whether lines are flat or not, and a line without a second cell has none."""
    body = ['A,1,2', 'B,"1,000",', 'C,"a ""b""",7,x', '"D,d",5', 'E', 'F,x', '"G ""g""","3","4",""', '8', 'H,"9"', 'I,"a""",']
    lines = spark.createDataFrame(split_up("\n".join(["Service,2026-03-01", *body]), "f", 3, random.Random(2)),
                                  "source_path string, at struct<split:bigint,number:bigint>, line string")
    got = {(x.service, x.cost if x.cost is None else float(x.cost), x.cell) for x in billing_csv.parse_cells(lines).collect()}
    assert got == {("A", 2, None), ("B", 1000, None), ("C", 7, None), ("D,d", 5, None), ("E", None, None), ("F", None, None),
                   ('G "g"', 4, None), ("8", None, None), ("H", 9, None), ("I", None, None)}


@pytest.mark.parametrize("order, alike", [(1, False), (None, False), (1, True)])
def test_lines_of_one_order_are_dealt_out(spark, tmp_path, order, alike):
    """Rows of a single order, of none or all alike do not end up with one task."""
    spark.createDataFrame([(n, f"TYPE {n}") for n in range(20)], "p_partkey bigint, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    items = [(order, 3 if alike else n % 20, 1, 10.0, 5.0 if alike else n / 4, "A") for n in range(6000)]
    (spark.createDataFrame(items, "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, "
                                  "l_extendedprice double, l_returnflag string")
     .repartition(12).write.parquet(f"{tmp_path}/lineitem.parquet"))
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.maxPartitionBytes": "8k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k" if alike else "64m"}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        lines = bindings.csv_lines(spark, str(tmp_path)).filter("at = 1")
        written = [r["count"] for r in lines.groupBy(F.input_file_name()).count().collect()]
    finally:
        for key in conf:
            spark.conf.unset(key)
    assert sum(written) == 4 * 6000 and max(written) <= 8000
