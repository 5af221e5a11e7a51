import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from billweave.operators import apportion as ap
from billweave.operators import rewrite, usage


def day(n):
    return dt.date(2025, 1, 1) + dt.timedelta(n)


def tables(spark, *names, created=0):
    return spark.createDataFrame([("p", "d", n, 10, day(created)) for n in names],
                                 "project string, dataset string, table string, num_bytes bigint, created date")


def jobs(spark, *reads):
    """(day, tables read)"""
    return spark.createDataFrame(
        [("p", dt.datetime(2025, 1, 1) + dt.timedelta(n, hours=5), [("d", t) for t in names]) for n, names in reads],
        "project string, created timestamp, tables array<struct<dataset:string,table:string>>")


def test_never_read_is_not_read_long_ago(spark):
    read = jobs(spark, (0, ["a", "b"]), (10, ["a", "gone"]), (100, ["b"]), (50, []))
    got = usage.table_idleness(tables(spark, "a", "b", "c"), read, [day(0), day(40), day(99), day(100)])
    state = {(r.table, (r.snapshot - day(0)).days): (r.idle_days, r.state) for r in got.collect()}
    assert state == {
        ("a", 0): (0, "used"), ("a", 40): (30, "idle"), ("a", 99): (89, "idle"), ("a", 100): (90, "zombie"),
        ("b", 0): (0, "used"), ("b", 40): (40, "idle"), ("b", 99): (99, "zombie"), ("b", 100): (0, "used"),
        ("c", 0): (None, "never"), ("c", 40): (None, "never"), ("c", 99): (None, "never"), ("c", 100): (None, "never")}
    assert usage.table_idleness(tables(spark), read, [day(1)]).count() == 0
    assert {r.state for r in usage.table_idleness(tables(spark, "a"), jobs(spark), [day(1)]).collect()} == {"never"}


def test_a_table_that_every_job_reads_is_one_read_a_day(spark):
    read = spark.range(50_000).select(
        F.lit("p").alias("project"), F.lit(dt.datetime(2025, 1, 3)).alias("created"),
        F.array(F.struct(F.lit("d").alias("dataset"), F.lit("hot").alias("table"))).alias("tables"))
    assert rows(usage.table_reads(read)) == [("p", "d", "hot", day(2))]


@pytest.mark.parametrize("days", [range(-3, 130), [40_000, 36_525, None]])
def test_bands_like_a_condition_for_each(spark, days):
    bands = [(0, 7, "hot"), (7, 30, "warm"), (31, 90, "cold"), (90, None, "old")]
    df = spark.createDataFrame([(n, "x") for n in days], "n int, action0 string")
    got = usage.in_bands(df, spark.createDataFrame(bands, "lower int, upper int, action string"), F.col("n"), "action")
    assert got.columns == ["n", "action0", "action"]
    assert {r.n: r.action for r in got.collect()} == {
        n: next((a for low, up, a in bands if n is not None and low <= n and (up is None or n < up)), None) for n in days}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_retention_counts_tables_by_age_and_idleness(spark):
    catalog = tables(spark, "a", "b", created=0).unionByName(tables(spark, "n", created=95))
    bands = spark.createDataFrame([(0, 30, "hot"), (30, None, "cold")], "lower int, upper int, action string")
    got = usage.retention(catalog, jobs(spark, (90, ["a"])), bands, day(100))
    assert rows(got, "age_action", "action", "n_tables", "num_bytes", "n_never_read") == [
        ("cold", "cold", 1, 10, 1), ("cold", "hot", 1, 10, 0), ("hot", "hot", 1, 10, 1)]


def fair(cents, weights):
    """Parts by largest remainder, ties by name."""
    if not sum(weights.values()):
        weights = dict.fromkeys(weights, 1)
    total, size = sum(weights.values()), abs(cents)
    parts = {k: size * w // total for k, w in weights.items()}
    order = sorted(weights, key=lambda k: (-(size * weights[k] % total), k))
    for k in order[:size - sum(parts.values())]:
        parts[k] += 1
    return {k: v if cents >= 0 else -v for k, v in parts.items()}


@pytest.mark.parametrize("many", [0, 50, 100_000])
def test_large_queries_and_small_ones_get_the_same(spark, monkeypatch, many):
    monkeypatch.setattr(ap, "MANY", many)
    data = {("s", q): (q * 37 - 400, {f"c{k}": k % 4 for k in range(1 + q % 9)}) for q in range(40)}
    data["hot", None] = (777, {f"c{k:03}": k % 5 for k in range(300)})
    df = spark.createDataFrame([(*q, c, w, cents) for q, (cents, weights) in data.items() for c, w in weights.items()],
                               "suite string, query int, component string, bytes bigint, cents bigint")
    got = {}
    for row in ap.apportion(df, ["suite", "query"], ranges=3).collect():
        got.setdefault((row.suite, row.query), {})[row.component] = row.cents
    assert got == {q: fair(*v) for q, v in data.items()}


def test_parts_are_shuffled_once_after_they_are_written(spark):
    df = spark.createDataFrame([("q", "a", 1, 5)], "query string, component string, bytes bigint, cents bigint")
    plan = ap.apportion(df, ["query"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


@pytest.mark.parametrize("ranges", [None, 5])
def test_parts_add_up_to_the_cent(spark, ranges):
    import random
    r = random.Random(2)
    data = {("s", q): (r.choice([0, 1, 7, 100, -250, 10**15 + 1]),
                       {f"c{k}": r.choice([0, 1, 1, 3, 10**12]) for k in range(r.randrange(1, 12))}) for q in range(60)}
    data["hot", 1] = (999, {f"c{k:04}": 1 + k % 3 for k in range(2000)})
    df = spark.createDataFrame([(*q, c, w, cents) for q, (cents, weights) in data.items() for c, w in weights.items()],
                               "suite string, query int, component string, bytes bigint, cents bigint")
    got = {}
    for row in ap.apportion(df, ["suite", "query"], ranges=ranges).collect():
        got.setdefault((row.suite, row.query), {})[row.component] = row.cents
    assert got == {q: fair(*v) for q, v in data.items()}
    assert all(sum(parts.values()) == data[q][0] for q, parts in got.items())


def test_odd_parts(spark):
    df = spark.createDataFrame([("q", "a", None, 5), ("q", "a", 3, 5), ("q", "b", -4, 5), ("r", "x", 1, None)],
                               "query string, component string, bytes bigint, cents bigint")
    assert rows(ap.apportion(df, ["query"])) == [("q", "a", 3, 5), ("q", "b", 0, 0), ("r", "x", 1, 0)]
    assert ap.apportion(df.limit(0), ["query"]).count() == 0
    assert rows(ap.component_costs(df, ["query"], [])) == [("a", 1, 3, 5), ("b", 1, 0, 0), ("x", 1, 1, 0)]


def test_a_lost_day_is_found(spark, tmp_path):
    table = spark.range(3000).select("id", F.timestamp_add("HOUR", F.col("id").cast("int"), F.lit(dt.datetime(2025, 1, 1))).alias("at"),
                                     F.when(F.col("id") % 3 > 0, "x").alias("note"))
    table = table.unionByName(spark.sql("SELECT -1L id, CAST(NULL AS timestamp) at, 'late' note"))
    path = str(tmp_path / "by_day")
    rewrite.rewrite_by_day(table, path, "at", cluster=["id"])
    back = spark.read.parquet(path)
    whole = rewrite.reconcile(table, back, "at").collect()
    assert len(whole) == 126 and {r.state for r in whole} == {"equal"}
    assert {r.rows_after for r in whole if r.day is None} == {1}
    # one day rewritten leaves the others as they were
    one = table.filter(F.col("at").cast("date") == F.lit(day(5))).withColumn("note", F.lit("new"))
    rewrite.rewrite_by_day(one, path, "at")
    changed = spark.read.parquet(path).filter("day <> '2025-01-09' OR day IS NULL")
    extra = changed.select(*table.columns).unionByName(spark.sql("SELECT 9L id, timestamp'2026-01-01' at, 'x' note"))
    states = {r.day: (r.rows_before, r.rows_after, r.state) for r in rewrite.reconcile(table, extra, "at").collect()}
    assert {d: s for d, s in states.items() if s[2] != "equal"} == {
        day(5): (24, 24, "differs"), day(8): (24, 0, "lost"), dt.date(2026, 1, 1): (0, 1, "added")}
    with pytest.raises(ValueError, match="note"):
        rewrite.reconcile(table, back.drop("note"), "at")


def test_checksums_see_nulls_and_repeated_rows(spark):
    schema = "at date, a string, b string"
    one = spark.createDataFrame([(day(0), "x", None), (day(0), "x", None), (day(1), "y", "z")], schema)
    for other in ([(day(0), None, "x"), (day(0), "x", None), (day(1), "y", "z")], [(day(0), "x", None), (day(1), "y", "z")]):
        bad = rewrite.reconcile(one, spark.createDataFrame(other, schema), "at").filter("state <> 'equal'")
        assert [r.day for r in bad.collect()] == [day(0)]
    assert rewrite.reconcile(one, one.repartition(3).select("b", "a", "at"), "at").filter("state <> 'equal'").count() == 0
