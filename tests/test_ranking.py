import random
import time

import pytest
from pyspark.sql import functions as F

from billweave.operators.ranking import in_ranges, numbered, ones, top_per_group


@pytest.mark.parametrize("ranges", [None, 1, 7, 90])
def test_numbering_is_exact_however_groups_are_split(spark, ranges):
    rng = random.Random(11)
    data = [("hot" if rng.random() < 0.5 else f"g{rng.randrange(30)}",
             rng.choice([0, 0, 0, rng.randrange(1000)]), i) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, v int, id int")
    info = df.groupBy("g").agg(F.count("*").alias("n_rows"), F.max("v").alias("top"))
    sums = {"line": F.lit(1), "evens": ones(F.col("v") % 2 == 0),
            "tops": ones(F.col("v") == F.col("top")), "total": F.col("v")}
    out = numbered(df, info, ["g"], ["v", "id"], sums, ranges)
    got = {(r.g, r.id): (r.line, r.evens, r.tops, r.total) for r in out.collect()}
    expected = {}
    for group in {g for g, _, _ in data}:
        members = sorted((v, i) for g, v, i in data if g == group)
        top = max(v for v, _ in members)
        evens = tops = total = 0
        for line, (v, i) in enumerate(members, 1):
            evens += v % 2 == 0
            tops += v == top
            total += v
            expected[group, i] = (line, evens, tops, total)
    assert got == expected


def test_hot_group_is_cut_into_even_ranges(spark):
    """The window of a hot group runs over many ranges, and none is large."""
    df = spark.range(200_000).select(F.when(F.col("id") % 100 == 0, "cold").otherwise("hot").alias("g"),
                                     (F.col("id") * 7919 % 200_000).alias("id"))
    info = df.groupBy("g").agg(F.count("*").alias("n_rows"))
    sizes = in_ranges(df, info, ["g"], ["id"], 100).groupBy("_slot").count().collect()
    assert len(sizes) >= 100 and max(r["count"] for r in sizes) <= 2 * 2000
    out = numbered(df.filter("g = 'hot'"), info, ["g"], ["id"], {"line": F.lit(1)}, 100)
    place = out.filter(F.col("line") != F.col("id") - F.floor((F.col("id") + 99) / 100) + 1)
    assert out.count() == 198_000 and "id" in place.columns
    ordered = [r.line for r in out.orderBy("id").select("line").collect()]
    assert ordered == list(range(1, 198_001))
    # The window is over ranges; nothing in the plan partitions rows by group alone.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in plan and plan.count("Window") == 1


def test_cost_grows_with_the_rows(spark):
    """Ranges of a few rows each: neither their number nor that of the rows squares the time."""
    def seconds(n, ranges):
        df = spark.range(n).select(F.lit("hot").alias("g"), (F.col("id") * 7919 % n).alias("id"))
        info = df.groupBy("g").agg(F.count("*").alias("n_rows"))
        start = time.perf_counter()
        out = numbered(df, info, ["g"], ["id"], {"line": F.lit(1)}, ranges)
        assert out.filter(F.col("line") != F.col("id") + 1).count() == 0
        return time.perf_counter() - start
    seconds(1000, 10)
    small, large = seconds(40_000, 50), seconds(320_000, 400)
    assert large < 16 * small


def test_top_per_group_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    top = top_per_group(df, ["g"], [F.desc("id")], 2)
    assert sorted(r.id for r in top.collect()) == [994, 995, 996, 997, 998, 999]
    plan = top._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("WindowGroupLimit") == 2
