import datetime as dt
import random
from collections import defaultdict
from decimal import Decimal

import pytest
from conftest import JULY, JUNE, rows
from pyspark.sql import functions as F

from billweave.operators import diff
from billweave.operators.bill_rules import bill_findings
from billweave.schema import BILLING_FACT


@pytest.fixture(scope="module")
def lines(bills):
    return diff.diff_two(*bills, ranked=True).cache()


def _sums(bill, column):
    out = defaultdict(int)
    for row in bill:
        out[row[column]] += row[2]
    return dict(out)


def test_totals_of_two_bills(bills):
    total = diff.diff_two_totals(*bills).first()
    old, new = (sum(cents for *_, cents in bill) for bill in (JUNE, JULY))
    assert (float(total.total_before), float(total.total_after)) == (old / 100, new / 100)
    assert total.growth_pct == round((new - old) / old * 100, 2) == 29.54
    assert str(total.period) == "2026-07-01"


def test_lines_of_two_bills(lines):
    moved = sum(c for *_, c in JULY) - sum(c for *_, c in JUNE)
    for grain, column in (("service", 1), ("project", 0)):
        old, new = _sums(JUNE, column), _sums(JULY, column)
        keys = {*old, *new}
        expected = sorted(((key, new.get(key, 0) - old.get(key, 0), key not in old, key not in new)
                           for key in keys), key=lambda x: (-abs(x[1]), x[0]))
        found = lines.filter(F.col("grain") == grain).orderBy("rank").collect()
        assert [(r.key, round(float(r.delta) * 100), r.is_new, r.is_gone) for r in found] == expected
        assert [r.share_pct for r in found] == [round(d / moved * 100, 2) for _, d, *_ in expected]


def test_drivers_and_coverage_of_two_bills(lines):
    assert rows(diff.drivers(lines), "position", "key") == [(1, "Map Tiles"), (2, "Stream Hub")]
    assert rows(diff.counter_movers(lines), "key") == [("Batch Runner",), ("Mail Relay",),
                                                       ("Object Vault",)]
    assert diff.top_project(lines).first().key == "lago"
    assert diff.driver_coverage(lines).first().coverage_pct == 144.66


def test_findings_of_two_bills(lines):
    found = {r.code: r for r in bill_findings(lines).collect()}
    assert {c: r.severity for c, r in found.items()} == {
        "BILL-01": "high", "BILL-02": "medium", "BILL-03": "medium"}
    assert found["BILL-01"].title == "La cuenta subió 30% entre periodos ($5.500 → $7.124)"
    assert found["BILL-01"].evidence == "driver principal: Map Tiles +$1.400"
    assert found["BILL-02"].title == "Servicio nuevo: Stream Hub aporta 58% del aumento (+$950)"
    assert found["BILL-03"].title == "Un solo proyecto (lago) concentra 65% del aumento"
    assert {r.dimension for r in found.values()} == {"cost"}


def test_dates_within_a_month_are_that_month(spark):
    """Bills dated in the middle of the month compare like those dated at its start."""
    data = [("a", dt.date(2026, 1, 15), "s", "p", 1), ("a", dt.date(2026, 1, 31), "s", "p", 2),
            ("a", dt.date(2026, 2, 14), "s", "p", 5)]
    fact = spark.createDataFrame([(*x[:4], Decimal(x[4])) for x in data], BILLING_FACT)
    line = diff.delta_lines(fact).filter("grain = 'service'").first()
    assert (str(line.period), float(line.before), float(line.after), line.is_new) == (
        "2026-02-01", 3, 5, False)
    assert {str(r.period) for r in diff.total_cost(fact).collect()} == {"2026-01-01", "2026-02-01"}


def test_rows_without_a_period_are_an_error(spark):
    fact = spark.createDataFrame([("a", None, "s", "p", Decimal(1))], BILLING_FACT)
    with pytest.raises(Exception, match="no period"):
        diff.delta_lines(fact).collect()
    # Two given snapshots need none.
    assert diff.diff_two(fact, fact, period=dt.date(2026, 1, 1)).count() == 2


def test_swapping_sides_negates_everything(bills, lines):
    before, after = bills
    swapped = diff.diff_two(after, before)
    assert rows(swapped.selectExpr("grain", "key", "-delta", "share_pct", "is_gone", "is_new")) \
        == rows(lines, "grain", "key", "delta", "share_pct", "is_new", "is_gone")


def test_equal_snapshots_give_no_findings(bills):
    before, _ = bills
    lines = diff.diff_two(before, before)
    assert bill_findings(lines).count() == 0
    assert {(float(r.delta), r.share_pct, r.side) for r in lines.collect()} == {(0.0, 0.0, 0)}


def test_no_base(bills, fact):
    before, after = bills
    lines = diff.diff_two(before.limit(0), after)
    assert {r.growth_pct for r in lines.collect()} == {None}
    assert all(r.is_new for r in lines.collect())
    # No growth to judge, but new services count; no project has enough of the bill.
    assert {r.code for r in bill_findings(lines).collect()} == {"BILL-02"}


def test_period_of_two_snapshots(fact):
    before, after = fact(("a", 1, "s", "p", 1), ("b", 1, "s", "p", 1)), fact(("a", 3, "s", "p", 1))
    totals = diff.diff_two_totals(before, after)
    assert [(a, p.month) for a, p in rows(totals, "account", "period")] == [("a", 3), ("b", 1)]
    given = diff.diff_two(before, after, period=dt.date(2026, 4, 1))
    assert {r.period.month for r in given.collect()} == {4}


def test_negative_base_has_no_growth(fact):
    total = diff.pair_totals(fact(("a", 1, "s", "p", -5), ("a", 2, "s", "p", 10))).first()
    assert (total.growth_pct, float(total.total_delta)) == (None, 15)


def test_new_means_absent_not_free(fact):
    lines = diff.delta_lines(fact(("a", 1, "free", "p", 0), ("a", 1, "s", "p", 1),
                                  ("a", 2, "free", "p", 5), ("a", 2, "s", "p", 0)))
    flags = {r.key: (r.is_new, r.is_gone) for r in lines.collect()}
    assert flags == {"free": (False, False), "s": (False, False), "p": (False, False)}


def test_months_without_a_bill(fact):
    """A gap gives an all-gone pair and then a pair without a base; nothing after the last."""
    df = fact(("a", 1, "s", "p", 10), ("a", 3, "s", "p", 30), ("b", 2, "s", "p", 1))
    totals = rows(diff.pair_totals(df), "account", "period", "total_before", "total_after",
                  "growth_pct")
    assert [(a, str(p), float(x), float(y), g) for a, p, x, y, g in totals] == [
        ("a", "2026-02-01", 10, 0, -100.0), ("a", "2026-03-01", 0, 30, None)]
    lines = {(str(r.period), r.grain): (r.is_new, r.is_gone)
             for r in diff.delta_lines(df).collect()}
    assert lines[("2026-02-01", "service")] == (False, True)
    assert lines[("2026-03-01", "project")] == (True, False)


def test_empty_project_counts_in_the_total_only(fact):
    lines = diff.delta_lines(fact(("a", 1, "s", "", 1), ("a", 2, "s", "", 4),
                                  ("a", 2, "s", "p", 1)))
    assert rows(lines, "grain", "key", "share_pct") == [("project", "p", 25.0),
                                                        ("service", "s", 100.0)]


def test_ties_are_ordered_by_name(fact):
    lines = diff.delta_lines(fact(*[("a", 1, s, "p", 1) for s in "cab"],
                                  *[("a", 2, s, "p", 2) for s in "cab"]), ranked=True)
    services = lines.filter("grain = 'service'").orderBy("rank").collect()
    assert [r.key for r in services] == ["a", "b", "c"]
    assert rows(diff.drivers(lines, 2), "key") == [("a",), ("b",)]


def test_one_pass_grains(fact):
    df = fact(("a", 1, "s", "p", 1), ("a", 1, "s", "", 2), ("a", 1, "t", "p", 4))
    assert [(g, k, float(c)) for g, k, c in rows(diff.cost_by_grain(df), "grain", "key", "cost")] \
        == [("project", "p", 5), ("service", "s", 3), ("service", "t", 4), ("total", "", 7)]


def _brute_force(data):
    cost = defaultdict(int)
    for account, month, service, project, cents in data:
        for grain, key in (("service", service), ("project", project), ("total", "")):
            if grain != "project" or key:
                cost[account, month, grain, key] += cents
    months = defaultdict(set)
    for account, month, *_ in cost:
        months[account].add(month)
    expected = {}
    for account, billed in months.items():
        for month in range(min(billed) + 1, max(billed) + 1):
            keys = {(g, k) for a, m, g, k in cost
                    if a == account and m in (month - 1, month) and g != "total"}
            moves = {}
            for grain, key in keys:
                old = cost.get((account, month - 1, grain, key))
                new = cost.get((account, month, grain, key))
                moves[grain, key] = ((new or 0) - (old or 0), old is None, new is None)
            total = (cost.get((account, month, "total", ""), 0)
                     - cost.get((account, month - 1, "total", ""), 0))
            for grain in ("service", "project"):
                ordered = sorted((k for g, k in moves if g == grain),
                                 key=lambda k: (-abs(moves[grain, k][0]), k))
                place = {1: 0, -1: 0}
                for rank, key in enumerate(ordered, 1):
                    delta, is_new, is_gone = moves[grain, key]
                    sign = (delta * total > 0) - (delta * total < 0)
                    if sign:
                        place[sign] += 1
                    expected[account, month, grain, key] = (
                        delta, is_new, is_gone, rank, place[1] if sign == 1 else None,
                        place[-1] if sign == -1 else None)
    return expected


@pytest.mark.parametrize("ranges", [23, None])
def test_against_brute_force_with_a_hot_account(spark, ranges):
    """One account has most rows, most of them in one month and many with equal moves."""
    rng = random.Random(7)
    data = []
    for _ in range(6000):
        hot = rng.random() < 0.6
        account = "hot" if hot else f"a{rng.randrange(20)}"
        month = rng.choice([1, 2, 2, 2, 4]) if hot else rng.randrange(1, 6)
        data.append((account, month, f"s{rng.randrange(40)}",
                     f"p{rng.randrange(900)}" if rng.random() < 0.9 else "",
                     rng.choice([100, 100, 100, rng.randrange(-500, 5000)])))
    df = spark.createDataFrame(data, "account string, month int, service string, "
                                     "project string, cost bigint").selectExpr(
        "account", "make_date(2026, month, 1) AS period", "service", "project", "cost")
    lines = diff.delta_lines(df, ranked=True, ranges=ranges)
    got = {(r.account, r.period.month, r.grain, r.key): (
        r.delta, r.is_new, r.is_gone, r["rank"], r.driver_rank, r.counter_rank)
        for r in lines.collect()}
    assert got == _brute_force(data)


def test_service_deltas_add_up_and_partitioning_does_not_matter(spark, fact):
    rng = random.Random(3)
    df = fact(*[(f"a{rng.randrange(4)}", rng.randrange(1, 7), f"s{rng.randrange(9)}",
                 f"p{rng.randrange(5)}", rng.randrange(1, 10**6) / 1000) for _ in range(800)])
    lines = diff.delta_lines(df)
    sums = lines.filter("grain = 'service'").groupBy("account", "period").agg(
        {"delta": "sum", "total_delta": "first", "share_pct": "sum"}).collect()
    assert sums and all(r["sum(delta)"] == r["first(total_delta)"] for r in sums)
    assert all(abs(r["sum(share_pct)"] - 100) < 0.1 for r in sums)
    one = rows(lines)
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        assert rows(diff.delta_lines(df)) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_money_keeps_ten_decimals(spark):
    tiny = Decimal("0.0000000001")
    big = Decimal("12345678901234.0000000001")
    df = spark.createDataFrame([("a", dt.date(2026, 1, 1), "s", "p", tiny),
                                ("a", dt.date(2026, 2, 1), "s", "p", big)], BILLING_FACT)
    line = diff.delta_lines(df).filter("grain = 'service'").first()
    assert line.delta == Decimal("12345678901234.0000000000")
