"""Month-over-month bill comparison for every account at once.

Input fact: ``account STRING, period DATE (any day of the month), service STRING, project STRING
('' = none), cost`` with cost DECIMAL or any integer type.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from billweave.functions.money import share_pct
from billweave.operators.ranking import numbered, ones, top_per_group

# Share of the change, in percent, above which a new key counts as a newcomer.
NEWCOMER_SHARE = 10

PAIR = ["account", "period"]
GRAIN = ["account", "period", "grain"]
# The same order as by_move, as columns to sort upwards.
LINE_ORDER = ["sort_move", "key"]


def by_month(fact: DataFrame) -> DataFrame:
    """The fact with every date at the first of its month; a missing one is an error."""
    known = F.coalesce("period", F.raise_error(F.lit("a row of the bill has no period")).cast("date"))
    return fact.withColumn("period", F.trunc(known, "MM"))


def cost_cells(fact: DataFrame) -> DataFrame:
    """One row per account, month, service and project. The only pass over the raw rows: partial
    aggregation shrinks them before the shuffle, also when one key holds most of them."""
    cells = (by_month(fact).groupBy("account", "period", "service",
                          F.coalesce("project", F.lit("")).alias("project"))
             .agg(F.sum("cost").alias("cost")))
    summed = cells.schema["cost"].dataType
    if isinstance(summed, DecimalType) and summed.precision > 26:
        # Leaves room for further sums and differences without losing scale.
        cells = cells.withColumn("cost", F.col("cost").cast(DecimalType(26, summed.scale)))
    return cells


def cost_by_grain(fact: DataFrame) -> DataFrame:
    """Totals per service, per project and overall, in one grouping-set pass over the cells."""
    gid = F.grouping_id()
    return (cost_cells(fact)
            .groupingSets([["account", "period", "service"], ["account", "period", "project"],
                           ["account", "period"]],
                          "account", "period", "service", "project")
            .agg(gid.alias("gid"), F.sum("cost").alias("cost"))
            .select("account", "period",
                    F.when(F.col("gid") == 1, "service").when(F.col("gid") == 2, "project")
                     .otherwise("total").alias("grain"),
                    F.when(F.col("gid") == 1, F.col("service"))
                     .when(F.col("gid") == 2, F.col("project")).otherwise("").alias("key"),
                    "cost")
            .filter((F.col("grain") != "project") | (F.col("key") != "")))


def total_cost(fact: DataFrame) -> DataFrame:
    return by_month(fact).groupBy(*PAIR).agg(F.sum("cost").alias("cost"))


def cost_by_service(fact: DataFrame) -> DataFrame:
    return by_month(fact).groupBy(*PAIR, "service").agg(F.sum("cost").alias("cost"))


def cost_by_project(fact: DataFrame) -> DataFrame:
    return (by_month(fact).filter(F.col("project") != "")
            .groupBy(*PAIR, "project").agg(F.sum("cost").alias("cost")))


def _as_roles(costs: DataFrame) -> DataFrame:
    """Each month's cost is the 'after' of its own month and the 'before' of the next one.

    Takes the place of a self-join or of reading the fact twice.
    """
    cost, none = F.col("cost"), F.lit(None).cast(costs.schema["cost"].dataType)
    others = [c for c in costs.columns if c not in ("period", "cost")]
    return costs.select(*others, F.inline(F.array(
        F.struct(F.col("period").alias("period"), none.alias("before"), cost.alias("after")),
        F.struct(F.add_months("period", 1).alias("period"), cost.alias("before"),
                 none.alias("after")))))


def _lines(roles: DataFrame) -> DataFrame:
    """Both grains of the comparison; a side that is NULL had no such key (0 is a real cost)."""
    return (roles.select(*PAIR, "before", "after", F.inline(F.array(
                F.struct(F.lit("service").alias("grain"), F.col("service").alias("key")),
                F.struct(F.lit("project").alias("grain"), F.col("project").alias("key")))))
            .filter((F.col("grain") != "project") | (F.col("key") != ""))
            .groupBy(*GRAIN, "key")
            .agg(F.sum("before").alias("before"), F.sum("after").alias("after")))


def _totals(roles: DataFrame, *more: Column) -> DataFrame:
    """n_rows is an upper bound of the lines per grain."""
    return (roles.groupBy(*PAIR)
            .agg(F.sum("before").alias("before"), F.sum("after").alias("after"),
                 F.count(F.lit(1)).alias("n_rows"), *more))


def _between_billed_months(totals: DataFrame) -> DataFrame:
    """Keep months after the account's first and up to its last billed one. The window runs over
    an account's months, not over its rows."""
    months = W.partitionBy("account")
    billed = F.when(F.col("after").isNotNull(), F.col("period"))
    return (totals
            .withColumns({"_first": F.min(billed).over(months),
                          "_last": F.max(billed).over(months)})
            .filter((F.col("_first") < F.col("period")) & (F.col("period") <= F.col("_last")))
            .drop("_first", "_last"))


def _with_growth(totals: DataFrame) -> DataFrame:
    zero = F.lit(0)
    before, after = F.coalesce("before", zero), F.coalesce("after", zero)
    change = after - before
    growth = F.when(before > 0, F.bround(
        change.cast("double") / before.cast("double") * 100, 2))
    return (totals.withColumns({"total_before": before, "total_after": after,
                                "total_delta": change, "growth_pct": growth})
            .drop("before", "after"))


def pair_totals(fact: DataFrame) -> DataFrame:
    """Per account and month: total before, after, delta and growth (NULL without a base)."""
    totals = _totals(_as_roles(total_cost(fact)))
    return _with_growth(_between_billed_months(totals)).drop("n_rows")


def move_side(delta: Column, total_delta: Column) -> Column:
    """1 = moves with the total, -1 = against it, 0 = neither."""
    return (F.signum(delta.cast("double")) * F.signum(total_delta.cast("double"))).cast("int")


def _moves(lines: DataFrame) -> DataFrame:
    before, after = F.coalesce("before", F.lit(0)), F.coalesce("after", F.lit(0))
    return lines.select(
        *GRAIN, "key", before.alias("before"), after.alias("after"),
        (after - before).alias("delta"),
        F.col("before").isNull().alias("is_new"), F.col("after").isNull().alias("is_gone"),
        (-F.abs(after - before)).alias("sort_move"))


def _compared(roles: DataFrame, totals: DataFrame, ranked: bool, ranges: int | None) -> DataFrame:
    moves = _moves(_lines(roles))
    side = move_side(F.col("delta"), F.col("total_delta"))
    share = share_pct(F.col("delta"), F.col("total_delta"))
    columns = ["account", F.col("shown_period").alias("period"), "grain", "key", "before",
               "after", "delta", share.alias("share_pct"), "is_new", "is_gone",
               side.alias("side"), "total_before", "total_after", "total_delta", "growth_pct"]
    if not ranked:
        # Joined by one struct on purpose: later steps by account and month then shuffle (little,
        # after their own partial work), which leaves adaptive execution free to split a hot pair.
        pair = F.struct(*PAIR).alias("pair")
        return (moves.select(pair, "*").join(totals.select(pair, "*").drop(*PAIR), "pair")
                .select(*columns))
    info = totals.select("*", F.explode(F.array(F.lit("service"), F.lit("project")))
                         .alias("grain"))
    newcomer = F.col("is_new") & (share > NEWCOMER_SHARE)
    ranks = {"driver_rank": side == 1, "counter_rank": side == -1, "newcomer_rank": newcomer}
    sums = {"rank": F.lit(1), **{name: ones(member) for name, member in ranks.items()}}
    return numbered(moves, info, GRAIN, LINE_ORDER, sums, ranges).select(
        *columns, "rank",
        *[F.when(member, F.col(name)).alias(name) for name, member in ranks.items()])


def delta_lines(fact: DataFrame, ranked: bool = False,
                ranges: int | None = None) -> DataFrame:
    """What changed against the month before, per account, month, grain and key.

    Every month of every account is compared at once. ``side`` tells whether a line moves with the
    total (1) or against it (-1). The pair's totals ride along, so that rules and reports need no
    further join. With ``ranked``, ``rank`` orders the lines of a grain by the size of the move,
    ``driver_rank`` those of side 1, ``counter_rank`` those of side -1 and ``newcomer_rank`` new
    keys with a notable share.
    Leave it off where only the first few lines matter: ``top_per_group`` finds those without
    numbering the rest.
    """
    roles = _as_roles(cost_cells(fact))
    totals = _with_growth(_between_billed_months(_totals(roles)))
    return _compared(roles, totals.withColumn("shown_period", F.col("period")), ranked,
                     ranges)


def _two_roles(before: DataFrame, after: DataFrame) -> DataFrame:
    """Roles of two given snapshots. They share a placeholder period; their own is kept aside."""
    # Whatever their dates are, even none: here the sides are given.
    unknown = F.coalesce("period", F.lit("1970-01-01").cast("date"))
    old, new = (cost_cells(x.withColumn("period", unknown)) for x in (before, after))
    sides = [
        snapshot.select("account", "service", "project", F.lit("1970-01-01").cast("date")
                        .alias("period"), *[
                            (F.col("cost") if name == own else
                             F.lit(None).cast(snapshot.schema["cost"].dataType)).alias(name)
                            for name in ("before", "after")],
                        F.col("period").alias("own_period"))
        for own, snapshot in (("before", old), ("after", new))]
    return sides[0].unionByName(sides[1])


def _two_totals(roles: DataFrame, period: dt.date | None) -> DataFrame:
    own = F.col("own_period")
    shown = (F.coalesce(F.max(F.when(F.col("after").isNotNull(), own)), F.max(own))
             if period is None else F.lit(period))
    return _with_growth(_totals(roles, shown.alias("shown_period")))


def diff_two(before: DataFrame, after: DataFrame, period: dt.date | None = None,
             ranked: bool = False, ranges: int | None = None) -> DataFrame:
    """The same lines for two given snapshots, one per account and side, whatever their dates.

    The result carries ``period``; if none is given, that of the account's later snapshot, or of
    its earlier one where the later has no rows.
    """
    roles = _two_roles(before, after)
    return _compared(roles, _two_totals(roles, period), ranked, ranges)


def diff_two_totals(before: DataFrame, after: DataFrame,
                    period: dt.date | None = None) -> DataFrame:
    totals = _two_totals(_two_roles(before, after), period)
    return totals.withColumn("period", F.col("shown_period")).drop("shown_period", "n_rows")


def by_move() -> list[Column]:
    """Largest move first, ties by name."""
    return [F.abs("delta").desc(), F.col("key")]


def drivers(lines: DataFrame, top: int = 3) -> DataFrame:
    """The first services that move in the direction of the total."""
    moving = lines.filter((F.col("grain") == "service") & (F.col("side") == 1))
    return top_per_group(moving, PAIR, by_move(), top)


def counter_movers(lines: DataFrame) -> DataFrame:
    """All services that move against the total."""
    return lines.filter((F.col("grain") == "service") & (F.col("side") == -1))


def top_project(lines: DataFrame) -> DataFrame:
    """The project that moves most in the direction of the total."""
    moving = lines.filter((F.col("grain") == "project") & (F.col("side") == 1))
    return top_per_group(moving, PAIR, by_move(), 1)


def driver_coverage(lines: DataFrame, top: int = 3) -> DataFrame:
    """How many drivers are shown and what share of the change they add up to."""
    return (drivers(lines, top).groupBy(*PAIR)
            .agg(F.count(F.lit(1)).alias("n_drivers"),
                 F.sum(F.col("share_pct").cast("decimal(28,2)")).cast("double")
                  .alias("coverage_pct")))


def top_services(fact: DataFrame, top: int = 3) -> DataFrame:
    """The most expensive services of each month with their share of the month's total."""
    cells = cost_cells(fact)
    services = cells.groupBy(*PAIR, "service").agg(F.sum("cost").alias("cost"))
    ranked = top_per_group(services, PAIR, [F.desc("cost"), "service"], top, "rank")
    totals = cells.groupBy(*PAIR).agg(F.sum("cost").alias("total"))
    return ranked.join(totals, PAIR).select(
        *PAIR, "rank", "service", "cost", "total",
        F.when(F.col("total") != 0, F.col("cost").cast("double")
               / F.nullif(F.col("total").cast("double"), F.lit(0.0)) * 100)
         .otherwise(0.0).alias("share_pct"))
