"""Rules on recent daily spend: projected spike, untagged share, top services.

Input: ``account, used_at DATE or TIMESTAMP, service, team_tag (NULL or '' = none), cost``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billweave.functions.money import amount, percent
from billweave.functions.text import fill
from billweave.functions.wording import DEFAULT_LANG, phrases
from billweave.operators.findings import emit, finding
from billweave.operators.ranking import top_per_group

# Fixed value: every month counts as this many days in the projection.
DAYS_IN_MONTH = 30

# Tag values that mean "no team".
NO_TEAM = ("", "team$", "team$__missing__")


def month_bounds(as_of: dt.date) -> tuple[dt.date, dt.date, dt.date]:
    """First day of last month, first day of this month, and the (exclusive) end of the data
    looked at: ``as_of`` itself, or the day after on the first of a month."""
    this_month = as_of.replace(day=1)
    last_month = (this_month - dt.timedelta(days=1)).replace(day=1)
    return last_month, this_month, max(as_of, this_month + dt.timedelta(days=1))


def spend_by_service(fact: DataFrame, as_of: dt.date) -> DataFrame:
    """Cost of last month, of this month so far and of last month without a team, per account and
    service. One pass; the date range reaches the scan as a pushed filter."""
    day = fact.schema["used_at"].dataType
    last_month, this_month, end = (F.lit(d.isoformat()).cast(day) for d in month_bounds(as_of))
    used, cost = F.col("used_at"), F.col("cost")
    earlier = used < this_month
    no_team = F.coalesce(F.col("team_tag"), F.lit("")).isin(*NO_TEAM)
    return (fact.filter((used >= last_month) & (used < end))
            .groupBy("account", "service")
            .agg(F.sum(F.when(earlier, cost)).alias("last_month"),
                 F.sum(F.when(~earlier, cost)).alias("this_month"),
                 F.sum(F.when(earlier & no_team, cost)).alias("untagged")))


def spend_by_account(by_service: DataFrame) -> DataFrame:
    zero = F.lit(0)
    return by_service.groupBy("account").agg(
        *[F.coalesce(F.sum(name), zero).alias(name)
          for name in ("last_month", "this_month", "untagged")])


def projected_growth(by_account: DataFrame, as_of: dt.date) -> DataFrame:
    """Run rate of this month as a 30-day month, and its growth on last month; the growth is NULL
    without a base."""
    elapsed = max((as_of - as_of.replace(day=1)).days, 1)
    base = F.col("last_month").cast("double")
    projected = F.col("this_month").cast("double") / elapsed * DAYS_IN_MONTH
    return (by_account.withColumn("projected", projected)
            .withColumn("growth_pct", F.when(
                base > 0, (F.col("projected") - base) / F.nullif(base, F.lit(0.0)) * 100)))


def untagged_share(by_account: DataFrame) -> DataFrame:
    """Part of last month's cost without a team; NULL without a base."""
    base = F.col("last_month").cast("double")
    return by_account.withColumn("untagged_share", F.when(
        base > 0, F.col("untagged").cast("double") / F.nullif(base, F.lit(0.0))))


def top_spend_services(by_service: DataFrame, top: int = 3) -> DataFrame:
    return top_per_group(by_service.filter(F.col("last_month").isNotNull()), ["account"],
                         [F.desc("last_month"), "service"], top, "rank")


def spend_findings(fact: DataFrame, as_of: dt.date, growth: float = 20, untagged: float = 0.4,
                   top: int = 3, unit: int = 1, lang: str = DEFAULT_LANG) -> DataFrame:
    """COS-SPIKE, AP-C04 and the informative COS-TOP, for every account."""
    say = phrases(lang)
    is_account, account = F.col("grain") == "account", F.col("account")

    # Accounts and services come from one grouping-set pass over the monthly sums, so that the
    # raw spend is read once; of each only the leading rows go on.
    sums = ("last_month", "this_month", "untagged")
    grains = (spend_by_service(fact, as_of)
              .groupingSets([["account"], ["account", "service"]], "account", "service")
              .agg(F.grouping_id().alias("gid"),
                   *[F.sum(name).alias(name) for name in sums])
              .withColumn("grain", F.when(F.col("gid") == 1, "account").otherwise("service"))
              .filter(F.col("last_month").isNotNull()))
    leaders = top_per_group(grains, ["account", "grain"], [F.desc("last_month"), "service"], top)
    zero = F.lit(0)
    judged = untagged_share(projected_growth(
        leaders.withColumns({name: F.coalesce(name, zero) for name in sums}), as_of))

    def whole(column: str):
        return F.format_number(amount(F.col(column), unit), 0)

    spike_found = finding(
        account, "COS-SPIKE",
        fill(say["COS-SPIKE"], pct=percent(F.col("growth_pct")), before=whole("last_month"),
             after=whole("projected")),
        "high", "cost", evidence=F.lit(say["COS-SPIKE_evidence"]), fix=say["fix_COS-SPIKE"],
        metric=F.col("growth_pct"), threshold=growth)
    untagged_found = finding(
        account, "AP-C04",
        fill(say["AP-C04"], pct=percent(F.col("untagged_share") * 100)), "medium", "cost",
        fix=say["fix_AP-C04"], metric=F.col("untagged_share"), threshold=untagged)
    top_found = finding(
        account, "COS-TOP",
        fill(say["COS-TOP"], key=F.col("service"), cost=whole("last_month")), "low", "cost",
        item=F.col("service"), metric=amount(F.col("last_month"), unit))
    return emit(judged,
                (is_account & (F.col("growth_pct") > growth), spike_found),
                (is_account & (F.col("untagged_share") > untagged), untagged_found),
                (~is_account, top_found))
