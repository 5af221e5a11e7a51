"""Bill summaries fit for publication: coarse amounts, whole percentages, project pseudonyms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billweave.functions.money import amount, coarse_amount, percent
from billweave.functions.text import fill, letters
from billweave.functions.wording import DEFAULT_LANG, phrases
from billweave.operators.diff import PAIR, top_services
from billweave.operators.reports import (TOTALS, collect_at, in_order, joined, lines_of, listed,
                                         only_if, printed)

TOP_DRIVERS = 3
MAJORITY = 50
PROJECT_SHARE = 60


def project_alias(rank: Column, lang: str = DEFAULT_LANG) -> Column:
    return fill(phrases(lang)["project_alias"], letters=letters(rank))


def anonymize(ranked_lines: DataFrame, unit: int = 1, lang: str = DEFAULT_LANG) -> DataFrame:
    """Lines without real project names or exact amounts. Projects are lettered by the size of
    their move, so a letter means a place in one comparison, not one project for good."""
    is_project = F.col("grain") == "project"

    def coarse(column: str) -> Column:
        return coarse_amount(amount(F.col(column), unit)).alias(column)

    return ranked_lines.select(
        *PAIR, "grain", "rank",
        F.when(is_project, project_alias(F.col("rank"), lang)).otherwise(F.col("key"))
         .alias("label"),
        coarse("before"), coarse("after"), coarse("delta"), F.col("side"),
        percent(F.abs("share_pct")).alias("share"), "is_new", "is_gone")


def project_aliases(ranked_lines: DataFrame, lang: str = DEFAULT_LANG) -> DataFrame:
    """The map from project to pseudonym; keep it apart from what is published."""
    return ranked_lines.filter(F.col("grain") == "project").select(
        *PAIR, F.col("key").alias("project"), project_alias(F.col("rank"), lang).alias("alias"))


def _majority() -> Column:
    return ((F.col("grain") == "service") & (F.col("rank") == 1)
            & (F.col("share_pct") > MAJORITY))


def _newcomer() -> Column:
    return (F.col("grain") == "service") & F.col("newcomer_rank").isNotNull()


def _concentrated() -> Column:
    return ((F.col("grain") == "project") & (F.col("driver_rank") == 1)
            & (F.col("share_pct") > PROJECT_SHARE))


def _lesson_texts(lang: str) -> tuple[Column, Column, Column]:
    say = phrases(lang)
    return (fill(say["lesson_majority"], key=F.col("key")),
            fill(say["lesson_new"], key=F.col("key")),
            fill(say["lesson_project"], alias=project_alias(F.col("rank"), lang),
                 pct=percent(F.col("share_pct"))))


def lessons(ranked_lines: DataFrame, lang: str = DEFAULT_LANG) -> DataFrame:
    """One row per lesson: a service with most of the change, each new service with a notable
    share, a project with most of the change. ``section`` and ``rank`` give their order."""
    rules = (_majority(), _newcomer(), _concentrated())
    found = F.array_compact(F.array(*[
        F.when(rule, F.struct(F.lit(section).alias("section"), text.alias("lesson")))
        for section, (rule, text) in enumerate(zip(rules, _lesson_texts(lang)), 1)]))
    return (ranked_lines.filter(rules[0] | rules[1] | rules[2])
            .select(*PAIR, "rank", F.inline(found))
            .select(*PAIR, "section", "rank", "lesson"))


def _title(alias: str | None, sector: str, say: dict[str, str]) -> str:
    return say["anon_title"].format(alias=alias or say["anon_alias"],
                                    sector=f" ({sector})" if sector else "")


def anonymous_report(ranked_lines: DataFrame, alias: str | None = None, sector: str = "",
                     unit: int = 1, lang: str = DEFAULT_LANG) -> DataFrame:
    """Why the bill changed, per account and month and by line, without amounts or project names
    that give the customer away."""
    say = phrases(lang)
    rises = F.col("total_delta") >= 0
    is_driver = (F.col("grain") == "service") & (F.col("driver_rank") <= TOP_DRIVERS)
    row = fill(say["anon_row"], i=F.col("driver_rank"), key=F.col("key"),
               new=F.when(F.col("is_new"), say["anon_new"]).otherwise(""),
               sign=F.when(F.col("delta") >= 0, "+").otherwise("-"),
               delta=coarse_amount(amount(F.col("delta"), unit)),
               pct=percent(F.abs("share_pct")),
               direction=F.when(rises, say["rise"]).otherwise(say["saving"]))
    majority, newcomer, concentrated = _lesson_texts(lang)
    dash = F.lit("- ")
    facts = (ranked_lines.groupBy(*PAIR)
             .agg(*[F.first(c).alias(c) for c in TOTALS],
                  collect_at(is_driver, F.col("driver_rank"), row).alias("drivers"),
                  F.max(F.when(_majority(), F.concat(dash, majority))).alias("first"),
                  F.count_if(_newcomer()).alias("n_new"),
                  F.max(F.when(_concentrated(), F.concat(dash, concentrated))).alias("last")))
    any_lesson = F.col("first").isNotNull() | F.col("last").isNotNull() | (F.col("n_new") > 0)
    growth = F.coalesce(F.concat(percent(F.abs("growth_pct")), F.lit("%")), F.lit("—"))
    opening = fill(say["anon_opening"], verb=F.when(rises, say["rose"]).otherwise(say["fell"]),
                   pct=growth, before=coarse_amount(amount(F.col("total_before"), unit)),
                   after=coarse_amount(amount(F.col("total_after"), unit)))
    fixed = facts.select(
        *PAIR, "n_new",
        F.concat(lines_of(_title(alias, sector, say), "", opening, "", say["anon_drivers"]),
                 in_order("drivers"), only_if(any_lesson, lines_of("", say["anon_lessons"])),
                 F.array_compact(F.array("first"))).alias("head"),
        F.concat(F.array_compact(F.array("last")), lines_of("", say["anon_note"], ""))
         .alias("tail"))
    return printed(fixed, PAIR, F.col("n_new")).unionByName(
        listed(ranked_lines.filter(_newcomer()), fixed, PAIR, F.col("newcomer_rank"),
               F.concat(dash, newcomer)))


def anonymous_breakdown(fact: DataFrame, alias: str | None = None, sector: str = "",
                        unit: int = 1, lang: str = DEFAULT_LANG) -> DataFrame:
    """Where the money of each month is: coarse total and the three largest services."""
    say = phrases(lang)
    row = fill(say["anon_spot_row"], i=F.col("rank"), key=F.col("service"),
               cost=coarse_amount(amount(F.col("cost"), unit)), pct=percent(F.col("share_pct")))
    months = (top_services(fact, TOP_DRIVERS).groupBy(*PAIR)
              .agg(F.first("total").alias("total"),
                   collect_at(F.lit(True), F.col("rank"), row).alias("rows")))
    total = fill(say["anon_total"], total=coarse_amount(amount(F.col("total"), unit)))
    return months.select(*PAIR, joined(
        lines_of(_title(alias, sector, say), "", total, "", say["anon_spots"]),
        in_order("rows"), lines_of("", say["anon_note"], "")).alias("text"))
