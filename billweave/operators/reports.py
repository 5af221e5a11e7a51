"""Bill comparisons as text, Markdown and JSON.

Reports that can hold a list of any length come as one row per printed line, with its number, so
that no task gathers an account of any size. Their lines, joined by line breaks in order of
``line``, are the report. Reports of a few lines at most are one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from billweave.functions.money import amount, money, percent, signed_money
from billweave.functions.text import fill, pad_left, pad_right
from billweave.functions.wording import DEFAULT_LANG, phrases
from billweave.operators.diff import GRAIN, PAIR, by_move
from billweave.operators.ranking import numbered, top_per_group

# Smallest share, in percent, at which the text names the leading project.
PROJECT_MENTION = 40

TOTALS = ["total_before", "total_after", "total_delta", "growth_pct"]


def no_lines() -> Column:
    return F.array().cast("array<string>")


def lines_of(*items: Column | str) -> Column:
    return F.array(*[F.lit(i) if isinstance(i, str) else i for i in items])


def only_if(condition: Column, lines: Column) -> Column:
    return F.when(condition, lines).otherwise(no_lines())


def joined(*arrays: Column) -> Column:
    return F.array_join(F.concat(*arrays), "\n")


def direction(delta: Column, say: dict[str, str]) -> Column:
    return F.when(delta >= 0, say["rise"]).otherwise(say["drop"])


def headline(unit: int = 1, lang: str = DEFAULT_LANG) -> Column:
    """One sentence on the pair's totals."""
    say = phrases(lang)
    before, after = (money(amount(F.col(c), unit)) for c in ("total_before", "total_after"))
    delta, growth = F.col("total_delta"), F.col("growth_pct")
    return (F.when(growth.isNull(), fill(say["headline_no_base"], after=after))
            .when(delta == 0, fill(say["headline_same"], after=after))
            .otherwise(fill(
                say["headline_moved"], before=before, after=after,
                verb=F.when(delta > 0, say["rose"]).otherwise(say["fell"]),
                pct=percent(F.abs(growth), 1), delta=signed_money(amount(delta, unit)))))


def has_story() -> Column:
    """There is a base and a change to explain."""
    return F.col("growth_pct").isNotNull() & (F.col("total_delta") != 0)


def driver_label(lang: str = DEFAULT_LANG) -> Column:
    say = phrases(lang)
    key = F.col("key")
    return (F.when(F.col("is_new"), fill(say["label_new"], key=key))
            .when(F.col("is_gone"), fill(say["label_gone"], key=key)).otherwise(key))


def driver_detail(unit: int = 1, lang: str = DEFAULT_LANG) -> Column:
    say = phrases(lang)
    return (F.when(F.col("is_new"), say["detail_new"]).when(F.col("is_gone"), say["detail_gone"])
            .otherwise(fill(say["detail_both"], before=money(amount(F.col("before"), unit)),
                            after=money(amount(F.col("after"), unit)))))


def in_order(items: str) -> Column:
    """Texts of collected (position, text) pairs, in order of position."""
    return F.transform(F.array_sort(items), lambda item: item["text"])


def collect_at(condition: Column, position: Column, text: Column) -> Column:
    return F.collect_list(F.when(condition, F.struct(position.alias("position"),
                                                     text.alias("text"))))


def printed(fixed: DataFrame, group: list[str], n_listed: Column) -> DataFrame:
    """The lines of ``head`` and ``tail``, with room for ``n_listed`` lines between them."""
    top = F.size("head")
    return (fixed.select(*group, top.alias("_top"), n_listed.alias("_between"),
                         F.posexplode(F.concat("head", "tail")).alias("_at", "text"))
            .select(*group, (F.col("_at") + 1 + F.when(F.col("_at") < F.col("_top"), 0)
                             .otherwise(F.col("_between"))).cast("long").alias("line"), "text"))


def listed(rows: DataFrame, fixed: DataFrame, group: list[str], position: Column,
           text: Column) -> DataFrame:
    """The lines between head and tail. Joined by one struct, so that a hot report can be split."""
    key = F.struct(*group).alias("_report")
    return (rows.select(key, *group, position.alias("_at"), text.alias("text"))
            .join(fixed.select(key, F.size("head").alias("_top")), "_report")
            .select(*group, (F.col("_top") + F.col("_at")).cast("long").alias("line"), "text"))


def report_text(ranked_lines: DataFrame, top: int = 3, unit: int = 1,
                lang: str = DEFAULT_LANG) -> DataFrame:
    """Narrative of each comparison, by line: headline, the first ``top`` services that drive it
    and how much they explain, every service against the trend, and the leading project."""
    say = phrases(lang)
    service, project = F.col("grain") == "service", F.col("grain") == "project"
    delta, share = F.col("delta"), F.col("share_pct")
    move = signed_money(amount(delta, unit))
    is_driver = service & (F.col("driver_rank") <= top)
    is_counter = service & F.col("counter_rank").isNotNull()
    is_leader = project & (F.col("driver_rank") == 1)
    row = fill(say["driver_row"], i=F.col("driver_rank"), label=pad_right(driver_label(lang), 24),
               delta=pad_left(move, 10), pct=percent(share), detail=driver_detail(unit, lang))
    counter = fill(say["counter_row"], key=pad_right(F.col("key"), 24), delta=pad_left(move, 10))

    facts = (ranked_lines.groupBy(*PAIR)
             .agg(*[F.first(c).alias(c) for c in TOTALS],
                  collect_at(is_driver, F.col("driver_rank"), row).alias("drivers"),
                  F.sum(F.when(is_driver, share.cast("decimal(28,2)"))).cast("double")
                   .alias("coverage"),
                  F.count_if(is_counter).alias("n_counters"),
                  F.max(F.when(is_leader, F.struct("share_pct", "key"))).alias("leader")))
    n, leader = F.size("drivers"), F.col("leader")
    toward = direction(F.col("total_delta"), say)
    values = {"n": n, "pct": percent(F.col("coverage")), "direction": toward}
    title = F.when(n == 1, fill(say["one_driver"], **values)).otherwise(
        fill(say["many_drivers"], **values))
    against = F.when(F.col("total_delta") > 0, say["fell"]).otherwise(say["rose"])
    project_row = fill(say["project_row"], key=leader["key"], pct=percent(leader["share_pct"]),
                       direction=toward)
    fixed = facts.select(
        *PAIR, F.when(has_story(), F.col("n_counters")).otherwise(0).alias("n_listed"),
        F.concat(lines_of("", say["bill_banner"], "", headline(unit, lang)),
                 only_if(has_story() & (n > 0), F.concat(lines_of("", title),
                                                         in_order("drivers"))),
                 only_if(has_story() & (F.col("n_counters") > 0),
                         lines_of("", fill(say["counter_title"], verb=against)))).alias("head"),
        F.concat(only_if(has_story() & (F.abs(leader["share_pct"]) >= PROJECT_MENTION),
                         lines_of("", project_row)), lines_of("")).alias("tail"))
    counters = ranked_lines.filter(is_counter & has_story())
    return printed(fixed, PAIR, F.col("n_listed")).unionByName(
        listed(counters, fixed, PAIR, F.col("counter_rank"), counter))


def report_markdown(lines: DataFrame, top: int = 5, unit: int = 1,
                    lang: str = DEFAULT_LANG) -> DataFrame:
    """Headline, a table of the ``top`` largest moves of any sign and the leading project."""
    say = phrases(lang)
    service, project = F.col("grain") == "service", F.col("grain") == "project"
    row = fill(say["md_row"], label=driver_label(lang),
               before=money(amount(F.col("before"), unit)),
               after=money(amount(F.col("after"), unit)),
               delta=signed_money(amount(F.col("delta"), unit)), pct=percent(F.col("share_pct")))
    chosen = top_per_group(lines.filter(service | (project & (F.col("side") == 1))),
                           GRAIN, by_move(), top)
    reports = chosen.groupBy(*PAIR).agg(
        *[F.first(c).alias(c) for c in TOTALS],
        collect_at(service, F.col("position"), row).alias("rows"),
        F.max(F.when(project & (F.col("position") == 1), F.struct("share_pct", "key")))
         .alias("leader"))
    leader = F.col("leader")
    project_row = fill(say["project_row_md"], key=leader["key"],
                       pct=percent(leader["share_pct"]),
                       direction=direction(F.col("total_delta"), say))
    text = joined(
        lines_of(say["md_title"], "", fill(say["md_headline"], headline=headline(unit, lang)), ""),
        only_if(has_story(), F.concat(lines_of(say["md_columns"], say["md_rule"]),
                                      in_order("rows"))),
        only_if(has_story() & (F.abs(leader["share_pct"]) >= PROJECT_MENTION),
                lines_of("", project_row)),
        lines_of(""))
    return reports.select(*PAIR, text.alias("text"))


def report_json(ranked_lines: DataFrame, unit: int = 1) -> DataFrame:
    """One JSON object per comparison (``grain`` total, ``rank`` 0) and per line of it, in order of
    the size of the move. Amounts keep all their decimals."""
    digits = len(str(unit)) - 1

    def exact(column: str) -> Column:
        kind = ranked_lines.schema[column].dataType
        if unit == 1 and isinstance(kind, DecimalType):
            return F.col(column)
        scale = (kind.scale if isinstance(kind, DecimalType) else 0) + digits
        return (F.col(column).cast(DecimalType(38 - digits - 1, scale)) / unit).cast(
            DecimalType(38, scale)).alias(column)

    def pct(column: str) -> Column:
        return F.col(column).cast("decimal(18,2)")

    def as_json(*columns: Column | str) -> Column:
        return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json")

    lines = ranked_lines.select(*PAIR, "grain", "rank", as_json(
        "key", exact("before"), exact("after"), exact("delta"),
        pct("share_pct").alias("pct_of_total_delta"), "is_new", "is_gone"))
    totals = ranked_lines.groupBy(*PAIR).agg(*[F.first(c).alias(c) for c in TOTALS])
    return lines.unionByName(totals.select(
        *PAIR, F.lit("total").alias("grain"), F.lit(0).cast("long").alias("rank"), as_json(
            exact("total_before"), exact("total_after"), exact("total_delta").alias("delta"),
            pct("growth_pct").alias("growth_pct"))))


def write_reports(reports: DataFrame, path: str, by: list[str], text: str | None = None,
                  most_chars: int = 64_000_000, ranges: int | None = None) -> None:
    """Write reports as files: a folder per value of ``by``, in it a folder ``part=0`` with one file of all
    lines, in the order of the remaining columns. A report of more than ``most_chars`` characters goes on
    in part 1, 2, ..., each of about that size, so that no task writes a huge one alone. ``text`` names the
    printed column; by default ``text`` or else ``json``."""
    text = text or ("text" if "text" in reports.columns else "json")
    rest = [c for c in reports.columns if c not in by and c != text]
    size = F.length(text) + 1
    # Equal places are told apart by the text, as a part must not depend on how they happen to lie.
    lines = reports.withColumns({"_size": size.cast("bigint"), "_tie": F.xxhash64(text)})
    whole = lines.groupBy(*by).agg(F.sum("_size").alias("_all"))
    placed = numbered(lines, whole, by, [*rest, "_tie"], {"_until": F.col("_size")}, ranges)
    part = F.when(F.col("_all") <= most_chars, 0).otherwise(F.floor((F.col("_until") - F.col("_size")) / most_chars))
    (placed.withColumn("part", part.cast("int")).repartition(*by, "part")
     .sortWithinPartitions(*by, "part", *rest, "_tie")
     .select(*by, "part", F.col(text).alias("value")).write.mode("overwrite").partitionBy(*by, "part").text(path))
