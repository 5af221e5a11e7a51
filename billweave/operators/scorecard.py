"""Answers to rubric criteria -> scores per dimension and overall, and the printed scorecard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billweave.functions.text import (fill, pad_left, pad_right, score_bar, severity_rank)
from billweave.functions.wording import DEFAULT_LANG, phrases
from billweave.operators.findings import finding_text
from billweave.operators.ranking import numbered
from billweave.operators.reports import printed
from billweave.sources.rubric import dimension_weights


def dimension_scores(answers: DataFrame, rubric: DataFrame) -> DataFrame:
    """Points over the most a dimension can give, in percent with one decimal. ``answers`` holds
    0, 1 or 2 once per platform and criterion, anything else is an error; a criterion without an
    answer earns nothing."""
    criteria = rubric.select("criterion_id", "dimension")
    wrong = F.raise_error(F.concat(F.lit("not one answer of 0, 1 or 2: "), "platform", F.lit(" "),
                                   "criterion_id"))
    checked = F.when((F.col("n") == 1) & F.col("score").isin(0, 1, 2), F.col("score")).otherwise(
        wrong.cast("int"))
    points = (answers.groupBy("platform", "criterion_id")
              .agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("score"))
              .withColumn("score", checked).join(criteria, "criterion_id")
              .groupBy("platform", "dimension").agg(F.sum("score").alias("points")))
    limits = dimension_weights(rubric).select("dimension", "max_points")
    return (points.join(limits, "dimension")
            .select("platform", "dimension", "points", "max_points",
                    F.bround(F.col("points") / F.col("max_points") * 100, 1).alias("score")))


def overall_scores(scores: DataFrame, rubric: DataFrame) -> DataFrame:
    """Mean over the dimensions a platform has, by weight; 0 where none carries weight.

    Products and sums are decimal, so that the result does not depend on the order of rows.
    """
    weights = dimension_weights(rubric).select("dimension", "weight")
    score = F.col("score").cast("decimal(5,1)")
    return (scores.join(weights, "dimension", "left")
            .groupBy("platform")
            .agg(F.sum(score * F.col("weight")).cast("double").alias("weighted"),
                 F.sum("weight").cast("double").alias("weight"))
            .select("platform", F.coalesce(F.bround(
                F.col("weighted") / F.nullif(F.col("weight"), F.lit(0.0)), 1), F.lit(0.0))
                .alias("overall")))


def scorecard_report(scores: DataFrame, rubric: DataFrame, findings: DataFrame | None = None,
                     lang: str = DEFAULT_LANG, ranges: int | None = None) -> DataFrame:
    """Printed scorecard per platform and by line: a bar per dimension, the overall score, then
    findings by severity. Dimensions go by the rubric's name, or else by the language's."""
    say = phrases(lang)
    none = F.array().cast("array<string>")
    order = dimension_weights(rubric).select("dimension", "position", "name")

    name = F.col("dimension")
    for key in say:
        if key.startswith("dim_"):
            name = F.when(F.col("dimension") == key[4:], say[key]).otherwise(name)
    name = F.coalesce("name", name)
    number = pad_left(F.format_number("score", 1), 5)
    row = fill(say["card_row"], name=pad_right(name, 16), bar=score_bar(F.col("score")),
               score=number)
    # As many rows per platform as the rubric has dimensions.
    bars = (scores.join(order, "dimension").groupBy("platform")
            .agg(F.array_sort(F.collect_list(F.struct("position", row.alias("row"))))
                 .alias("bars")))
    total = F.concat(F.lit("  "), pad_right(F.lit(say["card_overall"]), 16), F.lit(" "),
                     pad_left(F.format_number("overall", 1), 5), F.lit("/100"))
    cards = bars.join(overall_scores(scores, rubric), "platform").select(
        "platform", F.concat(F.transform("bars", lambda b: b["row"]),
                             F.array(F.lit(""), total)).alias("card"))
    banner, end = F.array(F.lit(""), F.lit(say["card_banner"]), F.lit("")), F.array(F.lit(""))
    if findings is None:
        fixed = cards.select("platform", F.concat(banner, "card").alias("head"), end.alias("tail"))
        return printed(fixed, ["platform"], F.lit(0))

    text = F.concat(F.lit("  "), F.replace(finding_text(lang), F.lit("\n"), F.lit("\n  ")))
    found = findings.select(
        F.col("subject").alias("platform"), severity_rank(F.col("severity")).alias("severity_rank"),
        "code", F.coalesce(F.col("period").cast("string"), F.lit("")).alias("month"), "item",
        F.split(text, "\n").alias("texts")).withColumn("_tie", F.xxhash64("texts"))
    info = found.groupBy("platform").agg(F.count(F.lit(1)).alias("n_rows"),
                                         F.sum(F.size("texts")).alias("n_lines"))
    title = F.array(F.lit(""), fill(say["card_findings"], n=F.col("n_rows")), F.lit(""))
    fixed = cards.join(info, "platform", "full").select(
        "platform", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "n_rows",
        F.concat(banner, F.coalesce("card", none),
                 F.when(F.col("n_rows") > 0, title).otherwise(none)).alias("head"),
        end.alias("tail"))
    tops = fixed.filter("n_rows > 0").select("platform", "n_rows", F.size("head").alias("top"))
    # A finding prints several lines; the running sum is the number of its last one.
    lines = numbered(found, tops, ["platform"],
                     ["severity_rank", "code", "month", "item", "_tie"],
                     {"last": F.size("texts")}, ranges)
    shown = lines.select("platform", (F.col("top") + F.col("last") - F.size("texts")).alias("_before"),
                         F.posexplode("texts").alias("_at", "text"))
    return printed(fixed, ["platform"], F.col("n_lines")).unionByName(shown.select(
        "platform", (F.col("_before") + F.col("_at") + 1).cast("long").alias("line"), "text"))
