"""What queries cost by the bytes they scan, and whether a group of them is over a limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billweave.functions.money import TIB, USD_PER_TIB, dollars, scan_price
from billweave.functions.text import fill, has_template_marks, pad_left, pad_right
from billweave.functions.wording import DEFAULT_LANG, phrases
from billweave.operators.ranking import numbered
from billweave.operators.reports import printed


def price_queries(log: DataFrame, usd_per_tib: float = USD_PER_TIB) -> DataFrame:
    """path, sql, bytes_processed, error (+ any other column) -> bytes_processed, usd, skipped,
    error. Templates are skipped and failed queries keep their error, both at no cost."""
    keep = [c for c in log.columns if c not in ("sql", "bytes_processed", "error")]
    template = has_template_marks(F.col("sql"))
    error = F.coalesce("error", F.lit(""))
    counted = ~template & (error == "")
    scanned = F.when(counted, F.coalesce("bytes_processed", F.lit(0))).otherwise(F.lit(0))
    return log.select(
        *keep, scanned.cast("bigint").alias("bytes_processed"),
        F.when(counted, scan_price(scanned.cast("bigint"), usd_per_tib))
         .otherwise(F.lit(0).cast("decimal(18,2)")).alias("usd"),
        F.when(template, "jinja").otherwise("").alias("skipped"),
        F.when(template, "").otherwise(error).alias("error"))


def _exceeded(total: Column, fail_over_usd: float | None) -> Column:
    return F.lit(False) if fail_over_usd is None else total > F.lit(float(fail_over_usd))


def cost_gate(priced: DataFrame, group: list[str],
              fail_over_usd: float | None = None) -> DataFrame:
    """Exact total of the rounded prices per group and whether it is above the limit."""
    total = F.sum("usd").cast("double")
    return (priced.groupBy(*group)
            .agg(total.alias("total_usd"), F.count(F.lit(1)).alias("n_rows"))
            .withColumn("exceeded", _exceeded(F.col("total_usd"), fail_over_usd)))


def cost_cells(priced: DataFrame, fail_over_usd: float | None = None,
               lang: str = DEFAULT_LANG) -> DataFrame:
    """The printed cells of each query: what it scans and what that costs. A query that is over
    the limit by itself is set in bold."""
    say = phrases(lang)
    usd = F.col("usd").cast("double")
    skipped, failed = F.col("skipped") != "", F.col("error") != ""
    price = dollars(usd)
    bold = F.concat(F.lit("**"), price, F.lit("**"))
    return priced.withColumns({
        "scans": F.when(skipped, say["query_skipped"])
                  .when(failed, fill(say["query_error"], error=F.col("error")))
                  .otherwise(F.concat(F.translate(F.format_number(
                      F.col("bytes_processed") / F.lit(TIB), 2), ",", ""), F.lit(" TiB"))),
        "costs": F.when(skipped | failed, "—")
                  .when(_exceeded(usd, fail_over_usd), bold).otherwise(price)})


def cost_json(priced: DataFrame, group: list[str]) -> DataFrame:
    """One JSON object per query."""
    return priced.select(*group, "path", F.to_json(F.struct(
        "path", "bytes_processed", "usd", "skipped", "error")).alias("json"))


def cost_report(priced: DataFrame, group: list[str], fail_over_usd: float | None = None,
                style: str = "text", usd_per_tib: float = USD_PER_TIB,
                lang: str = DEFAULT_LANG, ranges: int | None = None) -> DataFrame:
    """Report per group and by line, ``style`` text or github, queries in order of path."""
    say = phrases(lang)
    if style not in ("text", "github"):
        raise ValueError(f"style must be 'text' or 'github', not {style!r}")
    path, scans, costs = F.col("path"), F.col("scans"), F.col("costs")
    if style == "text":
        row = F.concat(F.lit("  "), pad_right(path, 48), F.lit(" "), pad_right(scans, 14),
                       F.lit(" "), pad_left(F.replace(costs, F.lit("**"), F.lit("")), 10))
        head, indent, mark = ["", say["query_banner"], ""], "  ", ""
    else:
        row = F.concat(F.lit("| "), path, F.lit(" | "), scans, F.lit(" | "), costs, F.lit(" |"))
        head = [say["query_md_title"], "", say["query_md_columns"], say["query_md_rule"]]
        indent, mark = "", "_"

    rows = cost_cells(priced, fail_over_usd, lang).select(*group, "path", row.alias("text"))
    # The order must not carry the printed text: of equal paths the hash of the text decides.
    rows = rows.withColumn("_tie", F.xxhash64("text"))
    info = priced.groupBy(*group).agg(F.count(F.lit(1)).alias("n_rows"),
                                      F.sum("usd").cast("double").alias("total_usd"))
    lines = numbered(rows, info.select(*group, "n_rows"), group, ["path", "_tie"],
                     {"line": F.lit(1)}, ranges)

    total = fill(say["query_total"], total=dollars(F.col("total_usd")))
    if fail_over_usd is not None:
        state = (F.when(_exceeded(F.col("total_usd"), fail_over_usd), say["query_over"])
                 .otherwise(say["query_ok"]))
        total = F.concat(total, fill(say["query_limit"], limit=F.lit(f"${fail_over_usd:,.2f}"),
                                     state=state))
    note = f"{indent}{mark}{say['query_note'].format(price=f'{usd_per_tib:g}')}{mark}"
    fixed = info.select(*group, "n_rows", F.array(*[F.lit(h) for h in head]).alias("head"),
                        F.array(F.lit(""), F.concat(F.lit(indent), total), F.lit(note), F.lit(""))
                         .alias("tail"))
    return printed(fixed, group, F.col("n_rows")).unionByName(
        lines.select(*group, (F.col("line") + len(head)).cast("long").alias("line"), "text"))
