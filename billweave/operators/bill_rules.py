"""Findings on a bill comparison: spike, new service, project concentration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billweave.functions.money import amount, money, percent, signed_money
from billweave.functions.text import fill
from billweave.functions.wording import DEFAULT_LANG, phrases
from billweave.operators.diff import GRAIN, by_move
from billweave.operators.findings import emit, finding, union_findings
from billweave.operators.ranking import top_per_group


def bill_findings(lines: DataFrame, spike: float = 25, new_share: float = 10,
                  project_share: float = 60, unit: int = 1,
                  lang: str = DEFAULT_LANG) -> DataFrame:
    """BILL-01, -02 and -03 for every account and month of ``delta_lines``.

    Growth and shares are compared as shown, that is after rounding to two decimals.
    """
    say = phrases(lang)
    is_service, is_project = F.col("grain") == "service", F.col("grain") == "project"
    rising = F.col("total_delta") > 0
    delta = signed_money(amount(F.col("delta"), unit))
    common = {"period": F.col("period"), "item": F.col("key")}

    # One top-1 pass serves both rules: the largest service of a spike, whatever its sign, and
    # the project that moves most with a rise.
    leaders = top_per_group(
        lines.filter((is_service & (F.col("growth_pct") > spike))
                     | (is_project & rising & (F.col("side") == 1))),
        GRAIN, by_move(), 1)
    spike_found = finding(
        F.col("account"), "BILL-01",
        fill(say["BILL-01"], pct=percent(F.col("growth_pct")),
             before=money(amount(F.col("total_before"), unit)),
             after=money(amount(F.col("total_after"), unit))),
        "high", "cost", evidence=fill(say["BILL-01_evidence"], key=F.col("key"), delta=delta),
        fix=say["fix_BILL-01"], metric=F.col("growth_pct"), threshold=spike, **common)
    newcomer_found = finding(
        F.col("account"), "BILL-02",
        fill(say["BILL-02"], key=F.col("key"), pct=percent(F.col("share_pct")), delta=delta),
        "medium", "cost", fix=say["fix_BILL-02"], metric=F.col("share_pct"),
        threshold=new_share, **common)
    project_found = finding(
        F.col("account"), "BILL-03",
        fill(say["BILL-03"], key=F.col("key"), pct=percent(F.col("share_pct"))),
        "medium", "cost", fix=say["fix_BILL-03"], metric=F.col("share_pct"),
        threshold=project_share, **common)
    concentrated = is_project & (F.col("share_pct") > project_share)
    newcomer = is_service & rising & F.col("is_new") & (F.col("share_pct") > new_share)
    return union_findings(emit(leaders, (is_service, spike_found), (concentrated, project_found)),
                          lines.filter(newcomer).select(*newcomer_found))
