import json
import string

import pytest
from conftest import rows
from pyspark.sql import functions as F

from billweave.operators import anonymize, diff, reports
from billweave.functions.money import coarse_amount, money, percent, signed_money
from billweave.functions.text import letters
from billweave.functions.wording import EN, ES


@pytest.fixture(scope="module")
def lines(bills):
    return diff.diff_two(*bills, ranked=True).cache()


def text_of(report):
    """A report as one text; its lines in order, without gaps."""
    found = report.orderBy("line").collect()
    assert [r.line for r in found] == list(range(1, len(found) + 1))
    return "\n".join(r.text for r in found)


def row(label, delta):
    return f"{label:<24} {delta:>10}"


def test_text_of_a_rise(lines):
    assert text_of(reports.report_text(lines)) == "\n".join([
        "", "═══ BILLING DIFF ═══", "",
        "Tu cuenta pasó de $5.500 a $7.124: subió 29.5% (+$1.624).", "",
        "2 razones explican el 145% del aumento:",
        f"  1. {row('Map Tiles', '+$1.400')}   (86% del delta)   $800 → $2.200",
        f"  2. {row('Stream Hub [nuevo]', '+$950')}   (58% del delta)   no existía en el periodo anterior",
        "", "También bajó:", f"  · {row('Batch Runner', '-$600')}", f"  · {row('Mail Relay', '-$76')}",
        f"  · {row('Object Vault', '-$50')}", "", "Por proyecto: lago concentra el 65% del aumento.", ""])


def test_text_of_a_fall(bills):
    before, after = bills
    assert text_of(reports.report_text(diff.diff_two(after, before, ranked=True), top=1)) == "\n".join([
        "", "═══ BILLING DIFF ═══", "",
        "Tu cuenta pasó de $7.124 a $5.500: bajó 22.8% (-$1.624).", "",
        "1 razón explica el 86% del baja:",
        f"  1. {row('Map Tiles', '-$1.400')}   (86% del delta)   $2.200 → $800",
        "", "También subió:", f"  · {row('Batch Runner', '+$600')}",
        f"  · {row('Mail Relay [nuevo]', '+$76').replace(' [nuevo]', '        ')}",
        f"  · {row('Object Vault', '+$50')}", "", "Por proyecto: lago concentra el 65% del baja.", ""])


def test_text_without_base_or_change(bills):
    before, _ = bills
    none = reports.report_text(diff.diff_two(before.limit(0), before, ranked=True))
    assert text_of(none) == "\n".join([
        "", "═══ BILLING DIFF ═══", "",
        "Sin base de comparación en el primer archivo (total $0): el periodo actual suma $5.500.", ""])
    same = text_of(reports.report_text(diff.diff_two(before, before, ranked=True)))
    assert same == "\n═══ BILLING DIFF ═══\n\nTu cuenta se mantuvo en $5.500.\n"


def test_languages_have_the_same_phrases():
    def slots(text):
        return {name for _, name, _, _ in string.Formatter().parse(text) if name is not None}
    assert {k: slots(v) for k, v in ES.items()} == {k: slots(v) for k, v in EN.items()}


def test_english(lines):
    assert "2 reasons explain 145% of the rise:" in text_of(reports.report_text(lines, lang="en"))
    with pytest.raises(ValueError, match="unknown language"):
        reports.report_text(lines, lang="xx")


def test_markdown(lines):
    assert reports.report_markdown(lines, top=3).first().text == "\n".join([
        "## Billing diff", "",
        "**Tu cuenta pasó de $5.500 a $7.124: subió 29.5% (+$1.624).**", "",
        "| Servicio | Antes | Después | Δ | % del delta |", "|---|---:|---:|---:|---:|",
        "| Map Tiles | $800 | $2.200 | +$1.400 | 86% |",
        "| Stream Hub [nuevo] | $0 | $950 | +$950 | 58% |",
        "| Batch Runner | $3.000 | $2.400 | -$600 | -37% |", "",
        "Por proyecto: **lago** concentra el 65% del aumento.", ""])


def test_json_by_line(lines):
    found = {(r.grain, r["rank"]): json.loads(r.json) for r in reports.report_json(lines).collect()}
    assert found["total", 0] == {"total_before": 5500, "total_after": 7124.5, "delta": 1624.5,
                                 "growth_pct": 29.54}
    assert found["service", 2] == {"key": "Stream Hub", "before": 0, "after": 950, "delta": 950,
                                   "pct_of_total_delta": 58.48, "is_new": True, "is_gone": False}
    assert [found["project", i]["key"] for i in (1, 2, 3)] == ["lago", "puerto", "cumbre"]
    assert len(found) == 1 + 6 + 3


def test_json_keeps_all_decimals(fact):
    lines = diff.delta_lines(fact(("a", 1, "s", "p", "0.004"), ("a", 2, "s", "p", "0.009")), ranked=True)
    line = reports.report_json(lines).filter("grain = 'service'").first().json
    assert '"before":0.0040000000,"after":0.0090000000,"delta":0.0050000000' in line


def _many(fact, n=37):
    up = [("a", 2, f"up{i:03d}", "p", 1000 * n + i) for i in range(60)]
    down = [("a", 1, f"down{i:05d}", "q", 1 + i / 10) for i in range(n)]
    return diff.delta_lines(fact(*up, *down), ranked=True, ranges=5)


def test_reports_have_one_form_whatever_their_size(fact):
    grid = [("a", month, f"s{s}", f"p{p}", 10 + s * p * month) for month in (1, 2)
            for s in range(20) for p in range(30)]
    small, large = diff.delta_lines(fact(*grid), ranked=True), _many(fact, 5000)
    for report in (reports.report_text, reports.report_json, anonymize.anonymous_report):
        assert report(small).columns == report(large).columns
    assert text_of(reports.report_text(small)).count("\n") < 20
    whole = text_of(reports.report_text(large)).splitlines()
    counters = [x.split()[1] for x in whole if x.startswith("  · ")]
    assert counters == [f"down{i:05d}" for i in reversed(range(5000))]


def test_lessons_in_order(fact):
    """Eight new services with 12.5 % each, no majority, one project with all of the rise."""
    lines = diff.delta_lines(fact(("a", 1, "old", "p", 5), ("a", 2, "old", "p", 5), *[
        ("a", 2, f"n{i}", "p", 10) for i in range(8)]), ranked=True)
    text = text_of(anonymize.anonymous_report(lines))
    shown = [line for line in text.splitlines() if line.startswith("- ")]
    assert [x.split()[1] for x in shown[:-1]] == [f"n{i}" for i in range(8)]
    assert "proyecto A concentra el 100%" in shown[-1] and text.count(ES["anon_lessons"]) == 1
    ordered = [r.lesson for r in anonymize.lessons(lines).orderBy("section", "rank").collect()]
    assert ["- " + lesson for lesson in ordered] == shown


def test_reports_to_files(spark, lines, tmp_path):
    for name, report in (("text", reports.report_text(lines)), ("json", reports.report_json(lines))):
        out = str(tmp_path / name)
        reports.write_reports(report, out, ["account", "period"])
        written = spark.read.text(out + "/account=norte/period=2026-07-01", wholetext=True)
        assert ("Map Tiles" in "".join(r.value for r in written.collect()))


def test_every_report_is_one_file_or_numbered_parts(spark, tmp_path):
    lines = (spark.range(600).select(F.col("id").alias("report"), F.explode(F.sequence(F.lit(1), F.when(
                F.col("id") == 7, 3000).otherwise(F.col("id") % 5 + 1))).alias("line"))
             .withColumn("text", F.concat(F.lit("line "), "line", F.lit(" of "), "report")))
    out = str(tmp_path / "out")
    reports.write_reports(lines.repartition(7), out, ["report"], most_chars=9000, ranges=11)
    files = spark.read.text(out, wholetext=True).select("report", "part", "value").collect()
    assert len({(f.report, f.part) for f in files}) == len(files)
    got = {}
    for f in sorted(files, key=lambda f: (f.report, f.part)):
        got[f.report] = got.get(f.report, "") + f.value
    assert got == {n: "".join(f"line {k} of {n}\n" for k in range(1, (3000 if n == 7 else n % 5 + 1) + 1))
                   for n in range(600)}
    parts = [len(f.value) for f in files if f.report == 7]
    assert len(parts) == -(-sum(parts) // 9000) and max(parts) < 9100
    assert {f.part for f in files if f.report != 7} == {0}


def test_amount_formats(spark):
    values = [8765.0, 349.6, 1050.0, 15500.0, 0.0, -2345678.0, 0.5]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    v = F.col("v")
    got = [tuple(r)[1:] for r in df.select(
        "i", coarse_amount(v), money(v), signed_money(v), percent(v)).orderBy("i").collect()]
    assert [g[0] for g in got] == ["8.800", "350", "1.000", "16.000", "0", "2.300.000", "0"]
    assert got[0][1:3] == ("$8.765", "+$8.765")
    assert got[5][2:] == ("-$2.345.678", "-2345678")
    assert got[6][3] == "0"


def test_letters_never_repeat(spark):
    names = [r.name for r in spark.range(1, 20_000).select(letters(F.col("id")).alias("name"))
             .collect()]
    assert names[:2] == ["A", "B"] and names[25:28] == ["Z", "AA", "AB"]
    assert len(set(names)) == len(names)


def test_anonymous_report(lines):
    assert text_of(anonymize.anonymous_report(lines, alias="una cooperativa", sector="agro")) == "\n".join([
        "## Por qué cambió la factura de una cooperativa (agro)", "",
        "**La cuenta subió 30% en un mes: de ~$5.500 a ~$7.100.**", "", "Qué movió la cuenta:",
        "1. **Map Tiles** +$1.400 — 86% del aumento", "2. **Stream Hub** (nuevo) +$950 — 58% del aumento",
        "", "Lo que se aprende:",
        "- Map Tiles mueve por sí solo más de la mitad del cambio: conviene medir su costo por unidad.",
        "- Stream Hub entró en la cuenta sin presupuesto: las altas deberían pasar por una aprobación.",
        "- proyecto A concentra el 65% del aumento: el costo debería repartirse por equipo.",
        "", "_Importes aproximados, sin nombres reales._", ""])


def test_anonymous_lines_and_aliases(lines):
    shown = anonymize.anonymize(lines)
    assert rows(shown.filter("grain = 'project'"), "label", "delta") == [
        ("proyecto A", "1.000"), ("proyecto B", "300"), ("proyecto C", "270")]
    assert rows(anonymize.project_aliases(lines), "project", "alias") == [
        ("cumbre", "proyecto C"), ("lago", "proyecto A"), ("puerto", "proyecto B")]


def test_breakdown_of_one_period(bills):
    assert anonymize.anonymous_breakdown(bills[0]).first().text == "\n".join([
        "## Por qué cambió la factura de un cliente", "", "**La cuenta del periodo suma ~$5.500.**", "",
        "En qué se gasta:", "1. **Batch Runner** ~$3.000 — 55% del total",
        "2. **Object Vault** ~$1.200 — 22% del total", "3. **Map Tiles** ~$800 — 15% del total", "",
        "_Importes aproximados, sin nombres reales._", ""])
