import datetime as dt
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from billweave.operators import findings, hooks, models, querycost, scorecard, spend, warehouse
from billweave.schema import (ANSWERS, JOB_LOG, MODEL_FILES, MODEL_META, PROJECT_ROOTS, QUERY_LOG,
                              RUBRIC, SCORES, SOURCE_META, SPEND_FACT, TABLE_CATALOG)
from billweave.sources import model_meta, sql_files
from billweave.sources.rubric import default_rubric, dimension_weights, read_rubric

TIB = 1 << 40


# ---- spend ------------------------------------------------------------------------------------

def test_month_bounds():
    day = dt.date
    assert spend.month_bounds(day(2026, 3, 15)) == (day(2026, 2, 1), day(2026, 3, 1),
                                                    day(2026, 3, 15))
    assert spend.month_bounds(day(2026, 1, 1)) == (day(2025, 12, 1), day(2026, 1, 1),
                                                   day(2026, 1, 2))


@pytest.fixture(scope="module")
def spend_fact(spark):
    rows_ = [("spike", "2026-02-10", "db", None, 300), ("spike", "2026-03-05", "db", "t", 200),
             ("flat", "2026-02-10", "db", "t", 100), ("flat", "2026-02-11", "web", "team$", 200),
             ("flat", "2026-02-12", "ml", "", 50), ("flat", "2026-02-12", "etl", "t", 49),
             ("flat", "2026-03-02", "db", "t", 100),
             ("new", "2026-03-02", "db", None, 5),
             ("late", "2026-02-28", "db", "t", 10), ("late", "2026-03-11", "db", "t", 9000),
             ("late", "2026-01-31", "db", "t", 9000)]
    return spark.createDataFrame(
        [(a, dt.date.fromisoformat(d), s, t, Decimal(c)) for a, d, s, t, c in rows_], SPEND_FACT)


def test_spend_rules(spend_fact):
    found = spend.spend_findings(spend_fact, dt.date(2026, 3, 11))
    assert rows(found.filter("code <> 'COS-TOP'"), "subject", "code", "severity", "metric") == [
        # 200 in 10 days -> 600 against 300; 300 of 300 without a team.
        ("flat", "AP-C04", "medium", 250 / 399), ("spike", "AP-C04", "medium", 1.0),
        ("spike", "COS-SPIKE", "high", 100.0)]
    assert found.filter("code = 'COS-SPIKE'").first().title == (
        "Costo proyectado del mes crece 100% vs mes anterior ($300 → ~$600)")
    top = found.filter("code = 'COS-TOP' AND subject = 'flat'")
    assert rows(top, "item") == [("db",), ("ml",), ("web",)]
    # Spend outside both months is not looked at.
    late = spend.spend_by_service(spend_fact, dt.date(2026, 3, 11)).filter("account = 'late'")
    assert rows(late, "last_month", "this_month") == [(10, None)]


def test_date_range_reaches_the_scan(spark, spend_fact, tmp_path):
    path = str(tmp_path / "spend")
    spend_fact.write.parquet(path)
    plan = (spend.spend_by_service(spark.read.parquet(path), dt.date(2026, 3, 11))
            ._jdf.queryExecution().executedPlan().toString())
    assert "GreaterThanOrEqual(used_at,2026-02-01)" in plan
    assert "LessThan(used_at,2026-03-11)" in plan


# ---- warehouse --------------------------------------------------------------------------------

def test_unpartitioned_tables(spark):
    catalog = spark.createDataFrame([
        ("p", "d", "at_limit", 10 * 10**9, False, None), ("p", "d", "small", 10**10 - 1, False,
                                                          False),
        ("p", "d", "timed", 10**12, True, False), ("p", "d", "ranged", 10**12, False, True),
        ("p", "d", "at_high", 100 * 10**9, None, None), ("p", "d", "huge", 10**11 + 1, False,
                                                         False),
        ("p", "d", "unknown", None, False, False)], TABLE_CATALOG)
    found = warehouse.catalog_findings(catalog)
    assert rows(found, "item", "severity") == [
        ("d.at_high", "medium"), ("d.at_limit", "medium"), ("d.huge", "high")]
    assert found.filter("item = 'd.at_limit'").first().title == (
        "Tabla d.at_limit (10.0 GB) sin particionar")


def test_heavy_users_are_counted_in_full(spark):
    as_of = dt.datetime(2026, 3, 31)
    jobs = [("p", f"u{i:02d}", (20 - i) * 10**12 // 5, as_of, "QUERY", "SELECT")
            for i in range(20)]
    jobs += [("p", "u00", 10**12, as_of - dt.timedelta(days=30), "QUERY", "SELECT"),
             ("p", "loader", 10**15, as_of, "LOAD", None), ("p", "writer", 10**15, as_of, "QUERY",
                                                             "INSERT"),
             ("q", "calm", 10**12, as_of, "QUERY", "SELECT")]
    log = spark.createDataFrame(jobs, JOB_LOG)
    # 15 users are above 1 TB; exactly 1 TB is not above.
    assert [(r.subject, r.title) for r in warehouse.job_findings(log, as_of).collect()] == [
        ("p", "15 usuarios/servicios facturaron >1 TB escaneado en 30 días (top: u00 → 4.0 TB)")]
    assert rows(warehouse.heavy_users(warehouse.job_usage(log, as_of), tb=3), "n_users") == [(5,)]


# ---- models -----------------------------------------------------------------------------------

WEATHER_YML = """\
version: 2
models:
  - name: daily_rain
    description: Rain by day and station
    columns:
      - name: day
      - name: millimetres
        tests: [not_null]
  - name: wind_gusts
  - name: fog
    description: Hours of fog
  - name: hail
    columns: [{name: size, tests: [unique]}]
sources:
  - name: stations
    freshness: {warn_after: {count: 6, period: hour}}
    tables: [{name: readings}]
  - name: maps
    tables: [{name: tiles}, {name: borders}]
  - name: lakes
    tables: [{name: levels}]
"""
BROKEN = {"syntax": "models: [unclosed", "list": "- just\n- a list\n", "date": "d: 2024-13-45", "empty": "",
          "number": "models: 5", "nested": "sources: [{name: s, tables: 7}]"}


@pytest.fixture(scope="module")
def projects(tmp_path_factory):
    base = tmp_path_factory.mktemp("projects")
    files = {
        "weather/dbt_project.yml": "name: weather\n",
        "weather/models/report/about.yml": WEATHER_YML,
        "weather/models/report/daily_rain.sql": "select day, millimetres from {{ ref('clean') }}",
        "weather/models/report/wind_gusts.sql": "SELECT\n  *\nFROM {{ ref('clean') }}",
        "weather/models/report/alerts.sql": "select id from {{ ref('daily_rain') }}",
        "weather/models/report/fog.sql": "select day, hours from {{ ref('clean') }}",
        "weather/models/report/hail.sql": "select * from {{ ref('raw_wind') }} where size > 0",
        "weather/models/staging/raw_wind.sql": "select gust, size from stations.readings",
        "weather/models/staging/clean.sql": "select * from stations.readings",
        "tidy/dbt_project.yml": "name: tidy\n",
        "tidy/models/only.sql": "select id from t",
        "tidy/models/only.yml": ("models:\n  - name: only\n    description: x\n    tests: [one]\n"
                                 "sources:\n  - name: s\n    tables: [{name: t, freshness: {x: 1}}]\n"),
        "unmarked/models/m.sql": "select * from t",
        **{f"weather/models/report/{name}_broken.yml": text for name, text in BROKEN.items()},
    }
    for path, text in files.items():
        (base / path).parent.mkdir(parents=True, exist_ok=True)
        (base / path).write_text(text, encoding="utf-8")
    return base


def _model_inputs(spark, projects, depth=1):
    base = str(projects)
    files = sql_files.read_model_files(spark, base, depth)
    parsed = model_meta.parse_schema_files(sql_files.read_schema_files(spark, base, depth))
    roots = sql_files.read_project_roots(spark, base, files.select("project"), depth)
    return files, model_meta.model_meta(parsed), model_meta.source_meta(parsed), roots


def test_model_rules_from_files(spark, projects):
    found = models.model_findings(*_model_inputs(spark, projects))
    assert rows(found, "subject", "code", "severity") == [
        ("unmarked", "DBT-00", "high"), ("weather", "AP-AI01", "medium"), ("weather", "AP-C02", "medium"),
        ("weather", "AP-G02", "high"), ("weather", "AP-G02b", "medium")]
    text = {r.code: (r.title, r.evidence) for r in found.filter("subject = 'weather'").collect()}
    assert text["AP-G02"] == ("Solo 29% de los modelos tiene tests (5/7 sin tests)",
                              "ej: alerts, clean, fog, raw_wind, wind_gusts")
    assert text["AP-G02b"][0] == "5/7 modelos sin descripción"
    assert text["AP-AI01"][0] == "Solo 1/4 sources con freshness configurado"
    assert text["AP-C02"] == ("2 modelos (fuera de staging) usan SELECT *", "ej: hail, wind_gusts")


def test_metadata_extraction_skips_only_broken_files(spark, projects):
    _, meta, sources, _ = _model_inputs(spark, projects)
    assert rows(meta) == [("tidy", "only", True, True), ("weather", "daily_rain", True, True),
                          ("weather", "fog", True, False), ("weather", "hail", False, True),
                          ("weather", "wind_gusts", False, False)]
    assert rows(sources) == [("tidy", "s", "t", True), ("weather", "lakes", "levels", False), ("weather", "maps", "borders", False),
                             ("weather", "maps", "tiles", False), ("weather", "stations", "readings", True)]
    odd = spark.createDataFrame([("p", None), ("p", "models: [{name: a}]")], "project string, yaml string")
    assert rows(model_meta.model_meta(model_meta.parse_schema_files(odd)), "name") == [("a",)]


@pytest.mark.parametrize("depth, folder, nested, marked", [
    (2, "team/river", None, True),           # two folders deep
    (1, "my river+lake", None, True),        # blanks and signs in the name
    (1, "river", "river/dbt_packages/river", False),   # a marker in a nested package only
])
def test_project_roots(spark, tmp_path, depth, folder, nested, marked):
    (tmp_path / folder / "models").mkdir(parents=True)
    (tmp_path / folder / "models" / "m.sql").write_text("select 1")
    (tmp_path / folder / "models" / "m.yml").write_text("models: [{name: m}]")
    root = tmp_path / (nested or folder)
    root.mkdir(parents=True, exist_ok=True)
    (root / "dbt_project.yml").write_text("name: x")
    files, meta, _, roots = _model_inputs(spark, tmp_path, depth)
    assert rows(files, "project", "path") == [(folder, "models/m.sql")]
    assert rows(meta, "project") == [(folder,)] and rows(roots) == [(folder, marked)]


def test_models_of_one_name_are_one_and_examples_stop_at_five(spark):
    files = spark.createDataFrame(
        [("p", f"models/{d}/m{i}.sql", f"m{i}", "select 1") for i in range(8) for d in "xy"],
        MODEL_FILES)
    meta = spark.createDataFrame([("p", "m0", False, True), ("p", "m0", True, False),
                                  ("p", "ghost", True, True)], MODEL_META)
    sources = spark.createDataFrame([("p", "s", "t", True), ("p", "s", "u", False)], SOURCE_META)
    roots = spark.createDataFrame([("p", True), ("bare", False)], PROJECT_ROOTS)
    assert rows(models.model_coverage(models.model_status(files, meta))) == [
        ("p", 8, 7, 7, 12.5, 0.875)]
    assert models.untested_models(files, meta).count() == 7
    assert models.undescribed_models(files, meta).count() == 7
    found = {r.code: r for r in models.model_findings(files, meta, sources, roots).collect()}
    # Half of the sources are fresh: not below the limit.
    assert set(found) == {"DBT-00", "AP-G02", "AP-G02b"}
    assert found["AP-G02"].evidence == "ej: m1, m2, m3, m4, m5"


def test_sql_files_are_found_once(spark, tmp_path):
    (tmp_path / "models").mkdir()
    (tmp_path / "a.sql").write_text("SELECT 1")
    (tmp_path / "models" / "b.sql").write_text("SELECT 2\nFROM t")
    (tmp_path / "no.txt").write_text("x")
    found = sql_files.read_sql_files(spark, [str(tmp_path), str(tmp_path / "a.sql"),
                                             str(tmp_path / "models")])
    assert sorted(r.sql for r in found.collect()) == ["SELECT 1", "SELECT 2\nFROM t"]


# ---- query cost -------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def priced(spark):
    log = spark.createDataFrame([
        ("a.sql", "SELECT 1", TIB, None), ("b.sql", "SELECT * FROM {{ ref('x') }}", TIB, None),
        ("c.sql", "{% if x %} select 1", TIB, "late"), ("d.sql", "SELEC oops", None, "syntax"),
        ("e.sql", "SELECT 2", TIB // 2, None), ("f.sql", "SELECT 3", 4 * TIB, None),
        ("g.sql", "SELECT 4", None, None)], QUERY_LOG).withColumn("suite", F.lit("s"))
    return querycost.price_queries(log).cache()


def test_prices(priced):
    got = {r.path: (float(r.usd), r.bytes_processed, r.skipped, r.error)
           for r in priced.collect()}
    assert got == {"a.sql": (6.25, TIB, "", ""), "b.sql": (0, 0, "jinja", ""),
                   "c.sql": (0, 0, "jinja", ""), "d.sql": (0, 0, "", "syntax"),
                   "e.sql": (3.12, TIB // 2, "", ""),     # half a cent goes to the even cent
                   "f.sql": (25.0, 4 * TIB, "", ""), "g.sql": (0, 0, "", "")}


@pytest.mark.parametrize("limit, exceeded", [(34.36, True), (34.37, False), (None, False)])
def test_gate(priced, limit, exceeded):
    assert rows(querycost.cost_gate(priced, ["suite"], limit)) == [("s", 34.37, 7, exceeded)]


def _whole(report):
    found = report.orderBy("line").collect()
    assert [r.line for r in found] == list(range(1, len(found) + 1))
    return "\n".join(r.text for r in found)


def test_cost_reports(priced):
    github = _whole(querycost.cost_report(priced, ["suite"], 20.0, "github"))
    assert "| Query | Escaneará | Costo estimado/run |" in github
    assert "| f.sql | 4.00 TiB | **$25.00** |" in github and "| a.sql | 1.00 TiB | $6.25 |" in github
    assert "| d.sql | error: syntax | — |" in github and "plantilla sin compilar" in github
    assert "Total por ejecución: $34.37 · umbral: $20.00 → excedido" in github
    text = _whole(querycost.cost_report(priced, ["suite"], None))
    assert "umbral" not in text and "**" not in text and "$6.25/TiB" in text
    dear = _whole(querycost.cost_report(priced, ["suite"], usd_per_tib=8))
    assert "$8/TiB" in dear


@pytest.mark.parametrize("ranges", [1, 9])
def test_cost_report_of_a_split_group(priced, ranges):
    whole = _whole(querycost.cost_report(priced, ["suite"], 20.0))
    assert _whole(querycost.cost_report(priced, ["suite"], 20.0, ranges=ranges)) == whole


# ---- scorecard and findings -------------------------------------------------------------------

def test_default_rubric(spark):
    rubric = default_rubric(spark)
    texts = {lang: {r.text for r in default_rubric(spark, lang).collect()} for lang in ("es", "en")}
    assert len(texts["es"]) == len(texts["en"]) == 28 and not texts["es"] & texts["en"] and None not in texts["en"]
    assert rubric.count() == 28
    weights = dimension_weights(rubric)
    assert weights.count() == 7 and weights.agg(F.sum("weight")).first()[0] == 1
    assert rows(weights.filter("dimension = 'cost'"), "position", "max_points") == [(4, 10)]


def test_rubric_from_file(spark, tmp_path):
    path = tmp_path / "rubric.yaml"
    path.write_text("dimensions:\n  cost:\n    name: Cost\n    weight: 1.0\n"
                    "    criteria:\n      - {id: C-1, text: x}\n      - {id: C-2, text: y}\n"
                    "  empty:\n    name: None\n    weight: 0.5\n")
    assert rows(dimension_weights(read_rubric(spark, str(path))), "dimension", "max_points") == [
        ("cost", 4), ("empty", 0)]


def test_scores_and_weighted_mean(spark):
    rubric = spark.createDataFrame([(1, "speed", Decimal("0.6"), "s1", None, None),
                                    (1, "speed", Decimal("0.6"), "s2", None, None),
                                    (2, "care", Decimal("0.4"), "c1", None, None)], RUBRIC)
    given = spark.createDataFrame([("p", "s1", 2), ("p", "s2", 1), ("p", "c1", 0), ("r", "s1", 1)],
                                  ANSWERS)
    scores = scorecard.dimension_scores(given, rubric)
    assert rows(scores, "platform", "dimension", "score") == [
        ("p", "care", 0.0), ("p", "speed", 75.0), ("r", "speed", 25.0)]
    assert rows(scorecard.overall_scores(scores, rubric)) == [("p", 45.0), ("r", 25.0)]
    made = spark.createDataFrame([("x", "speed", 0, 0, 33.3), ("x", "care", 0, 0, 91.2),
                                  ("y", "care", 0, 0, 12.5), ("z", "unknown", 0, 0, 9.0)], SCORES)
    assert rows(scorecard.overall_scores(made, rubric)) == [("x", 56.5), ("y", 12.5), ("z", 0.0)]


@pytest.mark.parametrize("given", [[("p", "s1", 5)], [("p", "s1", 2), ("p", "s1", 2)], [("p", "s1", -1)]])
def test_answers_are_checked(spark, given):
    rubric = spark.createDataFrame([(1, "speed", Decimal("1"), "s1", None, None)], RUBRIC)
    with pytest.raises(Exception, match="not one answer of 0, 1 or 2: p s1"):
        scorecard.dimension_scores(spark.createDataFrame(given, ANSWERS), rubric).collect()


def test_own_rubrics_print_their_names(spark, tmp_path):
    path = tmp_path / "own.yaml"
    path.write_text("dimensions:\n  speed:\n    name: How fast\n    weight: 1\n"
                    "    criteria: [{id: s1, text: it is quick}]\n")
    rubric = read_rubric(spark, str(path))
    assert rows(rubric, "name", "text") == [("How fast", "it is quick")]
    scores = scorecard.dimension_scores(spark.createDataFrame([("p", "s1", 1)], ANSWERS), rubric)
    assert "  How fast         ██████████░░░░░░░░░░  50.0/100" in _whole(scorecard.scorecard_report(scores, rubric))


def _finding(spark, *given):
    return spark.createDataFrame(
        [(s, code, title, severity, "cost", evidence, fix, impact, "", None)
         for s, code, title, severity, evidence, fix, impact in given],
        "subject string, code string, title string, severity string, dimension string, "
        "evidence string, fix string, impact_usd string, item string, period date")


def test_scorecard_report(spark):
    scores = spark.createDataFrame([("p", "quality", 0, 0, 37.5), ("p", "scalability", 0, 0, 100.0)],
                                   SCORES)
    found = _finding(spark, ("p", "R-20", "Segundo", "low", "", "", ""),
                     ("p", "R-10", "Primero", "high", "fila 7", "corregir", "$45"),
                     ("q", "R-30", "Tercero", "odd", "", "", ""))
    report = scorecard.scorecard_report(scores, default_rubric(spark), found)
    text = {p: _whole(report.filter(F.col("platform") == p)) for p in ("p", "q")}
    assert text["p"] == "\n".join([
        "", "═══ SCORECARD ═══", "",
        "  Calidad          ███████░░░░░░░░░░░░░  37.5/100",
        "  Escalabilidad    ████████████████████ 100.0/100", "",
        "  GLOBAL            62.5/100", "", "─── Hallazgos (2) ───", "",
        "  🟠 [R-10] Primero", "       evidencia: fila 7", "       impacto: $45", "       fix: corregir",
        "  ⚪ [R-20] Segundo", ""])
    assert "GLOBAL" not in text["q"] and "  ⚪ [R-30] Tercero" in text["q"]
    plain = _whole(scorecard.scorecard_report(scores, default_rubric(spark)))
    assert "Hallazgos" not in plain and plain.count("\n") == 7


@pytest.mark.parametrize("ranges", [7, None])
def test_scorecard_lines_of_many_findings(spark, ranges):
    found = _finding(spark, *[("p", f"C{i:02d}", "t", "low", "e" * (i % 2), "", "") for i in range(25)])
    scores = spark.createDataFrame([("p", "cost", 0, 0, 62.5)], SCORES)
    text = _whole(scorecard.scorecard_report(scores, default_rubric(spark), found, ranges=ranges))
    assert [x[5:8] for x in text.splitlines() if "[C" in x] == [f"C{i:02d}" for i in range(25)]
    assert text.count("evidencia: e") == 12


def test_findings_together(spark, bills):
    found = _finding(spark, ("a", "X", "t", "low", "", "", ""), ("a", "Y", "t", "high", "", "", ""),
                     ("b", "Z", "t", "low", "", "", ""))
    assert rows(findings.high_severity_count(found)) == [("a", 1), ("b", 0)]
    assert [r.code for r in found.orderBy(*findings.by_severity()).collect()] == ["Y", "X", "Z"]
    both = findings.union_findings(found, found.drop("evidence"))
    assert both.count() == 6


def test_hooks(spark):
    found = _finding(spark, ("a", "R-10", "t", "high", "", "", ""))
    priced = hooks.apply_quantifiers(
        found, lambda df: df.withColumn("impact_usd", F.lit("about $12 a day")),
        lambda df: df.withColumn("code", F.lower("code")))
    line = priced.select("code", findings.finding_text().alias("text")).first()
    assert line.code == "r-10" and "impacto: about $12 a day" in line.text
    assert "impacto" not in found.select(findings.finding_text().alias("text")).first().text
    own, builtin = (lambda *a: "own"), (lambda *a: "builtin")
    assert hooks.choose({}, "default", {"default": builtin})() == "builtin"
    assert hooks.choose({"x": own}, "default", {"default": builtin})() == "own"
    assert hooks.choose({"x": own, "y": own}, "default", {"default": builtin})() == "builtin"
    assert hooks.render({"html": own}, "html", found, {}) == "own"
    with pytest.raises(KeyError, match="unknown 'pdf'"):
        hooks.render({"html": own}, "pdf", found, {})
