"""DuckDB SQL for the registered queries, written apart from the DataFrame code.

Only the printed phrases are shared. Text is built piece by piece in SQL.
"""

from __future__ import annotations

import string

from billweave.functions.wording import EN, ES
from billweave.sources.rubric import DIMENSIONS

NL = "chr(10)"


# ---- SQL pieces -------------------------------------------------------------------------------

def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def fill(template: str, **values: str) -> str:
    pieces = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            pieces.append(quoted(literal))
        if name is not None:
            pieces.append(f"CAST({values[name]} AS VARCHAR)")
    return "(" + " || ".join(pieces) + ")"


def usd(cents: str) -> str:
    return f"({cents}) / 100.0::DOUBLE"


def dotted(x: str) -> str:
    return f"replace(format('{{:,.0f}}', ({x})::DOUBLE), ',', '.')"


def money(x: str) -> str:
    return f"('$' || {dotted(x)})"


def signed(x: str) -> str:
    return f"((CASE WHEN {x} >= 0 THEN '+' ELSE '-' END) || {money(f'abs({x})')})"


def pct(x: str, digits: int = 0) -> str:
    return f"format('{{:.{digits}f}}', ({x})::DOUBLE)"


def two_figures(x: str) -> str:
    step = f"pow(10.0::DOUBLE, floor(log10(abs({x}))) - 1)"
    return (f"CASE WHEN {x} = 0 THEN 0.0::DOUBLE "
            f"ELSE round_even(abs({x}) / {step}, 0) * {step} END")


def coarse(x: str) -> str:
    return dotted(two_figures(x))


def left(text: str, width: int) -> str:
    return f"format('{{:<{width}}}', {text})"


def right(text: str, width: int) -> str:
    return f"format('{{:>{width}}}', {text})"


def letters(rank: str) -> str:
    """Enough for 702 projects."""
    def letter(n: str) -> str:
        return f"chr(CAST(65 + ({n}) % 26 AS INTEGER))"
    return (f"CASE WHEN {rank} <= 26 THEN {letter(f'{rank} - 1')} "
            f"ELSE {letter(f'({rank} - 27) // 26')} || {letter(f'({rank} - 27)')} END")


def with_ctes(*parts: str) -> str:
    """CTE groups and a final SELECT -> one statement."""
    *ctes, select = parts
    return "WITH " + ",\n".join(ctes) + "\n" + select


def by_line(statement: str, keys: str) -> str:
    """A statement with a column ``text`` -> one row per line of it."""
    return f"""
SELECT {keys}, unnest(range(1, len(parts) + 1)) AS line, unnest(parts) AS text
FROM (SELECT {keys}, string_split(text, {NL}) AS parts FROM ({statement}))"""


# ---- shared CTEs ------------------------------------------------------------------------------

SALES = """
sales AS (
  SELECT n_name AS account, CAST(date_trunc('month', l_shipdate) AS DATE) AS period,
         p_type AS service, c_mktsegment AS project, l_shipdate AS used_at,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS cost,
         CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS team_tag
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN part ON l_partkey = p_partkey)"""


def _line_ctes(pairs_of_months: str) -> str:
    """From keys (account, period, grain, key, cost) and a way to place months as before/after."""
    return pairs_of_months + """,
joined AS (
  SELECT coalesce(a.account, b.account) AS account, coalesce(a.period, b.period) AS period,
         coalesce(a.grain, b.grain) AS grain, coalesce(a.key, b.key) AS key,
         CAST(coalesce(b.cost, 0) AS BIGINT) AS before, CAST(coalesce(a.cost, 0) AS BIGINT) AS after,
         b.cost IS NULL AS is_new, a.cost IS NULL AS is_gone
  FROM later a FULL JOIN earlier b
    ON a.account = b.account AND a.period = b.period AND a.grain = b.grain AND a.key = b.key),
pairs AS (
  SELECT account, period, before AS total_before, after AS total_after,
         after - before AS total_delta,
         CASE WHEN before > 0 THEN round_even((after - before)::DOUBLE / before::DOUBLE * 100, 2)
         + 0.0 END AS growth_pct
  FROM joined WHERE grain = 'total' AND EXISTS (
    SELECT 1 FROM span WHERE span.account = joined.account
       AND joined.period > span.lo AND joined.period <= span.hi)),
lines AS (
  SELECT account, period, grain, key, before, after, after - before AS delta,
         CASE WHEN total_delta = 0 THEN 0.0::DOUBLE
              ELSE round_even((after - before)::DOUBLE / total_delta::DOUBLE * 100, 2) + 0.0 END
           AS share_pct,
         is_new, is_gone,
         CAST(sign(after - before) * sign(total_delta) AS INTEGER) AS side,
         total_before, total_after, total_delta, growth_pct
  FROM joined JOIN pairs USING (account, period) WHERE grain <> 'total'),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY account, period, grain
                               ORDER BY abs(delta) DESC, key) AS rank,
         CASE WHEN side = 1 THEN row_number() OVER (
           PARTITION BY account, period, grain, side ORDER BY abs(delta) DESC, key) END
           AS driver_rank,
         CASE WHEN side = -1 THEN row_number() OVER (
           PARTITION BY account, period, grain, side ORDER BY abs(delta) DESC, key) END
           AS counter_rank
  FROM lines)"""


KEYS = """
keys AS (
  SELECT account, period, 'service' AS grain, service AS key, CAST(sum(cost) AS BIGINT) AS cost
  FROM sales GROUP BY ALL
  UNION ALL
  SELECT account, period, 'project', project, CAST(sum(cost) AS BIGINT)
  FROM sales GROUP BY account, period, project
  UNION ALL
  SELECT account, period, 'total', '', CAST(sum(cost) AS BIGINT)
  FROM sales GROUP BY account, period)"""

PANEL = _line_ctes(SALES + "," + KEYS + """,
span AS (SELECT account, min(period) AS lo, max(period) AS hi FROM sales GROUP BY account),
later AS (SELECT * FROM keys),
earlier AS (SELECT account, CAST(period + INTERVAL 1 MONTH AS DATE) AS period, grain, key, cost
            FROM keys)""")

TWO_MONTHS = _line_ctes(SALES + "," + KEYS + """,
span AS (SELECT account, DATE '1900-01-01' AS lo, DATE '2900-01-01' AS hi FROM sales
         GROUP BY account),
later AS (SELECT * FROM keys WHERE period = DATE '2000-01-01'),
earlier AS (SELECT account, DATE '2000-01-01' AS period, grain, key, cost FROM keys
            WHERE period = DATE '1999-01-01')""")

LINE_COLUMNS = ("account, period, grain, key, before, after, delta, share_pct, is_new, is_gone, "
                "side, total_before, total_after, total_delta, growth_pct")


def finding(subject: str, code: str, title: str, severity: str, dimension: str, *,
            period: str = "CAST(NULL AS DATE)", item: str = "''", evidence: str = "''",
            fix: str = "", metric: str = "CAST(NULL AS DOUBLE)",
            threshold: str = "NULL") -> str:
    return (f"{subject} AS subject, {period} AS period, {item} AS item, '{code}' AS code, "
            f"{title} AS title, {severity} AS severity, '{dimension}' AS dimension, "
            f"{evidence} AS evidence, {quoted(fix)} AS fix, '' AS impact_usd, "
            f"CAST({metric} AS DOUBLE) AS metric, CAST({threshold} AS DOUBLE) AS threshold")


# ---- bill comparison --------------------------------------------------------------------------

def headline(say: dict[str, str]) -> str:
    before, after = money(usd("total_before")), money(usd("total_after"))
    verb = (f"CASE WHEN total_delta > 0 THEN {quoted(say['rose'])} "
            f"ELSE {quoted(say['fell'])} END")
    moved = fill(say["headline_moved"], before=before, after=after, verb=verb,
                 pct=pct("abs(growth_pct)", 1), delta=signed(usd("total_delta")))
    return (f"CASE WHEN growth_pct IS NULL THEN {fill(say['headline_no_base'], after=after)} "
            f"WHEN total_delta = 0 THEN {fill(say['headline_same'], after=after)} "
            f"ELSE {moved} END")


def label(say: dict[str, str]) -> str:
    return (f"CASE WHEN is_new THEN {fill(say['label_new'], key='key')} "
            f"WHEN is_gone THEN {fill(say['label_gone'], key='key')} ELSE key END")


def detail(say: dict[str, str]) -> str:
    both = fill(say["detail_both"], before=money(usd("before")), after=money(usd("after")))
    return (f"CASE WHEN is_new THEN {quoted(say['detail_new'])} "
            f"WHEN is_gone THEN {quoted(say['detail_gone'])} ELSE {both} END")


def direction(say: dict[str, str], down: str = "drop") -> str:
    return (f"CASE WHEN total_delta >= 0 THEN {quoted(say['rise'])} "
            f"ELSE {quoted(say[down])} END")


def _bill_findings() -> str:
    delta = signed(usd("delta"))
    spike = finding(
        "account", "BILL-01",
        fill(ES["BILL-01"], pct=pct("growth_pct"), before=money(usd("total_before")),
             after=money(usd("total_after"))),
        "'high'", "cost", period="period", item="key",
        evidence=fill(ES["BILL-01_evidence"], key="key", delta=delta), fix=ES["fix_BILL-01"],
        metric="growth_pct", threshold="25")
    new = finding(
        "account", "BILL-02",
        fill(ES["BILL-02"], key="key", pct=pct("share_pct"), delta=delta), "'medium'", "cost",
        period="period", item="key", fix=ES["fix_BILL-02"], metric="share_pct", threshold="10")
    project = finding(
        "account", "BILL-03", fill(ES["BILL-03"], key="key", pct=pct("share_pct")), "'medium'",
        "cost", period="period", item="key", fix=ES["fix_BILL-03"], metric="share_pct",
        threshold="60")
    return f"""bill_found AS (
  SELECT {spike} FROM ranked WHERE grain = 'service' AND rank = 1 AND growth_pct > 25
  UNION ALL
  SELECT {new} FROM ranked
  WHERE grain = 'service' AND total_delta > 0 AND is_new AND share_pct > 10
  UNION ALL
  SELECT {project} FROM ranked
  WHERE grain = 'project' AND total_delta > 0 AND driver_rank = 1 AND share_pct > 60)"""


def _one_rule(code: str) -> str:
    return with_ctes(PANEL, _bill_findings(), f"""
SELECT subject, period, item, severity, metric FROM bill_found WHERE code = '{code}'""")


STORY = "growth_pct IS NOT NULL AND total_delta <> 0"


def _report_text() -> str:
    move = signed(usd("delta"))
    row = fill(ES["driver_row"], i="driver_rank", label=left(label(ES), 24), delta=right(move, 10),
               pct=pct("share_pct"), detail=detail(ES))
    counter = fill(ES["counter_row"], key=left("key", 24), delta=right(move, 10))
    values = {"n": "n", "pct": pct("coverage"), "direction": direction(ES)}
    title = (f"CASE WHEN n = 1 THEN {fill(ES['one_driver'], **values)} "
             f"ELSE {fill(ES['many_drivers'], **values)} END")
    against = (f"CASE WHEN total_delta > 0 THEN {quoted(ES['fell'])} "
               f"ELSE {quoted(ES['rose'])} END")
    project = fill(ES["project_row"], key="leader", pct=pct("leader_share"),
                   direction=direction(ES))
    return with_ctes(PANEL, f"""
d AS (SELECT account, period, count(*) AS n,
             CAST(sum(CAST(share_pct AS DECIMAL(28,2))) AS DOUBLE) AS coverage,
             string_agg({row}, {NL} ORDER BY driver_rank) AS rows
      FROM ranked WHERE grain = 'service' AND driver_rank <= 3 GROUP BY account, period)""", f"""
c AS (SELECT account, period, string_agg({counter}, {NL} ORDER BY counter_rank) AS counters
      FROM ranked WHERE grain = 'service' AND counter_rank IS NOT NULL GROUP BY account, period)
""", """
p AS (SELECT account, period, key AS leader, share_pct AS leader_share
      FROM ranked WHERE grain = 'project' AND driver_rank = 1)""", f"""
SELECT account, period,
       {NL} || {quoted(ES['bill_banner'])} || {NL} || {NL} || {headline(ES)} ||
       CASE WHEN {STORY} AND n > 0 THEN {NL} || {NL} || {title} || {NL} || rows ELSE '' END ||
       CASE WHEN {STORY} AND counters IS NOT NULL THEN {NL} || {NL} ||
         {fill(ES['counter_title'], verb=against)} || {NL} || counters ELSE '' END ||
       CASE WHEN {STORY} AND abs(leader_share) >= 40 THEN {NL} || {NL} || {project} ELSE '' END
       || {NL} AS text
FROM pairs LEFT JOIN d USING (account, period) LEFT JOIN c USING (account, period)
     LEFT JOIN p USING (account, period)""")


def _report_markdown() -> str:
    row = fill(ES["md_row"], label=label(ES), before=money(usd("before")),
               after=money(usd("after")), delta=signed(usd("delta")), pct=pct("share_pct"))
    project = fill(ES["project_row_md"], key="leader", pct=pct("leader_share"),
                   direction=direction(ES))
    return with_ctes(PANEL, f"""
t AS (SELECT account, period, string_agg({row}, {NL} ORDER BY rank) AS rows
      FROM ranked WHERE grain = 'service' AND rank <= 5 GROUP BY account, period)""", """
p AS (SELECT account, period, key AS leader, share_pct AS leader_share
      FROM ranked WHERE grain = 'project' AND driver_rank = 1)""", f"""
SELECT account, period,
       {quoted(ES['md_title'])} || {NL} || {NL} ||
       {fill(ES['md_headline'], headline=headline(ES))} || {NL} ||
       CASE WHEN {STORY} THEN {NL} || {quoted(ES['md_columns'])} || {NL} ||
         {quoted(ES['md_rule'])} || {NL} || rows ELSE '' END ||
       CASE WHEN {STORY} AND abs(leader_share) >= 40 THEN {NL} || {NL} || {project} ELSE '' END
       || {NL} AS text
FROM pairs LEFT JOIN t USING (account, period) LEFT JOIN p USING (account, period)""")


def _report_json() -> str:
    def exact(name: str, value: str) -> str:
        return f"'\"{name}\":' || printf('%.2f', {value})"

    line = " || ',' || ".join([
        "'{\"key\":\"' || key || '\"'", exact("before", usd("before")),
        exact("after", usd("after")), exact("delta", usd("delta")),
        exact("pct_of_total_delta", "share_pct"),
        "'\"is_new\":' || is_new::VARCHAR", "'\"is_gone\":' || is_gone::VARCHAR || '}'"])
    growth = "'\"growth_pct\":' || coalesce(printf('%.2f', growth_pct), 'null')"
    return with_ctes(PANEL, f"""
SELECT account, period, grain, rank, {line} AS json FROM ranked
UNION ALL
SELECT account, period, 'total', 0, '{{' || {exact('total_before', usd('total_before'))} || ',' ||
       {exact('total_after', usd('total_after'))} || ',' ||
       {exact('delta', usd('total_delta'))} || ',' || {growth} || '}}' FROM pairs""")


MAJORITY = "(grain = 'service' AND rank = 1 AND share_pct > 50)"
NEWCOMER = "(grain = 'service' AND is_new AND share_pct > 10)"
CONCENTRATED = "(grain = 'project' AND driver_rank = 1 AND share_pct > 60)"


def _lessons() -> str:
    alias = fill(ES["project_alias"], letters=letters("rank"))
    texts = (fill(ES["lesson_majority"], key="key"), fill(ES["lesson_new"], key="key"),
             fill(ES["lesson_project"], alias=alias, pct=pct("share_pct")))
    selects = [f"SELECT account, period, CAST({i} AS INTEGER) AS section, rank, {text} AS lesson "
               f"FROM ranked WHERE {rule}"
               for i, (rule, text) in enumerate(zip((MAJORITY, NEWCOMER, CONCENTRATED), texts), 1)]
    return "lessons AS (" + " UNION ALL ".join(selects) + ")"


def _anonymous_report() -> str:
    row = fill(ES["anon_row"], i="driver_rank", key="key",
               new=f"CASE WHEN is_new THEN {quoted(ES['anon_new'])} ELSE '' END",
               sign="CASE WHEN delta >= 0 THEN '+' ELSE '-' END", delta=coarse(usd("delta")),
               pct=pct("abs(share_pct)"), direction=direction(ES, "saving"))
    title = ES["anon_title"].format(alias=ES["anon_alias"], sector=" (retail)")
    opening = fill(
        ES["anon_opening"],
        verb=f"CASE WHEN total_delta >= 0 THEN {quoted(ES['rose'])} ELSE {quoted(ES['fell'])} END",
        pct=f"coalesce({pct('abs(growth_pct)')} || '%', '—')",
        before=coarse(usd("total_before")), after=coarse(usd("total_after")))
    return with_ctes(PANEL, _lessons(), f"""
d AS (SELECT account, period, string_agg({row}, {NL} ORDER BY driver_rank) AS rows
      FROM ranked WHERE grain = 'service' AND driver_rank <= 3 GROUP BY account, period)""", f"""
l AS (SELECT account, period, string_agg('- ' || lesson, {NL} ORDER BY section, rank) AS lessons
      FROM lessons GROUP BY account, period)""", f"""
SELECT account, period,
       {quoted(title)} || {NL} || {NL} || {opening} || {NL} || {NL} ||
       {quoted(ES['anon_drivers'])} || coalesce({NL} || rows, '') ||
       coalesce({NL} || {NL} || {quoted(ES['anon_lessons'])} || {NL} || l.lessons, '') ||
       {NL} || {NL} || {quoted(ES['anon_note'])} || {NL} AS text
FROM pairs LEFT JOIN d USING (account, period) LEFT JOIN l USING (account, period)""")


TOP_SERVICES = """
top_services AS (
  SELECT account, period, rank, service, s.cost, t.cost AS total,
         CASE WHEN t.cost <> 0 THEN s.cost::DOUBLE / t.cost::DOUBLE * 100
              ELSE 0.0::DOUBLE END AS share_pct
  FROM (SELECT account, period, key AS service, cost,
               CAST(row_number() OVER (PARTITION BY account, period ORDER BY cost DESC, key)
                    AS INTEGER) AS rank
        FROM keys WHERE grain = 'service') s
  JOIN (SELECT account, period, cost FROM keys WHERE grain = 'total') t USING (account, period)
  WHERE rank <= 3)"""


def _anonymous_breakdown() -> str:
    row = fill(ES["anon_spot_row"], i="rank", key="service", cost=coarse(usd("cost")),
               pct=pct("share_pct"))
    title = ES["anon_title"].format(alias=ES["anon_alias"], sector="")
    total = fill(ES["anon_total"], total=coarse(usd("max(total)")))
    return with_ctes(SALES, KEYS, TOP_SERVICES, f"""
SELECT account, period,
       {quoted(title)} || {NL} || {NL} || {total} || {NL} || {NL} ||
       {quoted(ES['anon_spots'])} || {NL} || string_agg({row}, {NL} ORDER BY rank) ||
       {NL} || {NL} || {quoted(ES['anon_note'])} || {NL} AS text
FROM top_services GROUP BY account, period""")


# ---- spend ------------------------------------------------------------------------------------

SPEND = SALES + """,
spend AS (
  SELECT account, service,
         CAST(sum(cost) FILTER (used_at < TIMESTAMP '2000-06-01') AS BIGINT) AS last_month,
         CAST(sum(cost) FILTER (used_at >= TIMESTAMP '2000-06-01') AS BIGINT) AS this_month,
         CAST(sum(cost) FILTER (used_at < TIMESTAMP '2000-06-01' AND team_tag IS NULL)
              AS BIGINT) AS untagged
  FROM sales
  WHERE used_at >= TIMESTAMP '2000-05-01' AND used_at < TIMESTAMP '2000-06-15'
  GROUP BY account, service),
accounts AS (
  SELECT account, CAST(coalesce(sum(last_month), 0) AS BIGINT) AS last_month,
         CAST(coalesce(sum(this_month), 0) AS BIGINT) AS this_month,
         CAST(coalesce(sum(untagged), 0) AS BIGINT) AS untagged
  FROM spend GROUP BY account),
growth AS (
  SELECT *, this_month::DOUBLE / 14 * 30 AS projected,
         CASE WHEN last_month > 0 THEN
           (this_month::DOUBLE / 14 * 30 - last_month::DOUBLE) / last_month::DOUBLE * 100 END
           AS growth_pct
  FROM accounts),
untagged AS (
  SELECT account, untagged,
         CASE WHEN last_month > 0 THEN untagged::DOUBLE / last_month::DOUBLE END
           AS untagged_share
  FROM accounts),
top_spend AS (
  SELECT account, CAST(rank AS INTEGER) AS rank, service, last_month
  FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY last_month DESC, service)
               AS rank FROM spend WHERE last_month IS NOT NULL) WHERE rank <= 3)"""


def _spend_findings() -> str:
    def whole(column: str) -> str:
        return f"format('{{:,.0f}}', {usd(column)})"

    spike = finding("account", "COS-SPIKE",
                    fill(ES["COS-SPIKE"], pct=pct("growth_pct"), before=whole("last_month"),
                         after=whole("projected")),
                    "'high'", "cost", evidence=quoted(ES["COS-SPIKE_evidence"]),
                    fix=ES["fix_COS-SPIKE"], metric="growth_pct", threshold="20")
    tags = finding("account", "AP-C04", fill(ES["AP-C04"], pct=pct("untagged_share * 100")),
                   "'medium'", "cost", fix=ES["fix_AP-C04"], metric="untagged_share",
                   threshold="0.4")
    top = finding("account", "COS-TOP",
                  fill(ES["COS-TOP"], key="service", cost=whole("last_month")), "'low'", "cost",
                  item="service", metric=usd("last_month"))
    return f"""spend_found AS (
  SELECT {spike} FROM growth WHERE growth_pct > 20
  UNION ALL SELECT {tags} FROM untagged WHERE untagged_share > 0.4
  UNION ALL SELECT {top} FROM top_spend)"""


# ---- warehouse --------------------------------------------------------------------------------

CATALOG = """
big_tables AS (
  SELECT source AS dataset, CAST(doc_id AS VARCHAR) AS "table",
         n_chars * 10000000 AS num_bytes, n_chars * 10000000 / 1e9::DOUBLE AS size_gb
  FROM documents WHERE lang <> 'en' AND n_chars * 10000000 >= 10000000000)"""


def _catalog_findings() -> str:
    found = finding("'warehouse'", "AP-C01",
                    fill(ES["AP-C01"], dataset="dataset", table='"table"', gb=pct("size_gb", 1)),
                    "CASE WHEN size_gb > 100 THEN 'high' ELSE 'medium' END", "cost",
                    item="dataset || '.' || \"table\"",
                    evidence=fill(ES["AP-C01_evidence"], bytes="num_bytes"),
                    fix=ES["fix_AP-C01"], metric="size_gb", threshold="10")
    return f"catalog_found AS (SELECT {found} FROM big_tables)"


JOBS = """
usage AS (
  SELECT 'warehouse' AS project, CAST(user_id AS VARCHAR) AS "user",
         CAST(sum(CAST(round(value * 100) AS BIGINT) * 10000000) AS BIGINT) AS bytes_billed,
         count(*) AS jobs,
         CAST(sum(CAST(round(value * 100) AS BIGINT) * 10000000) AS BIGINT) / 1e12::DOUBLE
           AS tb_billed
  FROM events WHERE event_type IN ('view', 'click') AND ts > TIMESTAMP '2024-01-01'
  GROUP BY user_id),
top_users AS (
  SELECT "user", CAST(row_number() OVER (ORDER BY tb_billed DESC, "user") AS INTEGER) AS rank,
         tb_billed FROM usage QUALIFY rank <= 10),
heavy AS (
  SELECT 'warehouse' AS project, count(*) AS n_users,
         (SELECT "user" FROM top_users WHERE rank = 1) AS top_user, max(tb_billed) AS top_tb
  FROM usage WHERE tb_billed > 1 HAVING count(*) > 0)"""


def _job_findings() -> str:
    found = finding("'warehouse'", "AP-C02",
                    fill(ES["AP-C02_jobs"], n="n_users", tb="'1'", days="'30'", user="top_user",
                         top=pct("top_tb", 1)),
                    "'high'", "cost", item="top_user",
                    evidence=quoted(ES["AP-C02_jobs_evidence"].format(days=30)),
                    fix=ES["fix_AP-C02_jobs"], metric="top_tb", threshold="1")
    return f"job_found AS (SELECT {found} FROM heavy)"


# ---- models -----------------------------------------------------------------------------------

MODELS = """
labelled AS (SELECT d.source AS project, d.lang, CAST(d.doc_id AS VARCHAR) AS name, d.text,
                    l.quality, l.toxic
             FROM documents d LEFT JOIN labels l USING (doc_id)),
coverage AS (
  SELECT project, count(*) AS models,
         count(*) FILTER (quality IS DISTINCT FROM 1) AS untested,
         count(*) FILTER (quality IS NULL) AS undescribed,
         (count(*) FILTER (quality = 1)) * 100 / count(*)::DOUBLE AS coverage_pct,
         (count(*) FILTER (quality IS NULL)) / count(*)::DOUBLE AS undescribed_share
  FROM labelled GROUP BY project),
freshness AS (
  SELECT project, count(*) AS tables, count(quality) AS fresh,
         count(quality) / count(*)::DOUBLE AS fresh_share
  FROM labelled GROUP BY project),
starred AS (
  SELECT project, 'models/marts/' || name || '.sql' AS path, name FROM labelled
  WHERE project <> 'src0' AND regexp_matches(text, '(?i)licen[sc]e'))"""


def _model_findings() -> str:
    def five(where: str, order: str, rows: str = "labelled") -> str:
        return (f"(SELECT project, string_agg(name, ', ' ORDER BY {order}) AS names FROM "
                f"(SELECT project, name, {order}, row_number() OVER (PARTITION BY project "
                f"ORDER BY {order}) AS n FROM {rows} WHERE {where}) WHERE n <= 5 "
                "GROUP BY project)")

    evidence = fill(ES["examples"], names="names")
    lost = finding("'src7'", "DBT-00", fill(ES["DBT-00"], project="'src7'"), "'high'",
                   "architecture", evidence="'src7'")
    tests = finding("project", "AP-G02",
                    fill(ES["AP-G02"], pct=pct("coverage_pct"), untested="untested", all="models"),
                    "CASE WHEN coverage_pct < 30 THEN 'high' ELSE 'medium' END", "quality",
                    evidence=evidence, fix=ES["fix_AP-G02"], metric="coverage_pct",
                    threshold="60")
    docs = finding("project", "AP-G02b",
                   fill(ES["AP-G02b"], undescribed="undescribed", all="models"), "'medium'",
                   "governance", evidence=evidence, fix=ES["fix_AP-G02b"],
                   metric="undescribed_share", threshold="0.5")
    stale = finding("project", "AP-AI01", fill(ES["AP-AI01"], fresh="fresh", all="tables"),
                    "'medium'", "ai_readiness", fix=ES["fix_AP-AI01"], metric="fresh_share",
                    threshold="0.5")
    stars = finding("project", "AP-C02", fill(ES["AP-C02_models"], n="n"), "'medium'", "cost",
                    evidence=evidence, fix=ES["fix_AP-C02_models"], metric="n")
    return f"""model_found AS (
  SELECT {lost} WHERE EXISTS (SELECT 1 FROM documents WHERE source = 'src7')
  UNION ALL SELECT {tests} FROM coverage
    JOIN {five("quality IS DISTINCT FROM 1", "name")} USING (project)
    WHERE coverage_pct < 60 AND project <> 'src7'
  UNION ALL SELECT {docs} FROM coverage JOIN {five("quality IS NULL", "name")} USING (project)
    WHERE undescribed_share > 0.5 AND project <> 'src7'
  UNION ALL SELECT {stale} FROM freshness WHERE fresh_share < 0.5 AND project <> 'src7'
  UNION ALL SELECT {stars} FROM (SELECT project, count(*) AS n FROM starred GROUP BY project)
    JOIN {five("true", "path", "starred")} USING (project) WHERE project <> 'src7')"""


# ---- query cost -------------------------------------------------------------------------------

PRICED = """
priced AS (
  SELECT source AS suite, source || '/' || CAST(doc_id AS VARCHAR) || '.sql' AS path,
         CASE WHEN counted THEN n_chars * 1000000000 ELSE 0 END AS bytes_processed,
         CASE WHEN counted
              THEN round_even(n_chars * 1000000000 / 1099511627776.0::DOUBLE * 6.25::DOUBLE, 2)
              ELSE 0.0::DOUBLE END AS usd,
         CASE WHEN lang = 'es' THEN 'jinja' ELSE '' END AS skipped,
         CASE WHEN lang <> 'es' AND toxic = 1 THEN 'syntax' ELSE '' END AS error
  FROM (SELECT *, lang <> 'es' AND coalesce(toxic, 0) <> 1 AS counted
        FROM documents LEFT JOIN labels USING (doc_id))),
gate AS (
  SELECT suite, CAST(sum(CAST(usd AS DECIMAL(18,2))) AS DOUBLE) AS total_usd,
         count(*) AS n_rows,
         CAST(sum(CAST(usd AS DECIMAL(18,2))) AS DOUBLE) > 500 AS exceeded
  FROM priced GROUP BY suite)"""

SCANS = f"""CASE WHEN skipped <> '' THEN {quoted(ES['query_skipped'])}
  WHEN error <> '' THEN {fill(ES['query_error'], error='error')}
  ELSE {pct('bytes_processed / 1099511627776.0::DOUBLE', 2)} || ' TiB' END"""


def costs(limit: float) -> str:
    price = "'$' || format('{:,.2f}', usd)"
    return (f"CASE WHEN skipped <> '' OR error <> '' THEN '—' "
            f"WHEN usd > {limit} THEN '**' || {price} || '**' ELSE {price} END")


def _cost_report(style: str) -> str:
    plain = f"replace({costs(500)}, '**', '')"
    total = (f"{fill(ES['query_total'], total=dollars('total_usd'))} || " + fill(
        ES["query_limit"], limit="'$500.00'",
        state=(f"CASE WHEN exceeded THEN {quoted(ES['query_over'])} "
               f"ELSE {quoted(ES['query_ok'])} END")))
    note = ES["query_note"].format(price="6.25")
    if style == "text":
        row = (f"'  ' || {left('path', 48)} || ' ' || {left(SCANS, 14)} || ' ' || "
               f"{right(plain, 10)}")
        head = f"{NL} || {quoted(ES['query_banner'])} || {NL} || {NL}"
        foot = f"'  ' || {total} || {NL} || {quoted('  ' + note)}"
    else:
        row = f"'| ' || path || ' | ' || {SCANS} || ' | ' || {costs(500)} || ' |'"
        head = (f"{quoted(ES['query_md_title'])} || {NL} || {NL} || "
                f"{quoted(ES['query_md_columns'])} || {NL} || {quoted(ES['query_md_rule'])} "
                f"|| {NL}")
        foot = f"{total} || {NL} || {quoted('_' + note + '_')}"
    return with_ctes(PRICED, f"""
rows AS (SELECT suite, string_agg({row}, {NL} ORDER BY path) AS rows FROM priced
         GROUP BY suite)""", f"""
SELECT suite,
       {head} || rows || {NL} || {NL} || {foot} || {NL} AS text
FROM rows JOIN gate USING (suite)""")


def dollars(x: str) -> str:
    return f"('$' || format('{{:,.2f}}', {x}))"


# ---- scorecard --------------------------------------------------------------------------------

RUBRIC = "rubric(position, dimension, weight, criterion_id, number) AS (VALUES " + ", ".join(
    f"({place}, '{dimension}', CAST({weight} AS DECIMAL(6,4)), '{criterion}', {number})"
    for number, (place, dimension, weight, criterion) in enumerate(
        (place, dimension, weight, criterion)
        for place, (dimension, weight, criteria) in enumerate(DIMENSIONS, 1)
        for criterion in criteria)) + ")"

SCORES = RUBRIC + """,
answers AS (
  SELECT CAST(user_id AS VARCHAR) AS platform, event_id % 28 AS number,
         arg_max(CAST(floor(value) AS BIGINT) % 3, event_id) AS answer
  FROM events GROUP BY 1, 2),
limits AS (SELECT dimension, min(position) AS position, min(weight) AS weight,
                  count(*) * 2 AS max_points FROM rubric GROUP BY dimension),
scores AS (
  SELECT platform, dimension, CAST(sum(answer) AS BIGINT) AS points,
         max(max_points) AS max_points,
         round_even(sum(answer)::DOUBLE / max(max_points)::DOUBLE * 100, 1) AS score
  FROM answers JOIN rubric USING (number) JOIN limits USING (dimension)
  GROUP BY platform, dimension),
overall AS (
  SELECT platform, round_even(CAST(sum(CAST(score AS DECIMAL(5,1)) * weight) AS DOUBLE)
                              / CAST(sum(weight) AS DOUBLE), 1) AS overall
  FROM scores JOIN limits USING (dimension) GROUP BY platform)"""


def _cards() -> str:
    name = "CASE dimension " + " ".join(
        f"WHEN '{d}' THEN {quoted(ES['dim_' + d])}" for d, *_ in DIMENSIONS) + " END"
    filled = "CAST(floor(score / 5) AS INTEGER)"
    row = fill(ES["card_row"], name=left(name, 16),
               bar=f"repeat('█', {filled}) || repeat('░', 20 - {filled})",
               score="format('{:5.1f}', score)")
    return f"""
cards AS (
  SELECT platform, string_agg({row}, {NL} ORDER BY position) || {NL} || {NL} || '  ' ||
         {quoted(f"{ES['card_overall']:<16}")} || ' ' ||
         format('{{:5.1f}}', max(overall)) || '/100' AS card
  FROM scores JOIN limits USING (dimension) JOIN overall USING (platform) GROUP BY platform)"""


CARD_HEAD = f"{NL} || {quoted(ES['card_banner'])} || {NL}"

RANK = ("CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 "
        "WHEN 'low' THEN 3 ELSE 9 END")


def finding_text() -> str:
    icon = "CASE severity WHEN 'critical' THEN '🔴' WHEN 'high' THEN '🟠' WHEN 'medium' THEN '🟡' ELSE '⚪' END"

    def part(name: str, column: str) -> str:
        return (f"CASE WHEN {column} <> '' THEN {NL} || {fill(ES[name], text=column)} "
                "ELSE '' END")
    return (f"{icon} || ' [' || code || '] ' || title || {part('evidence', 'evidence')} || "
            f"{part('impact', 'impact_usd')} || {part('fix', 'fix')}")


def _scorecard_with_findings() -> str:
    row = f"'  ' || replace({finding_text()}, {NL}, {NL} || '  ')"
    return with_ctes(SCORES, _cards(), SPEND, _spend_findings(), f"""
listed AS (SELECT subject AS platform, count(*) AS n,
                  string_agg({row}, {NL} ORDER BY {RANK}, code, item) AS rows
           FROM spend_found GROUP BY subject)""", f"""
SELECT platform,
       {CARD_HEAD} || coalesce({NL} || card, '') ||
       coalesce({NL} || {NL} || {fill(ES['card_findings'], n='n')} || {NL} || {NL} || rows, '')
       || {NL} AS text
FROM cards FULL JOIN listed USING (platform)""")


ALL_FOUND = [PANEL, _bill_findings(), SPEND.replace(SALES + ",", "", 1), _spend_findings(),
             CATALOG, _catalog_findings(), JOBS, _job_findings(), MODELS, _model_findings(), """
every AS (FROM bill_found UNION ALL FROM spend_found UNION ALL FROM catalog_found
          UNION ALL FROM job_found UNION ALL FROM model_found)"""]


# ---- exports ----------------------------------------------------------------------------------

# What the derived exports must come to, taken from the numbers they were written from: line
# numbers 6 and 7 became total rows, quantities 1 and 2 unreadable costs.
EXPORTS = """
kept AS (
  SELECT p_type AS service, l_returnflag AS flag, l_linenumber % 2 = 0 AS even, l_quantity,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
         l_quantity NOT IN (1, 2) AS readable
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber NOT IN (6, 7)),
exported AS (
  SELECT 'gcp-cost-table' AS source_format, service, flag AS project, cents FROM kept WHERE readable
  UNION ALL SELECT 'aws-cur', service, flag, cents FROM kept WHERE readable
  UNION ALL SELECT 'generic', service, flag, cents FROM kept WHERE readable
  UNION ALL SELECT 'aws-ce', service, '',
                   CASE WHEN readable THEN cents WHEN even THEN 500 ELSE 700 END FROM kept)"""


CSV_FILES = """
kept AS (
  SELECT p_type AS service, l_returnflag AS flag, l_orderkey AS number,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
         l_quantity NOT IN (1, 2) AS readable
  FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE l_linenumber NOT IN (6, 7) AND l_orderkey % 7 <> 0),
parsed AS (
  SELECT 'gcp-cost-table' AS source_format, service, flag AS project, cents FROM kept WHERE readable
  UNION ALL SELECT 'aws-cur', service, flag, cents FROM kept WHERE readable
  UNION ALL SELECT 'generic', service, flag, cents FROM kept WHERE readable
  UNION ALL SELECT 'aws-ce', service, '', CASE WHEN readable THEN cents WHEN number % 5 = 0 THEN 200
                                              ELSE 300 END FROM kept)"""


def _export(source_format: str) -> str:
    return with_ctes(EXPORTS, f"""
SELECT source_format, service, project, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cost_cents
FROM exported WHERE source_format = '{source_format}' GROUP BY ALL""")


DATED_CATALOG = """
dated AS (
  SELECT 'warehouse' AS project, source AS dataset, doc_id::VARCHAR AS "table", doc_id,
         n_chars * 1000 AS num_bytes, DATE '2024-03-01' - (doc_id * 37 % 500 - 20)::INTEGER AS created
  FROM documents),
reads AS (
  SELECT DISTINCT doc, ts::DATE AS day
  FROM (SELECT user_id AS doc, ts FROM events UNION ALL SELECT event_id * 13 % 1201, ts FROM events))"""

# Cents by weight, rounded down; those left over go to the largest remainders.
PARTS = """
lines AS (
  SELECT l_returnflag AS suite, l_orderkey AS query, p_type AS component,
         sum(CASE WHEN l_linenumber = 7 THEN 0 ELSE l_quantity::BIGINT END)::BIGINT AS bytes
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
costs AS (
  SELECT l_returnflag AS suite, l_orderkey AS query, sum(round(l_extendedprice * 100)::BIGINT)::HUGEINT AS cents
  FROM lineitem GROUP BY ALL),
weights AS (
  SELECT *, CASE WHEN sum(bytes) OVER q > 0 THEN bytes ELSE 1 END AS weight,
         CASE WHEN sum(bytes) OVER q > 0 THEN sum(bytes) OVER q ELSE count(*) OVER q END AS whole
  FROM lines JOIN costs USING (suite, query) WINDOW q AS (PARTITION BY suite, query)),
shares AS (SELECT *, cents * weight // whole AS down, cents * weight % whole AS fraction FROM weights),
parts AS (
  SELECT suite, query, component, bytes, CASE WHEN suite = 'R' THEN -1 ELSE 1 END *
         (down + CASE WHEN row_number() OVER (PARTITION BY suite, query ORDER BY fraction DESC, component)
                           <= cents - sum(down) OVER (PARTITION BY suite, query) THEN 1 ELSE 0 END)::BIGINT AS cents
  FROM shares)"""


def oracle_queries() -> dict[str, str]:
    panel = lambda select: with_ctes(PANEL, select)
    delta = usd("delta")
    project_alias = fill(ES["project_alias"], letters=letters("rank"))
    yearly = money(usd("after * 12"))
    return {
        "normalize_gcp": _export("gcp-cost-table"),
        "normalize_cur": _export("aws-cur"),
        "normalize_cost_explorer": _export("aws-ce"),
        "normalize_generic": _export("generic"),
        "union_of_formats": with_ctes(EXPORTS, """
SELECT source_format, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cost_cents
FROM exported GROUP BY source_format"""),
        "csv_files": with_ctes(CSV_FILES, """
SELECT source_format, service, project, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cost_cents
FROM parsed GROUP BY ALL"""),
        "table_idleness": with_ctes(DATED_CATALOG, """
asked AS (
  SELECT project, dataset, "table", doc_id, snapshot
  FROM dated, (VALUES (DATE '2024-01-10'), (DATE '2024-02-20'), (DATE '2024-04-15')) s(snapshot)),
found AS (
  SELECT project, dataset, "table", snapshot, max(day) AS last_read
  FROM asked LEFT JOIN reads ON doc = doc_id AND day <= snapshot GROUP BY ALL)""", """
SELECT *, (snapshot - last_read)::INTEGER AS idle_days,
       CASE WHEN last_read IS NULL THEN 'never' WHEN snapshot - last_read >= 90 THEN 'zombie'
            WHEN snapshot - last_read >= 30 THEN 'idle' ELSE 'used' END AS state
FROM found"""),
        "retention_bands": with_ctes(DATED_CATALOG, """
last AS (SELECT doc, max(day) AS last_read FROM reads WHERE day <= DATE '2024-03-01' GROUP BY doc),
days AS (
  SELECT project, num_bytes, last_read, DATE '2024-03-01' - created AS age,
         DATE '2024-03-01' - coalesce(last_read, created) AS idle
  FROM dated LEFT JOIN last ON doc = doc_id),
bands AS (
  SELECT * FROM (VALUES (0, 7, 'hot'), (7, 30, 'warm'), (30, 90, 'cold'), (90, 365, 'archive'),
                        (365, 1000000, 'delete')) b(lower, upper, action))""", """
SELECT project, a.action AS age_action, i.action AS action, count(*) AS n_tables,
       sum(num_bytes)::BIGINT AS num_bytes, count(*) FILTER (last_read IS NULL) AS n_never_read
FROM days LEFT JOIN bands a ON age >= a.lower AND age < a.upper
  LEFT JOIN bands i ON idle >= i.lower AND idle < i.upper
GROUP BY ALL"""),
        "repartition_check": """
SELECT l_shipdate::DATE AS day, count(*) AS rows_before, count(*) AS rows_after, 'equal' AS state
FROM lineitem GROUP BY ALL""",
        "component_parts": with_ctes(PARTS, "SELECT * FROM parts"),
        "component_costs": with_ctes(PARTS, """
SELECT suite, component, count(*) AS n_queries, sum(bytes)::BIGINT AS bytes, sum(cents)::BIGINT AS cents
FROM parts GROUP BY ALL"""),
        "csv_line_breaks": """
SELECT p_type || chr(10) || 'line ' || l_linenumber AS service,
       'unit "' || l_linenumber || '"' || chr(10) || chr(10) || ',x' AS project,
       count(*) AS n, CAST(sum(cents) AS BIGINT) AS cost_cents
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p_partkey,
             sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents
      FROM lineitem GROUP BY l_orderkey, l_linenumber) JOIN part USING (p_partkey)
GROUP BY ALL""",
        "rejected_cells": """
WITH lines AS (
  SELECT p_type AS service, l_orderkey % 7 = 0 AS short,
         CASE l_quantity WHEN 1 THEN 'n/a' WHEN 2 THEN 'nan' END AS cell
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber NOT IN (6, 7)),
bad AS (
  SELECT format, service, CASE WHEN short THEN '' ELSE cell END AS cell
  FROM lines, (VALUES ('gcp-cost-table'), ('aws-cur'), ('generic')) f(format)
  WHERE CASE WHEN short THEN format <> 'aws-cur' ELSE cell IS NOT NULL END
  UNION ALL SELECT 'aws-ce', service, NULL FROM lines WHERE short)
SELECT format AS source_format, service, cell,
       CASE WHEN coalesce(cell, '') = '' THEN 'missing' ELSE 'not a number' END AS reason, count(*) AS n
FROM bad GROUP BY ALL""",
        "parsed_cells": """
SELECT l_returnflag AS project,
       CASE WHEN l_quantity IN (1, 2) THEN 'not a number' WHEN l_quantity IN (3, 7) THEN 'missing'
            WHEN l_quantity = 4 THEN 'out of range' END AS reason,
       count(*) AS n,
       CAST(sum(CASE WHEN l_quantity < 5 OR l_quantity = 7 THEN NULL WHEN l_quantity = 5 THEN 0
                     WHEN l_quantity = 6 THEN -1 ELSE 1 END
                * CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents
FROM lineitem GROUP BY ALL""",
        "parse_money": """
SELECT ' ' || l_returnflag || ' ' AS project, count(*) AS n,
       count(*) FILTER (l_quantity NOT IN (1, 2)) AS n_parsed,
       CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT))
            FILTER (l_quantity NOT IN (1, 2)) AS BIGINT) AS cents
FROM lineitem GROUP BY l_returnflag""",
        "total_rows": """
SELECT ' ' || l_returnflag || ' ' AS project,
       count(*) FILTER (l_linenumber IN (6, 7)) AS n_total_rows
FROM lineitem GROUP BY l_returnflag""",
        "total_cost": with_ctes(SALES, """
SELECT account, period, CAST(sum(cost) AS BIGINT) AS cost FROM sales GROUP BY account, period"""),
        "cost_by_service": with_ctes(SALES, """
SELECT account, period, service, CAST(sum(cost) AS BIGINT) AS cost
FROM sales GROUP BY account, period, service"""),
        "cost_by_project": with_ctes(SALES, """
SELECT account, period, project, CAST(sum(cost) AS BIGINT) AS cost
FROM sales WHERE project <> '' GROUP BY account, period, project"""),
        "cost_by_grain": with_ctes(SALES, KEYS, "SELECT account, period, grain, key, cost FROM keys"),
        "pair_totals": panel("SELECT account, period, total_before, total_after, total_delta, "
                             "growth_pct FROM pairs"),
        "delta_lines": panel(f"SELECT {LINE_COLUMNS} FROM lines"),
        "ranked_lines": panel("SELECT account, period, grain, key, delta, rank, driver_rank, "
                              "counter_rank FROM ranked"),
        "diff_two_months": with_ctes(TWO_MONTHS, f"SELECT {LINE_COLUMNS} FROM lines"),
        "diff_two_totals": with_ctes(TWO_MONTHS, "SELECT account, period, total_before, "
                                     "total_after, total_delta, growth_pct FROM pairs"),
        "drivers": panel("SELECT account, period, CAST(driver_rank AS INTEGER) AS position, key, "
                         "delta, share_pct FROM ranked "
                         "WHERE grain = 'service' AND driver_rank <= 3"),
        "counter_movers": panel("SELECT account, period, key, delta, share_pct FROM lines "
                                "WHERE grain = 'service' AND side = -1"),
        "top_project": panel("SELECT account, period, key, delta, share_pct FROM ranked "
                             "WHERE grain = 'project' AND driver_rank = 1"),
        "driver_coverage": panel("""
SELECT account, period, count(*) AS n_drivers,
       CAST(sum(CAST(share_pct AS DECIMAL(28,2))) AS DOUBLE) AS coverage_pct
FROM ranked WHERE grain = 'service' AND driver_rank <= 3 GROUP BY account, period"""),
        "top_services": with_ctes(SALES, KEYS, TOP_SERVICES, "SELECT * FROM top_services"),
        "money_formats": panel(f"""
SELECT account, period, grain, key, {money(usd('after'))} AS after_text,
       {signed(delta)} AS delta_text,
       {pct('share_pct')} AS share, {coarse(delta)} AS coarse, {label(ES)} AS label,
       {detail(ES)} AS detail
FROM lines"""),
        "headlines": panel(f"SELECT account, period, {headline(ES)} AS headline, "
                           f"{headline(EN)} AS headline_en FROM pairs"),
        "bill_findings": with_ctes(PANEL, _bill_findings(), "SELECT * FROM bill_found"),
        "bill_spike": _one_rule("BILL-01"),
        "bill_new_service": _one_rule("BILL-02"),
        "bill_project_share": _one_rule("BILL-03"),
        "report_text": by_line(_report_text(), "account, period"),
        "report_markdown": _report_markdown(),
        "report_json": _report_json(),
        "anonymous_lines": panel(f"""
SELECT account, period, grain, rank,
       CASE WHEN grain = 'project' THEN {project_alias} ELSE key END AS label,
       {coarse(usd('before'))} AS before_text, {coarse(usd('after'))} AS after_text,
       {coarse(delta)} AS delta_text, side, {pct('abs(share_pct)')} AS share, is_new, is_gone
FROM ranked"""),
        "project_aliases": panel(f"SELECT account, period, key AS project, {project_alias} AS alias "
                                 "FROM ranked WHERE grain = 'project'"),
        "lessons": with_ctes(PANEL, _lessons(), "SELECT * FROM lessons"),
        "anonymous_report": by_line(_anonymous_report(), "account, period"),
        "anonymous_breakdown": _anonymous_breakdown(),
        "spend_by_service": with_ctes(SPEND, "SELECT * FROM spend"),
        "spend_by_account": with_ctes(SPEND, "SELECT * FROM accounts"),
        "projected_growth": with_ctes(SPEND, "SELECT account, last_month, this_month, projected, "
                                      "growth_pct FROM growth"),
        "untagged_share": with_ctes(SPEND, "SELECT * FROM untagged"),
        "top_spend_services": with_ctes(SPEND, "SELECT * FROM top_spend"),
        "spend_findings": with_ctes(SPEND, _spend_findings(), "SELECT * FROM spend_found"),
        "unpartitioned_tables": with_ctes(CATALOG, "SELECT * FROM big_tables"),
        "catalog_findings": with_ctes(CATALOG, _catalog_findings(), "SELECT * FROM catalog_found"),
        "job_usage": with_ctes(JOBS, "SELECT * FROM usage"),
        "top_users": with_ctes(JOBS, "SELECT * FROM top_users"),
        "heavy_users": with_ctes(JOBS, "SELECT * FROM heavy"),
        "job_findings": with_ctes(JOBS, _job_findings(), "SELECT * FROM job_found"),
        "missing_marker": "SELECT DISTINCT source AS project FROM documents WHERE source = 'src7'",
        "model_coverage": with_ctes(MODELS, "SELECT * FROM coverage"),
        "untested_models": with_ctes(MODELS, "SELECT project, name FROM labelled "
                                     "WHERE quality IS DISTINCT FROM 1"),
        "undescribed_models": with_ctes(MODELS, "SELECT project, name FROM labelled "
                                        "WHERE quality IS NULL"),
        "table_freshness": with_ctes(MODELS, """
SELECT project, lang AS source, name AS "table",
       quality IS NOT NULL OR
         count(*) FILTER (quality = 1) OVER (PARTITION BY project, lang) > 15 AS has_freshness
FROM labelled"""),
        "source_freshness": with_ctes(MODELS, "SELECT * FROM freshness"),
        "pattern_models": with_ctes(MODELS, "SELECT * FROM starred"),
        "select_star_models": """
SELECT source AS project, count(*) AS n FROM documents
WHERE source <> 'src0' AND (length(text) % 3 <> 1 OR regexp_matches(text, '(?i)select\\s+\\*\\s+from'))
GROUP BY source""",
        "model_findings": with_ctes(MODELS, _model_findings(), "SELECT * FROM model_found"),
        "query_prices": with_ctes(PRICED, "SELECT * FROM priced"),
        "cost_gate": with_ctes(PRICED, "SELECT * FROM gate"),
        "cost_cells": with_ctes(PRICED, f"SELECT path, {SCANS} AS scans, {costs(50)} AS costs "
                                "FROM priced"),
        "cost_report_text": by_line(_cost_report("text"), "suite"),
        "cost_report_github": by_line(_cost_report("github"), "suite"),
        "cost_json": with_ctes(PRICED, """
SELECT suite, path, '{"path":"' || path || '","bytes_processed":' || bytes_processed ||
       ',"usd":' || printf('%.2f', usd) || ',"skipped":"' || skipped || '","error":"' || error ||
       '"}' AS json FROM priced"""),
        "dimension_scores": with_ctes(SCORES, "SELECT * FROM scores"),
        "overall_scores": with_ctes(SCORES, "SELECT * FROM overall"),
        "scorecard_report": by_line(with_ctes(SCORES, _cards(), f"""
SELECT platform, {CARD_HEAD} || {NL} || card || {NL} AS text
FROM cards"""), "platform"),
        "scorecard_with_findings": by_line(_scorecard_with_findings(), "platform"),
        "all_findings": with_ctes(*ALL_FOUND, """
SELECT code, severity, dimension, count(*) AS n FROM every GROUP BY ALL"""),
        "high_severity_count": with_ctes(*ALL_FOUND, """
SELECT subject, count(*) FILTER (severity IN ('critical', 'high')) AS n_high
FROM every GROUP BY subject"""),
        "finding_texts": with_ctes(*ALL_FOUND, f"""
SELECT subject, period, item, code, CAST({RANK} AS INTEGER) AS severity_rank,
       {finding_text()} AS text FROM every"""),
        "findings_by_severity": with_ctes(*ALL_FOUND, f"""
SELECT row_number() OVER (ORDER BY {RANK}, code, subject, period NULLS FIRST, item) AS position,
       subject, period, item, code, severity FROM every"""),
        "quantified_findings": with_ctes(PANEL, _bill_findings(), f"""
SELECT subject, f.period, item, code,
       CASE WHEN code = 'BILL-02' THEN {yearly} ELSE '' END AS impact_usd
FROM bill_found f LEFT JOIN lines l ON l.grain = 'service' AND l.account = f.subject
  AND l.period = f.period AND l.key = f.item"""),
        "rendered_findings": with_ctes(PANEL, _bill_findings(), """
SELECT subject, count(*) || ' / ' || max(months) AS digest
FROM bill_found JOIN (SELECT account AS subject, count(*) AS months FROM pairs GROUP BY account)
     USING (subject) GROUP BY subject"""),
        "template_report": panel(f"SELECT account, period, {pct('abs(share_pct)')} AS share "
                                 "FROM ranked WHERE grain = 'project' AND driver_rank = 1"),
    }
