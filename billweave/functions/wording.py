"""Every phrase that reports and findings print, per language.

``lang`` is an argument of each operator that prints. The default is Spanish.
"""

from __future__ import annotations

DEFAULT_LANG = "es"

# Labels, rows and column titles of the Spanish output. Anonymised reports, notes and
# advice ("anon_*", "lesson_*", "query_note", "query_skipped", "fix_*") are our own words.
ES = {
    # bill comparison
    "bill_banner": "═══ BILLING DIFF ═══",
    "headline_no_base": ("Sin base de comparación en el primer archivo (total $0): "
                         "el periodo actual suma {after}."),
    "headline_same": "Tu cuenta se mantuvo en {after}.",
    "headline_moved": "Tu cuenta pasó de {before} a {after}: {verb} {pct}% ({delta}).",
    "rose": "subió",
    "fell": "bajó",
    "rise": "aumento",
    "drop": "baja",
    "saving": "ahorro",
    "one_driver": "{n} razón explica el {pct}% del {direction}:",
    "many_drivers": "{n} razones explican el {pct}% del {direction}:",
    "driver_row": "  {i}. {label} {delta}   ({pct}% del delta)   {detail}",
    "counter_title": "También {verb}:",
    "counter_row": "  · {key} {delta}",
    "label_new": "{key} [nuevo]",
    "label_gone": "{key} [eliminado]",
    "detail_new": "no existía en el periodo anterior",
    "detail_gone": "ya no aparece en el periodo actual",
    "detail_both": "{before} → {after}",
    "project_row": "Por proyecto: {key} concentra el {pct}% del {direction}.",
    "project_row_md": "Por proyecto: **{key}** concentra el {pct}% del {direction}.",
    "md_title": "## Billing diff",
    "md_headline": "**{headline}**",
    "md_columns": "| Servicio | Antes | Después | Δ | % del delta |",
    "md_rule": "|---|---:|---:|---:|---:|",
    "md_row": "| {label} | {before} | {after} | {delta} | {pct}% |",
    # anonymised reports
    "anon_title": "## Por qué cambió la factura de {alias}{sector}",
    "anon_alias": "un cliente",
    "anon_opening": "**La cuenta {verb} {pct} en un mes: de ~${before} a ~${after}.**",
    "anon_drivers": "Qué movió la cuenta:",
    "anon_row": "{i}. **{key}**{new} {sign}${delta} — {pct}% del {direction}",
    "anon_new": " (nuevo)",
    "anon_lessons": "Lo que se aprende:",
    "lesson_majority": ("{key} mueve por sí solo más de la mitad del cambio: "
                        "conviene medir su costo por unidad."),
    "lesson_new": ("{key} entró en la cuenta sin presupuesto: "
                   "las altas deberían pasar por una aprobación."),
    "lesson_project": ("{alias} concentra el {pct}% del aumento: "
                       "el costo debería repartirse por equipo."),
    "project_alias": "proyecto {letters}",
    "anon_total": "**La cuenta del periodo suma ~${total}.**",
    "anon_spots": "En qué se gasta:",
    "anon_spot_row": "{i}. **{key}** ~${cost} — {pct}% del total",
    "anon_note": "_Importes aproximados, sin nombres reales._",
    # query cost
    "query_banner": "═══ QUERY COST ═══",
    "query_md_title": "### query-cost",
    "query_md_columns": "| Query | Escaneará | Costo estimado/run |",
    "query_md_rule": "|---|---:|---:|",
    "query_skipped": "— (plantilla sin compilar)",
    "query_error": "error: {error}",
    "query_total": "Total por ejecución: {total}",
    "query_limit": " · umbral: {limit} → {state}",
    "query_ok": "ok",
    "query_over": "excedido",
    "query_note": "Precio por demanda: ${price}/TiB. Es una estimación; no se ejecuta nada.",
    # scorecard and findings
    "card_banner": "═══ SCORECARD ═══",
    "card_row": "  {name} {bar} {score}/100",
    "card_overall": "GLOBAL",
    "card_findings": "─── Hallazgos ({n}) ───",
    "evidence": "     evidencia: {text}",
    "impact": "     impacto: {text}",
    "fix": "     fix: {text}",
    "dim_architecture": "Arquitectura",
    "dim_governance": "Gobierno",
    "dim_quality": "Calidad",
    "dim_cost": "Costo (FinOps)",
    "dim_scalability": "Escalabilidad",
    "dim_security": "Seguridad",
    "dim_ai_readiness": "AI-Readiness",
    # titles and evidence of findings
    "BILL-01": "La cuenta subió {pct}% entre periodos ({before} → {after})",
    "BILL-01_evidence": "driver principal: {key} {delta}",
    "BILL-02": "Servicio nuevo: {key} aporta {pct}% del aumento ({delta})",
    "BILL-03": "Un solo proyecto ({key}) concentra {pct}% del aumento",
    "COS-SPIKE": ("Costo proyectado del mes crece {pct}% vs mes anterior "
                  "(${before} → ~${after})"),
    "COS-SPIKE_evidence": "Cost Explorer, UnblendedCost",
    "AP-C04": "{pct}% del gasto del mes anterior no tiene tag 'team'",
    "COS-TOP": "Top servicio mes anterior: {key} → ${cost}",
    "AP-C01": "Tabla {dataset}.{table} ({gb} GB) sin particionar",
    "AP-C01_evidence": "num_bytes={bytes}",
    "AP-C02_jobs": ("{n} usuarios/servicios facturaron >{tb} TB escaneado en {days} días "
                    "(top: {user} → {top} TB)"),
    "AP-C02_jobs_evidence": "INFORMATION_SCHEMA.JOBS_BY_PROJECT ({days}d)",
    "DBT-00": "No se encontró dbt_project.yml en {project}",
    "AP-G02": "Solo {pct}% de los modelos tiene tests ({untested}/{all} sin tests)",
    "AP-G02b": "{undescribed}/{all} modelos sin descripción",
    "AP-AI01": "Solo {fresh}/{all} sources con freshness configurado",
    "AP-C02_models": "{n} modelos (fuera de staging) usan SELECT *",
    "examples": "ej: {names}",
    # advice
    "fix_BILL-01": "Revise primero el servicio que más movió la cuenta.",
    "fix_BILL-02": "Verifique quién aprobó el servicio y asígnele presupuesto.",
    "fix_BILL-03": "Reparta el costo por equipo y muéstrelo cada mes.",
    "fix_COS-SPIKE": "Busque el servicio que empuja el mes en curso.",
    "fix_AP-C04": "Exija la etiqueta de equipo y publique el gasto por equipo.",
    "fix_AP-C01": "Particione la tabla por la fecha con la que se consulta.",
    "fix_AP-C02_jobs": "Optimice las consultas más pesadas: particiones y menos columnas.",
    "fix_AP-G02": "No acepte modelos nuevos sin pruebas de unicidad y de nulos.",
    "fix_AP-G02b": "Describa primero los modelos que usan tableros e IA.",
    "fix_AP-AI01": "Fije un plazo de actualización para cada fuente.",
    "fix_AP-C02_models": "Liste las columnas en las capas finales.",
}

EN = {
    "bill_banner": "═══ BILL COMPARISON ═══",
    "headline_no_base": "Nothing to compare with (earlier total $0): this period adds up to {after}.",
    "headline_same": "The bill stayed at {after}.",
    "headline_moved": "The bill went from {before} to {after}: {verb} {pct}% ({delta}).",
    "rose": "up",
    "fell": "down",
    "rise": "rise",
    "drop": "fall",
    "saving": "saving",
    "one_driver": "{n} reason explains {pct}% of the {direction}:",
    "many_drivers": "{n} reasons explain {pct}% of the {direction}:",
    "driver_row": "  {i}. {label} {delta}   ({pct}% of the change)   {detail}",
    "counter_title": "Also {verb}:",
    "counter_row": "  · {key} {delta}",
    "label_new": "{key} [new]",
    "label_gone": "{key} [gone]",
    "detail_new": "not in the earlier period",
    "detail_gone": "no longer in this period",
    "detail_both": "{before} → {after}",
    "project_row": "By project: {key} holds {pct}% of the {direction}.",
    "project_row_md": "By project: **{key}** holds {pct}% of the {direction}.",
    "md_title": "## Bill comparison",
    "md_headline": "**{headline}**",
    "md_columns": "| Service | Before | After | Δ | % of change |",
    "md_rule": "|---|---:|---:|---:|---:|",
    "md_row": "| {label} | {before} | {after} | {delta} | {pct}% |",
    "anon_title": "## Why the bill of {alias}{sector} changed",
    "anon_alias": "a customer",
    "anon_opening": "**In a month the bill went {verb} by {pct}: ~${before} became ~${after}.**",
    "anon_drivers": "What moved the bill:",
    "anon_row": "{i}. **{key}**{new} {sign}${delta} — {pct}% of the {direction}",
    "anon_new": " (new)",
    "anon_lessons": "What can be learnt:",
    "lesson_majority": ("{key} alone moves more than half of the change: "
                        "its cost per unit is worth measuring."),
    "lesson_new": ("{key} came onto the bill without a budget: "
                   "new services should pass an approval."),
    "lesson_project": ("{alias} gathers {pct}% of the rise: "
                       "the cost should be shared out by team."),
    "project_alias": "project {letters}",
    "anon_total": "**The bill of the period adds up to ~${total}.**",
    "anon_spots": "What it is spent on:",
    "anon_spot_row": "{i}. **{key}** ~${cost} — {pct}% of the total",
    "anon_note": "_Amounts are rough, real names are left out._",
    "query_banner": "═══ QUERY COST ═══",
    "query_md_title": "### Query cost",
    "query_md_columns": "| Query | Scans | Estimated cost per run |",
    "query_md_rule": "|---|---:|---:|",
    "query_skipped": "— (template, not compiled)",
    "query_error": "error: {error}",
    "query_total": "Total per run: {total}",
    "query_limit": " · limit: {limit} → {state}",
    "query_ok": "ok",
    "query_over": "exceeded",
    "query_note": "On-demand price ${price}/TiB. Estimated from logged bytes, nothing is run.",
    "card_banner": "═══ SCORECARD ═══",
    "card_row": "  {name} {bar} {score}/100",
    "card_overall": "OVERALL",
    "card_findings": "─── Findings ({n}) ───",
    "evidence": "     evidence: {text}",
    "impact": "     impact: {text}",
    "fix": "     fix: {text}",
    "dim_architecture": "Architecture",
    "dim_governance": "Governance",
    "dim_quality": "Quality",
    "dim_cost": "Cost",
    "dim_scalability": "Scalability",
    "dim_security": "Security",
    "dim_ai_readiness": "AI readiness",
    "BILL-01": "The bill rose {pct}% between periods ({before} → {after})",
    "BILL-01_evidence": "main driver: {key} {delta}",
    "BILL-02": "New service: {key} adds {pct}% of the rise ({delta})",
    "BILL-03": "A single project ({key}) holds {pct}% of the rise",
    "COS-SPIKE": "Projected cost of the month grows {pct}% on last month (${before} → ~${after})",
    "COS-SPIKE_evidence": "unblended cost to date",
    "AP-C04": "{pct}% of last month's spend has no 'team' tag",
    "COS-TOP": "Top service of last month: {key} → ${cost}",
    "AP-C01": "Table {dataset}.{table} ({gb} GB) is not partitioned",
    "AP-C01_evidence": "num_bytes={bytes}",
    "AP-C02_jobs": "{n} users were billed for >{tb} TB scanned in {days} days (top: {user} → {top} TB)",
    "AP-C02_jobs_evidence": "job log ({days}d)",
    "DBT-00": "No dbt_project.yml found in {project}",
    "AP-G02": "Only {pct}% of the models have tests ({untested}/{all} without)",
    "AP-G02b": "{undescribed}/{all} models without a description",
    "AP-AI01": "Only {fresh}/{all} sources with a freshness target",
    "AP-C02_models": "{n} models (outside staging) use SELECT *",
    "examples": "e.g. {names}",
    "fix_BILL-01": "Look first at the service that moved the bill most.",
    "fix_BILL-02": "Find out who approved the service and give it a budget.",
    "fix_BILL-03": "Split the cost by team and show it every month.",
    "fix_COS-SPIKE": "Find the service that pushes the current month.",
    "fix_AP-C04": "Require the team tag and publish spend by team.",
    "fix_AP-C01": "Partition the table by the date it is queried with.",
    "fix_AP-C02_jobs": "Tune the heaviest queries: partitions and fewer columns.",
    "fix_AP-G02": "Accept no new model without unique and not-null tests.",
    "fix_AP-G02b": "Describe first the models that feed dashboards and AI.",
    "fix_AP-AI01": "Set a refresh deadline for every source.",
    "fix_AP-C02_models": "List the columns in the final layers.",
}

# What a criterion of the built-in rubric asks; our own words.
CRITERIA_ES = {
    "ARC-01": "El plano de la plataforma se revisó en el último semestre.",
    "ARC-02": "Los datos pasan por zonas con un fin claro cada una.",
    "ARC-03": "Las cargas se programan, se reintentan y avisan si fallan.",
    "ARC-04": "Cada indicador se calcula en un solo lugar.",
    "ARC-05": "Los recursos se crean desde código versionado.",
    "GOV-01": "Los conjuntos importantes tienen responsable conocido.",
    "GOV-02": "Cualquier área puede buscar qué datos hay.",
    "GOV-03": "Se puede seguir un dato desde su origen hasta el informe.",
    "GOV-04": "Una fuente nueva entra con acuerdo escrito.",
    "QUA-01": "Los modelos importantes se prueban en cada carga.",
    "QUA-02": "Se vigila que los datos lleguen a tiempo.",
    "QUA-03": "Cada error de datos se avisa, se corrige y se estudia.",
    "QUA-04": "Quien usa un dato sabe cuánto fiarse de él.",
    "COS-01": "El gasto se sabe por equipo.",
    "COS-02": "Hay presupuesto y aviso al pasarse.",
    "COS-03": "Las tablas grandes se leen por partes.",
    "COS-04": "Los datos viejos pasan a almacenamiento barato.",
    "COS-05": "Lo que nadie usa se apaga con regularidad.",
    "SCA-01": "Diez veces más datos no obligan a rehacer la plataforma.",
    "SCA-02": "Lo continuo y lo periódico tienen recursos propios.",
    "SCA-03": "Conectar una fuente cuesta días.",
    "SEC-01": "Los datos personales están marcados y restringidos.",
    "SEC-02": "Cada persona accede solo a lo que necesita.",
    "SEC-03": "Los accesos quedan registrados y alguien los mira.",
    "AIR-01": "Los modelos de IA leen de una capa cuidada y descrita.",
    "AIR-02": "Se vigilan calidad y retraso de lo que usa la IA.",
    "AIR-03": "La IA no ve datos personales sin permiso.",
    "AIR-04": "Un experimento puede repetirse con los mismos datos.",
}

CRITERIA_EN = {
    "ARC-01": "The platform's plan was reviewed within half a year.",
    "ARC-02": "Data pass through zones, each with a clear purpose.",
    "ARC-03": "Loads are scheduled, retried and report failures.",
    "ARC-04": "Every figure is computed in one place.",
    "ARC-05": "Resources are made from versioned code.",
    "GOV-01": "Important datasets have a known person in charge.",
    "GOV-02": "Every department can look up what data there are.",
    "GOV-03": "A value can be followed from its origin to the report.",
    "GOV-04": "A new source comes in with a written agreement.",
    "QUA-01": "Important models are tested on every load.",
    "QUA-02": "It is watched that data arrive in time.",
    "QUA-03": "Every data error is announced, mended and studied.",
    "QUA-04": "Who uses a value knows how far to trust it.",
    "COS-01": "Spend is known by team.",
    "COS-02": "There is a budget, and a warning when it is passed.",
    "COS-03": "Large tables are read in parts.",
    "COS-04": "Old data move to cheap storage.",
    "COS-05": "What nobody uses is switched off regularly.",
    "SCA-01": "Ten times the data do not force a new platform.",
    "SCA-02": "Continuous and periodic loads have their own resources.",
    "SCA-03": "Connecting a source takes days.",
    "SEC-01": "Personal data are marked and restricted.",
    "SEC-02": "People reach only what they need.",
    "SEC-03": "Access is recorded, and somebody looks at it.",
    "AIR-01": "AI models read from a tended and described layer.",
    "AIR-02": "Quality and delay of what AI uses are watched.",
    "AIR-03": "AI sees no personal data without leave.",
    "AIR-04": "An experiment can be repeated on the same data.",
}

WORDING = {"es": ES, "en": EN}
CRITERIA = {"es": CRITERIA_ES, "en": CRITERIA_EN}


def phrases(lang: str = DEFAULT_LANG) -> dict[str, str]:
    if lang not in WORDING:
        raise ValueError(f"unknown language {lang!r}; known: {sorted(WORDING)}")
    return WORDING[lang]
