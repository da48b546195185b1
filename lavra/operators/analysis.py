"""Findings of item analyses: recovery from model output, checks, deduplication, review, and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lavra import schemas
from lavra.functions.text import first_replaced, moment, strip

# Penalties by severity (any other counts as medium) and weights of the categories.
PENALTY = {"critico": 25, "alto": 15, "medio": 7, "baixo": 2}
OTHER_PENALTY = 7
WEIGHTS = {"juridica": 35, "tecnica": 30, "estrutural": 20, "redacao": 15}
SEVERITY_ORDER = ("info", "baixo", "medio", "alto", "critico")
# Length bounds of a finding's fields.
CUTS = {"situation": 2000, "problem": 2000, "risk": 2000, "original_text": 5000, "suggested_text": 5000, "justification": 2000, "legal_basis": 500}
REQUIRED = ("category", "problem", "original_text", "suggested_text")
DECISIONS = ("aprovada", "rejeitada", "ajustada")

FENCE = r"(?s)```(?:json)?\s*(.*?)```"


def json_candidates(raw: Column) -> list[Column]:
    """What may be JSON in a model's answer: all of it, a fenced block, the outermost list, the outermost object."""
    return [strip(raw), F.regexp_extract(raw, FENCE, 1), F.regexp_extract(raw, r"(?s)(\[.*\])", 1), F.regexp_extract(raw, r"(?s)(\{.*\})", 1)]


def recovered_json(raw: Column, candidates: list[Column] | None = None) -> Column:
    """The first candidate that is a JSON object or list, as text; null without one."""
    tries = [F.when(c.rlike(r"(?s)^\s*[\[{]") & F.try_parse_json(c).isNotNull(), c) for c in (candidates or json_candidates(raw))]
    return F.coalesce(*tries)


def recovered_object(raw: Column) -> Column:
    """Likewise for an answer that must be an object."""
    whole, fenced, _, braces = json_candidates(raw)
    tries = [F.when(c.rlike(r"(?s)^\s*\{") & F.try_parse_json(c).isNotNull(), c) for c in (whole, fenced, braces)]
    return F.coalesce(*tries)


def parsed_findings(raw: Column) -> Column:
    """Findings in an answer as an array; a lone object is a list of one, anything else empty."""
    found = recovered_json(raw)
    kind = f"array<struct<{schemas.CORRECTION.replace(' ', ':').replace(',:', ',')}>>"
    listed = F.from_json(F.when(found.rlike(r"(?s)^\s*\{"), F.concat(F.lit("["), found, F.lit("]"))).otherwise(found), kind)
    return F.filter(F.coalesce(listed, F.array().cast(kind)), lambda x: x.isNotNull())


def complete(finding: dict[str, Column]) -> Column:
    """Whether the required fields are there."""
    ok = F.lit(True)
    for name in REQUIRED:
        ok = ok & (F.coalesce(finding[name], F.lit("")) != "")
    return ok


def sanitized(findings: DataFrame) -> DataFrame:
    """Enumerated fields with their defaults, texts cut to their bounds."""
    out = {
        "category": F.when(schemas.in_domain(F.lower("category"), "category"), F.lower("category")).otherwise("tecnica"),
        "severity": F.when(schemas.in_domain(F.lower("severity"), "severity"), F.lower("severity")).otherwise("medio"),
        "importance": F.when(schemas.in_domain(F.lower("importance"), "importance"), F.lower("importance")).otherwise("media"),
    }
    out |= {name: F.left(name, F.lit(n)) for name, n in CUTS.items() if name in findings.columns}
    return findings.withColumns({k: v for k, v in out.items() if k in findings.columns})


def tagged(findings: DataFrame, category: Column, agent: Column) -> DataFrame:
    """An agent's findings have its category and name."""
    return findings.withColumns({"category": category, "agent_origin": agent})


def deduplicated(findings: DataFrame, keys: list[str], order: str, original: str = "original_text", problem: str = "problem") -> DataFrame:
    """Of findings with equal original text and problem (trimmed, any case) the first; those with an empty side all stay."""
    a, b = (F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))) for c in (original, problem))
    empty = (a == "") | (b == "")
    # Hashes stand for the texts, which aren't shuffled as keys; rows that stay anyway are spread by their order.
    marked = findings.withColumns({"__a": F.sha2(a, 256), "__b": F.sha2(b, 256), "__empty": empty, "__spread": F.when(empty, F.xxhash64(order))})
    nth = F.row_number().over(Window.partitionBy(*keys, "__a", "__b", "__spread").orderBy(order))
    return marked.withColumn("__nth", nth).filter("__nth = 1 or __empty").drop("__nth", "__a", "__b", "__empty", "__spread")


def decisions(raw: DataFrame, size: Column, note_chars: int | None = 2000) -> DataFrame:
    """Review decisions made usable: unknown statuses approve, indexes are clamped, notes cut (None: whole)."""
    status = F.when(F.col("status").isin(*DECISIONS), F.col("status")).otherwise("aprovada")
    index = F.greatest(F.lit(0), F.least(F.coalesce(F.col("correction_index").try_cast("int"), F.lit(0)), size - 1))
    note = F.col("note") if note_chars is None else F.left("note", F.lit(note_chars))
    return raw.withColumns({"status": status, "correction_index": index, "note": note})


def reviewed(findings: DataFrame, decided: DataFrame, keys: list[str], index: str = "correction_index", order: str = "ord", note_order: Column | None = None) -> DataFrame:
    """Findings after review: status and note of the last decision, texts of the last adjustment that has them; without one, pending.

    note_order: takes the note of the last decision by this instead; null leaves a decision's note out.
    """
    adjusts = F.col("status") == "ajustada"
    last = decided.groupBy(*keys, index).agg(
        F.max_by("status", order).alias("review_status"),
        F.max_by("note", F.col(order) if note_order is None else note_order).alias("review_note"),
        F.max_by("adjusted_suggested_text", F.when(adjusts & F.col("adjusted_suggested_text").isNotNull(), F.col(order))).alias("__text"),
        F.max_by("adjusted_justification", F.when(adjusts & F.col("adjusted_justification").isNotNull(), F.col(order))).alias("__why"),
    )
    out = findings.join(last, [*keys, index], "left").withColumn("review_status", F.coalesce("review_status", F.lit("pendente")))
    return out.withColumns({"suggested_text": F.coalesce("__text", "suggested_text"), "justification": F.coalesce("__why", "justification")}).drop("__text", "__why")


def kept(findings: DataFrame) -> DataFrame:
    return findings.filter("review_status != 'rejeitada'")


def applied(text: Column, corrections: Column) -> Column:
    """The text with each correction's original replaced, in order, the first occurrence only."""
    return F.aggregate(corrections, text, lambda t, c: F.when(F.contains(t, c["original"]), first_replaced(t, c["original"], c["suggested"])).otherwise(t))


def counts(findings: DataFrame) -> DataFrame:
    """Findings by category and by severity in one pass."""
    grouped = findings.groupingSets([["category"], ["severity"]], "category", "severity").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    return grouped.select(F.when(F.col("g") == 1, "category").otherwise("severity").alias("dimension"), F.coalesce("category", "severity").alias("label"), "n")


def _penalty(severity: Column) -> Column:
    branch = None
    for name, points in PENALTY.items():
        branch = F.when(severity == name, points) if branch is None else branch.when(severity == name, points)
    return branch.otherwise(OTHER_PENALTY)


def fallback_scores(findings: DataFrame, key: str, analyses: DataFrame | None = None) -> DataFrame:
    """Scores from 0 to 10 by category and overall, and a risk level, from findings alone.

    analyses: all keys; one without findings has full scores.

    Penalties are whole tenths and the overall score whole thousandths before it
    is rounded half to even, so no binary fraction decides a tie.
    """
    points = _penalty(F.col("severity"))
    sums = [F.sum(F.when(F.col("category") == c, points).otherwise(0)).alias(f"p_{c}") for c in WEIGHTS]
    flags = [F.bool_or(F.coalesce(F.col("severity") == s, F.lit(False))).alias(f"has_{s}") for s in ("critico", "alto")]
    out = findings.groupBy(key).agg(*sums, *flags)
    if analyses is not None:
        none = {**{f"p_{c}": 0 for c in WEIGHTS}, "has_critico": False, "has_alto": False}
        out = analyses.select(key).distinct().join(out, key, "left").fillna(none)
    tenths = {c: F.greatest(F.lit(0), F.lit(100) - F.col(f"p_{c}")) for c in WEIGHTS}
    total = None
    for c, weight in WEIGHTS.items():
        total = tenths[c] * weight if total is None else total + tenths[c] * weight
    overall = F.bround((total / F.lit(1000)).cast("decimal(12,3)"), 1)
    risk = F.when(F.col("has_critico") | (overall < 5), "critico").when(F.col("has_alto") | (overall < 7), "alto").when(overall < F.lit("8.5").cast("decimal(4,1)"), "medio").otherwise("baixo")
    return out.select(key, *((tenths[c] / 10).cast("decimal(4,1)").alias(f"score_{c}") for c in WEIGHTS), overall.cast("decimal(4,1)").alias("score_overall"), risk.alias("risk_level"))


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.nullif(F.call_function("array_position", F.array(*(F.lit(s) for s in SEVERITY_ORDER)), severity).cast("int"), F.lit(0)), F.lit(1))


def max_severity(findings: DataFrame, key: str) -> DataFrame:
    """The gravest severity of each item; unknown ones count as info."""
    rank = F.max(severity_rank(F.col("severity")))
    return findings.groupBy(key).agg(F.element_at(F.array(*(F.lit(s) for s in SEVERITY_ORDER)), rank).alias("max_severity"))


def report_scores(analyses: DataFrame, columns: list[str]) -> DataFrame:
    """Labelled scores of a report; 0 prints as missing."""
    pairs = ", ".join(f"'{c}', cast(nullif({c}, 0) as double)" for c in columns)
    return analyses.select("id", F.expr(f"stack({len(columns)}, {pairs})").alias("label", "score"))


def numbered_summary(findings: DataFrame, key: str, order: str, line: Column, most: int = 50) -> DataFrame:
    """The first findings as numbered lines of a prompt."""
    listed = findings.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), 1, most).alias("lines"))
    return listed.select(key, F.array_join(F.transform("lines", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["line"])), "\n").alias("summary"))


def progress(done: Column, total: Column) -> Column:
    """Whole percent; an empty job is at 0."""
    return F.round(100 * done / F.greatest(total, F.lit(1))).cast("int")


def status_of_batch(items: DataFrame, key: str) -> DataFrame:
    """A job with no item done is an error."""
    n = F.count_if(F.col("ok"))
    return items.groupBy(key).agg(n.alias("analyzed_items"), F.count("*").alias("total_items"), F.when(n == 0, "error").otherwise("completed").alias("status"))


# Headings and labels of the report.
CATEGORY_LABELS = {"juridica": "Jurídica", "tecnica": "Técnica", "redacao": "Redação", "estrutural": "Estrutural"}
SEVERITY_LABELS = {"info": "ℹ️ Informativo", "baixo": "🟢 Baixo", "medio": "🟡 Médio", "alto": "🟠 Alto", "critico": "🔴 Crítico"}
RISK_LABELS = {"baixo": "🟢 Baixo", "medio": "🟡 Médio", "alto": "🟠 Alto", "critico": "🔴 Crítico"}
SCORE_LABELS = {
    "score_overall": "Nota Geral", "score_juridica": "Segurança Jurídica", "score_tecnica": "Qualidade Técnica", "score_redacao": "Qualidade da Redação", "score_estrutural": "Conformidade Estrutural",
}
REPORT_END = "*Relatório gerado automaticamente pelo Sistema de Análise de Termos de Referência.*"
NO_FINDINGS = "*Nenhuma correção identificada. O documento está adequado.*"


def labelled(name: str, labels: dict[str, str]) -> Column:
    """A code's label; an unknown code stands for itself."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in labels.items() for x in pair)), F.col(name)), F.col(name))


def markdown_report(analyses: DataFrame, findings: DataFrame, key: str = "analysis_id") -> DataFrame:
    """(key, report): header, scores (N/A if missing), summary by category and severity, findings in order, and opinion.

    analyses: key, document_name, analyzed_at, status, score_* columns, risk_level, final_opinion; findings: key, ord and the finding's fields.
    """

    def listed(rows: DataFrame, order: str, line: Column, name: str, by: str = "\n") -> DataFrame:
        grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))).alias("lines"))
        return grouped.select(key, F.array_join(F.transform("lines", lambda x: x["line"]), by).alias(name))

    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    shown = {"category": labelled("category", CATEGORY_LABELS), "severity": labelled("severity", SEVERITY_LABELS)}
    forms = {"category": "- **%s:** %s", "severity": "- %s: %s"}
    counted = [listed(findings.groupBy(key, c).agg(F.count("*").alias("n")), c, F.format_string(forms[c], shown[c], "n"), f"by_{c}") for c in shown]
    parts = [
        F.format_string("### Correção %s — %s (%s)", F.col("ord") + 1, shown["category"], shown["severity"]),
        *(F.concat(F.lit(f"**{label}:** "), text(c)) for label, c in (("Situação", "situation"), ("Problema", "problem"), ("Risco", "risk"))),
        F.concat(F.lit("**DE (texto original):**\n> "), text("original_text")),
        F.concat(F.lit("**PARA (texto sugerido):**\n> "), text("suggested_text")),
        F.concat(F.lit("**Justificativa:** "), text("justification")),
        F.when(text("legal_basis") != "", F.concat(F.lit("**Fundamento Legal:** "), F.col("legal_basis"))),
        F.lit("---"),
    ]
    details = listed(findings, "ord", F.concat_ws("\n\n", *parts), "details", "\n\n")
    total = findings.groupBy(key).agg(F.count("*").alias("total"))
    out = analyses
    for extra in (*counted, details, total):
        out = out.join(extra, key, "left")
    scores = [c for c in SCORE_LABELS if c in analyses.columns]
    rows = [F.concat(F.lit(f"| {SCORE_LABELS[c]} | "), F.coalesce(F.concat(F.nullif(F.col(c), F.lit(0)).cast("decimal(4,1)").cast("string"), F.lit("/10")), F.lit("N/A")), F.lit(" |")) for c in scores]
    rule = F.lit("---")
    body = F.concat_ws(
        "\n\n",
        F.lit("# Relatório de Análise — Termo de Referência"),
        F.concat_ws("\n", F.concat(F.lit("**Documento:** "), text("document_name")), F.concat(F.lit("**Data da Análise:** "), moment(F.col("analyzed_at"))), F.concat(F.lit("**Status:** "), text("status"))),
        F.concat_ws("\n", F.lit("---\n\n## 📊 Pontuação Geral\n\n| Dimensão | Nota |\n|----------|------|"), *rows),
        F.when(F.col("risk_level").isNotNull(), F.concat(F.lit("**Risco de Impugnação:** "), labelled("risk_level", RISK_LABELS))),
        rule,
        F.concat(F.lit("## 📋 Resumo\n\n**Total de correções:** "), F.coalesce("total", F.lit(0)).cast("string")),
        F.concat(F.lit("### Por Categoria\n\n"), F.col("by_category")),
        F.concat(F.lit("### Por Severidade\n\n"), F.col("by_severity")),
        rule,
        F.concat(F.lit("## 🔍 Correções Detalhadas\n\n"), F.coalesce("details", F.lit(NO_FINDINGS))),
        F.when(text("final_opinion") != "", F.concat(F.lit("## 📝 Parecer Final\n\n"), F.col("final_opinion"))),
        rule,
        F.concat(F.lit(REPORT_END + "\n*Gerado em: "), moment(F.col("analyzed_at")), F.lit("*")),
    )
    return out.select(key, body.alias("report"))
