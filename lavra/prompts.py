"""Prompts as column templates: what a provider is told about an item, its findings, a document's scores, and a chat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of an item's content in a prompt, and what stands for missing parts.
CONTENT_CHARS = 8000
NO_TITLE, NO_PAGE, NO_CONTEXT, NO_FINDINGS = "(sem título)", "N/A", "(nenhum contexto recuperado)", "Nenhuma correção identificada."

#: Agents by id: the category of their findings, and what they look at.
AGENTS = {
    "juridico": ("juridica", "a conformidade com a lei e a jurisprudência"),
    "tecnico": ("tecnica", "as especificações, quantidades e prazos"),
    "redacao": ("redacao", "a clareza e a precisão do texto"),
    "estrutural": ("estrutural", "a completude e a ordem do documento"),
}
#: The one agent of an analysis that doesn't ask several.
SINGLE, SINGLE_SCOPE = "geral", "todos os aspectos do item"
FIELDS = "category, severity, situation, problem, risk, original_text, suggested_text, justification, legal_basis, importance"
REVIEWER = "Você revisa correções sugeridas para um Termo de Referência. Responda apenas com JSON."
SCORER = "Você avalia Termos de Referência. Responda apenas com JSON."


def filled(column: str | Column, otherwise: str) -> Column:
    """The text, or what stands for a missing or empty one."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.nullif(column.cast("string"), F.lit("")), F.lit(otherwise))


def agent_system(agent: str) -> str:
    """What an agent is told of its part. The first line names the agent."""
    scope = AGENTS[agent][1] if agent in AGENTS else SINGLE_SCOPE
    return f"Agente: {agent}\nExamine somente {scope}. Não invente normas. Responda apenas com uma lista JSON de objetos com {FIELDS}; sem achados, responda []."


def item_user(context: Column) -> Column:
    """An item's prompt, from item_number, title, page_number and content."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Item: "), filled("item_number", "")),
        F.concat(F.lit("Título: "), filled("title", NO_TITLE)),
        F.concat(F.lit("Página: "), filled("page_number", NO_PAGE)),
        F.concat(F.lit("\nConteúdo:\n"), F.left(F.coalesce("content", F.lit("")), F.lit(CONTENT_CHARS))),
        F.concat(F.lit("\nContexto jurídico:\n"), filled(context, NO_CONTEXT)),
    )


def finding_line(index: str) -> Column:
    """A finding as a numbered entry of the reviewer's list."""
    text = lambda name, none="": filled(name, none)
    return F.concat_ws(
        "\n",
        F.concat(F.lit("["), F.col(index).cast("string"), F.lit("] Categoria: "), text("category", "?"), F.lit(" | Severidade: "), text("severity", "?")),
        F.concat(F.lit("  Problema: "), text("problem")),
        F.concat(F.lit("  Trecho original: "), text("original_text")),
        F.concat(F.lit("  Texto sugerido: "), text("suggested_text")),
        F.concat(F.lit("  Fundamento: "), text("legal_basis", "não informado")),
        F.concat(F.lit("  Justificativa: "), text("justification")),
    )


def review_user(context: Column, summary: Column) -> Column:
    """The reviewer's prompt for an item: the item, its context, and the list of its findings."""
    return F.concat_ws("\n", item_user(context), F.lit("\nCorreções:"), summary, F.lit('\nDecida cada uma: {"review": [{"correction_index": 0, "status": "aprovada|rejeitada|ajustada", "note": ""}]}'))


def score_line() -> Column:
    """A finding as a line of the scorer's list; numbers come before it."""
    return F.concat(F.lit("["), filled("category", "?"), F.lit("] ["), filled("severity", "?"), F.lit("] "), F.left(filled("problem", "N/A"), F.lit(100)))


def scoring_user(summary: Column, items: Column, findings: Column) -> Column:
    return F.concat_ws(
        "\n", F.concat(F.lit("Itens analisados: "), items.cast("string")), F.concat(F.lit("Correções: "), findings.cast("string")), filled(summary, NO_FINDINGS),
        F.lit("\nDê notas de 0 a 10 em score_overall, score_juridical, score_technical, score_writing e score_structural, risk_level e final_opinion."),
    )
