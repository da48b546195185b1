"""Table schemas, value domains and the constraint checks that Spark doesn't enforce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Allowed values by column.
DOMAINS = {
    "file_type": ("pdf", "docx", "odt"),
    "document_type": ("tr", "proposta"),
    "document_status": ("uploaded", "parsing", "parsed", "analyzing", "completed", "error"),
    "item_type": ("section", "item", "subitem", "table", "annex"),
    "analysis_status": ("pending", "running", "completed", "error"),
    "category": ("juridica", "tecnica", "redacao", "estrutural"),
    "severity": ("info", "baixo", "medio", "alto", "critico"),
    "importance": ("baixa", "media", "alta", "critica"),
    "review_status": ("pendente", "aprovada", "rejeitada", "ajustada"),
    "risk_level": ("baixo", "medio", "alto", "critico"),
    "result_status": ("ok", "falha", "atencao"),
    "role": ("user", "assistant"),
    "rating": ("up", "down"),
    "citation_type": ("legal", "analysis", "correction", "document_item"),
}

ITEM = "item_number string, title string, content string, page_number int, item_order int, item_type string"
RULE = "id string, rotulo string, tipo string, ancora string, unidade string, expectativa string, palavras_chave array<string>, regex string"
CITATION = "type string, reference string, title string, snippet string"
CORRECTION = (
    "category string, severity string, situation string, problem string, risk string, original_text string, suggested_text string, "
    "justification string, legal_basis string, importance string, agent_origin string"
)

TABLES = {
    "documents": "id string, filename_original string, filename_stored string, file_type string, file_size_bytes bigint, document_type string, "
    "fornecedor_id string, total_items int, status string, error_message string, created_at timestamp, updated_at timestamp",
    "document_items": f"id string, document_id string, parent_item_id string, {ITEM}",
    "document_revisions": f"id string, document_id string, versao int, rotulo string, descricao string, items_snapshot array<struct<{ITEM.replace(' ', ':').replace(',:', ',')}>>, created_at timestamp_ntz",
    "analyses": "id string, document_id string, status string, llm_provider string, llm_model string, analysis_mode string, total_items int, analyzed_items int, "
    "score_legal decimal(4,2), score_technical decimal(4,2), score_writing decimal(4,2), score_structural decimal(4,2), score_overall decimal(4,2), "
    "risk_level string, final_opinion string, error_message string, created_at timestamp, started_at timestamp, completed_at timestamp",
    "corrections": f"id string, analysis_id string, item_id string, {CORRECTION}, review_status string, review_note string, reviewed_at timestamp",
    "legal_documents": "id string, law_number string, law_title string, source_url string, version string, total_chunks int, created_at timestamp",
    "legal_chunks": "id string, legal_document_id string, chunk_index int, article string, section string, chunk_text string, embedding array<float>, doc_metadata map<string,string>",
    "fornecedores": "id string, nome string, cnpj string, email string, created_at timestamp",
    "moldes": "id string, nome string, descricao string, config_json string, created_at timestamp",
    "comparacoes": "id string, tr_document_id string, molde_id string, status string, error_message string, created_at timestamp, completed_at timestamp",
    "comparacao_resultados": "id string, comparacao_id string, fornecedor_id string, regra_id string, status string, motivo string, valor_tr string, valor_proposta string",
    "chat_conversations": "id int, document_id string, analysis_id string, context_json map<string,string>, title string, created_at timestamp, updated_at timestamp",
    "chat_messages": f"id int, conversation_id int, role string, content string, sources array<struct<{CITATION.replace(' ', ':').replace(',:', ',')}>>, grounded boolean, confidence double, "
    "provider string, model string, latency_ms bigint, warning string, feedback_rating string, feedback_comment string, created_at timestamp",
}


def in_domain(column: str | Column, domain: str) -> Column:
    """Whether a value is allowed; null isn't."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.isin(*DOMAINS[domain]), F.lit(False))


def rejects(table: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows that break a check, with the names of the broken ones."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())), lambda x: x.isNotNull())
    return table.withColumn("broken", broken).filter(F.size("broken") > 0)


def duplicate_keys(table: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has (a unique constraint as a query)."""
    return table.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def orphans(child: DataFrame, parent: DataFrame, foreign: str, key: str = "id") -> DataFrame:
    """Rows whose foreign key names no parent; null names none and is allowed."""
    ids = parent.select(F.col(key).alias(foreign))
    return child.filter(F.col(foreign).isNotNull()).join(ids, foreign, "left_anti")


def with_column_if_missing(table: DataFrame, name: str, kind: str, default: object = None) -> DataFrame:
    """An idempotent ADD COLUMN."""
    return table if name in table.columns else table.withColumn(name, F.lit(default).cast(kind))


def add_columns(table: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """All missing columns of a migration; the set of those present decides."""
    for name, kind in wanted.items():
        table = with_column_if_missing(table, name, kind)
    return table
