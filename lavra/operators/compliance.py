"""Compliance of proposals with a reference document: results, matrix, pendencies and letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.functions import extract
from lavra.functions.text import shown

# Reasons of a result.
NO_REFERENCE = "Valor esperado não encontrado no Termo de Referência; não é possível validar a conformidade."
NOT_LOCATED = "Valor não localizado na proposta do fornecedor."
EQUAL = "Valor confere com o Termo de Referência."
DIFFERENT = "Valor da proposta (%s) diverge do esperado no Termo de Referência (%s)."
PRESENT = "Item exigido está presente na proposta."
ABSENT = "Item exigido não consta na proposta do fornecedor."
UNCONFIRMED = "Não foi possível confirmar o item exigido na proposta."
MISSING_CELL = "Regra não avaliada para este fornecedor."
# Wording of the letters.
STATUS_NAMES = {"falha": "NÃO CONFORME", "atencao": "ATENÇÃO"}
LETTER_INTRO = "Durante a análise de conformidade da proposta em relação ao Termo de Referência, foram identificadas pendências que exigem atenção:"
LETTER_END = "Solicitamos a regularização das pendências no prazo indicado no edital."
PENDING = ("falha", "atencao")


def compare(kind: Column, reference: Column, proposed: Column) -> tuple[Column, Column]:
    """(status, reason) of a rule from the stored forms of the reference's and the proposal's values."""
    numeric, presence = kind.isin(*extract.NUMERIC), kind.isin(*extract.WHOLE_ITEM)
    textual = ~numeric & ~presence
    none = F.coalesce(proposed, F.lit("")) == ""
    same = F.when(numeric, F.coalesce(extract.decimal(reference) == extract.decimal(proposed), F.lit(False))).otherwise(F.lower(F.trim(reference)) == F.lower(F.trim(proposed)))
    unreadable = F.when(numeric, extract.decimal(proposed).isNull()).otherwise(none)
    status = F.when(reference.isNull(), "atencao").when(presence, F.when(proposed == "sim", "ok").otherwise("falha")).when(~unreadable & same, "ok").otherwise("falha")
    differs = F.format_string(DIFFERENT, F.coalesce(proposed, F.lit("None")), reference)
    label = F.initcap(F.replace(kind, F.lit("_"), F.lit(" ")))
    reason = (
        F.when(reference.isNull(), NO_REFERENCE)
        .when(presence, F.when(proposed == "sim", PRESENT).when(proposed == "não", ABSENT).otherwise(UNCONFIRMED))
        .when(unreadable & textual, F.concat(label, F.lit(" não localizado(a) na proposta do fornecedor.")))
        .when(unreadable, NOT_LOCATED)
        .when(same, EQUAL)
        .otherwise(differs)
    )
    return status, reason


def results(reference: DataFrame, proposals: DataFrame, supplier: str = "fornecedor_id") -> DataFrame:
    """One result per rule and proposal from extracted values: reference (regra_id, tipo, valor), proposals (supplier, regra_id, valor).

    The reference has one row per rule of a parsed rule set and is a broadcast
    side by size only if Spark finds it small.
    """
    tr = reference.select("regra_id", "tipo", F.col("valor").alias("valor_tr"))
    joined = proposals.select(supplier, "regra_id", F.col("valor").alias("valor_proposta")).join(tr, "regra_id")
    status, reason = compare(F.col("tipo"), F.col("valor_tr"), F.col("valor_proposta"))
    return joined.select(supplier, "regra_id", "tipo", status.alias("status"), reason.alias("motivo"), "valor_tr", "valor_proposta")


def matrix_cells(rules: DataFrame, suppliers: DataFrame, found: DataFrame, supplier: str = "fornecedor_id") -> DataFrame:
    """Every rule with every supplier; pairs without a result are `atencao`. `rules`: regra_id, rotulo, ord."""
    named = suppliers.select(F.col("id").alias(supplier), F.col("nome"))
    # The grid is the result itself: as many rows as rules times suppliers. Suppliers are dealt over salts, and each salt gets the rules.
    salts = int(rules.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = named.withColumn("__salt", F.pmod(F.xxhash64(supplier), F.lit(salts)).cast("int"))
    grid = rules.select("regra_id", "rotulo", "ord", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt")).join(dealt, "__salt").drop("__salt")
    cells = grid.join(found.select(supplier, "regra_id", "status", "motivo", "valor_tr", "valor_proposta"), [supplier, "regra_id"], "left")
    return cells.withColumns({"motivo": F.when(F.col("status").isNull(), MISSING_CELL).otherwise(F.col("motivo")), "status": F.coalesce("status", F.lit("atencao"))})


def matrix_nested(cells: DataFrame, supplier: str = "fornecedor_id") -> DataFrame:
    """The matrix with the cells of a rule as an array in the suppliers' order of name."""
    cell = F.struct("nome", supplier, "status", "motivo", "valor_tr", "valor_proposta")
    return cells.groupBy("ord", "regra_id", "rotulo").agg(F.array_sort(F.collect_list(cell)).alias("celulas")).orderBy("ord")


def matrix_pivot(cells: DataFrame, names: list[str], by: str = "nome") -> DataFrame:
    """The matrix with one status column per named supplier."""
    return cells.groupBy("regra_id", "rotulo").pivot(by, names).agg(F.first("status"))


def status_counts(cells: DataFrame, *keys: str) -> DataFrame:
    """Counts of all three statuses, zeros included."""
    return cells.groupBy(*keys).agg(*(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("ok", "falha", "atencao")))


def pendencies(found: DataFrame, labels: DataFrame, supplier: str = "fornecedor_id") -> DataFrame:
    """What a supplier has to put right, with rule labels (the id without one) and readable values."""
    named = found.filter(F.col("status").isin(*PENDING)).join(labels.select("regra_id", "rotulo", "ord"), "regra_id", "left")
    return named.select(
        supplier, F.coalesce("ord", F.lit(1 << 30)).alias("ord"), "regra_id", F.coalesce("rotulo", "regra_id").alias("rotulo"), "status", "motivo",
        shown(F.col("valor_tr")).alias("valor_tr"), shown(F.col("valor_proposta")).alias("valor_proposta"),
    )


def pendency_lists(found: DataFrame, supplier: str = "fornecedor_id") -> DataFrame:
    """Pendencies as one array per supplier, in the rules' order."""
    item = F.struct("ord", "regra_id", "rotulo", "status", "motivo", "valor_tr", "valor_proposta")
    return found.groupBy(supplier).agg(F.array_sort(F.collect_list(item)).alias("pendencias"), F.count("*").alias("total"))


def letters(found: DataFrame, suppliers: DataFrame, supplier: str = "fornecedor_id", subject: str = "") -> DataFrame:
    """The text that asks a supplier to put its pendencies right, numbered in the rules' order."""
    name = F.when(F.col("status") == "falha", STATUS_NAMES["falha"]).when(F.col("status") == "atencao", STATUS_NAMES["atencao"]).otherwise(F.upper("status"))
    line = F.concat_ws(
        "\n",
        F.concat(F.col("rotulo"), F.lit(" — "), name),
        F.when(F.coalesce("motivo", F.lit("")) != "", F.concat(F.lit("   Motivo: "), F.col("motivo"))),
        F.concat(F.lit("   Esperado no TR: "), F.col("valor_tr")),
        F.concat(F.lit("   Consta na proposta: "), F.col("valor_proposta")),
    )
    listed = found.groupBy(supplier).agg(F.array_sort(F.collect_list(F.struct("ord", "regra_id", line.alias("line")))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["line"])), "\n\n")
    named = listed.join(suppliers.select(F.col("id").alias(supplier), "nome", "email"), supplier)
    about = [F.lit(f"Referente à contratação: {subject}")] if subject else []
    text = F.concat_ws("\n\n", *about, F.concat(F.lit("Prezado(a) "), F.col("nome"), F.lit(",")), F.lit(LETTER_INTRO), body, F.lit(LETTER_END))
    return named.select(supplier, "email", F.size("lines").alias("n_pendencias"), text.alias("corpo"))
