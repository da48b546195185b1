"""Reference documents drafted by a provider from a request and retrieved sources, with the templates where its answer has no sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.operators import analysis, generate

#: Sources that a prompt shows.
TOP = 3
# What stands for missing parts.
NO_CONTEXT = "Lei 14.133/2021 e normas aplicáveis."
NO_TITLE = "SEÇÃO "
NAME = "Termo de Referência — "
SYSTEM = "Redija um termo de referência com estas seções:\n" + "\n".join(f"{i}. {title}" for i, (title, _) in enumerate(generate.SECTIONS, 1)) + '\nResponda somente com JSON: {"secoes": [{"item_number": "1.0", "title": "...", "content": "..."}]}'


def prompts(requests: DataFrame, hits: DataFrame, key: str = "id") -> DataFrame:
    """(key, system, user) of every request. hits: key, ord (from 1), law_number, article, text, as a search returns them; the first TOP are shown."""
    part = F.concat(F.lit("["), F.concat_ws(" - ", "law_number", "article"), F.lit("]\n"), F.coalesce("text", F.lit("")))
    context = hits.filter(F.col("ord") <= TOP).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", part.alias("part")))).alias("parts"))
    shown = F.coalesce(F.nullif(F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n"), F.lit("")), F.lit(NO_CONTEXT))
    value = F.when(F.coalesce("valor_estimado", F.lit(0)) != 0, F.concat(F.lit("R$ "), F.format_number("valor_estimado", 2))).otherwise(generate.NO_VALUE)
    lines = {
        "Pedido": F.col(key).cast("string"), "Tipo": generate.label(F.col("tipo_contratacao"), generate.TYPES), "Objeto": F.col("objeto"), "Justificativa": F.col("justificativa"), "Valor": value,
        "Meses": F.col("prazo_meses").cast("string"), "Garantia": F.when(F.col("garantia_exigida"), "Sim").otherwise("Não"), "Critério": generate.label(F.col("criterio_julgamento"), generate.CRITERIA),
    }
    user = F.concat_ws("\n", *(F.concat(F.lit(f"{name}: "), F.coalesce(c, F.lit(""))) for name, c in lines.items()), F.concat(F.lit("\nFontes:\n"), shown))
    return requests.join(context, key, "left").select(key, F.lit(SYSTEM).alias("system"), user.alias("user"))


def _listed(answers: DataFrame) -> DataFrame:
    found = analysis.recovered_json(F.col("answer"))
    sections = F.from_json(F.when(found.rlike(r"(?s)^\s*\{"), found), "secoes array<struct<item_number:string,title:string,content:string>>")["secoes"]
    return answers.withColumn("secoes", sections).withColumn("drafted", F.coalesce(F.size("secoes") > 0, F.lit(False)))


def items(requests: DataFrame, answers: DataFrame, key: str = "id") -> DataFrame:
    """(key, item_order, item_number, title, content, item_type, origin) of the documents.

    answers: key, ok, answer, error, as `providers.generate` returns them, stored
    beforehand. An answer's sections are taken as they come, missing parts filled
    in; an answer without any gives the templates; a failed call gives no items.
    """
    got = _listed(answers).filter("ok")
    own = got.filter("drafted").select(key, F.posexplode("secoes").alias("at", "s"))
    number, order = F.concat((F.col("at") + 1).cast("string"), F.lit(".0")), F.col("at") + 1
    own = own.select(
        key, order.alias("item_order"), F.coalesce("s.item_number", number).alias("item_number"), F.coalesce("s.title", F.concat(F.lit(NO_TITLE), order.cast("string"))).alias("title"),
        F.coalesce("s.content", F.lit("")).alias("content"), F.lit("section").alias("item_type"), F.lit("answer").alias("origin"),
    )
    plain = generate.sections(requests.join(got.filter("not drafted").select(key), key, "left_semi"), key)
    return own.unionByName(plain.withColumn("origin", F.lit("template")))


def documents(requests: DataFrame, answers: DataFrame, key: str = "id") -> DataFrame:
    """(key, filename_original, document_type, total_items, file_size_bytes, status, error) of the documents; a failed call is a row with its error."""
    count = F.when(~F.col("ok"), 0).when(F.col("drafted"), F.size("secoes")).otherwise(len(generate.SECTIONS))
    named = F.concat(F.lit(NAME), generate.label(F.col("tipo_contratacao"), generate.TYPES))
    return requests.select(key, "tipo_contratacao").join(_listed(answers), key).select(
        key, named.alias("filename_original"), F.lit("tr").alias("document_type"), count.alias("total_items"), F.coalesce(F.octet_length("answer"), F.lit(0)).alias("file_size_bytes"),
        F.when(F.col("ok"), "parsed").otherwise("error").alias("status"), "error",
    )
