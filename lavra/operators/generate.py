"""Reference documents from parameters: ten sections from templates, and their HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of contract types and criteria.
TYPES = {
    "servicos_continuados": "Serviços Contínuos",
    "obras_engenharia": "Obras e Serviços de Engenharia",
    "tecnologia_informacao": "Tecnologia da Informação e Comunicação",
    "compras_gerais": "Aquisição de Bens / Compras Gerais",
}
CRITERIA = {"menor_preco": "Menor Preço", "maior_desconto": "Maior Desconto", "tecnica_preco": "Técnica e Preço"}
# Sections; {…} stands for a parameter.
SECTIONS = (
    ("DO OBJETO", "O objeto da presente contratação consiste em: {objeto}"),
    ("DA JUSTIFICATIVA DA CONTRATAÇÃO", "{justificativa}"),
    ("DAS ESPECIFICAÇÕES TÉCNICAS E REQUISITOS DA CONTRATAÇÃO", "Os serviços/bens deverão atender aos requisitos mínimos para contratação de {tipo}."),
    ("DO MODELO DE EXECUÇÃO DO CONTRATO", "O prazo de execução/vigência do contrato será de {prazo} meses."),
    ("DO MODELO DE GESTÃO E FISCALIZAÇÃO CONTRATUAL", "A fiscalização do contrato será exercida por comissão/fiscal designado conforme normas internas."),
    ("DOS CRITÉRIOS DE MEDIÇÃO E PAGAMENTO", "O pagamento será efetuado mediante liquidação da nota fiscal/fatura emitida pela contratada."),
    ("DA ESTIMATIVA DE PREÇOS E ADEQUAÇÃO ORÇAMENTÁRIA", "Valor estimado global: {valor}."),
    ("DA GARANTIA CONTRATUAL E ASSISTÊNCIA TÉCNICA", "Exigência de garantia contratual: {garantia}"),
    ("DAS INFRAÇÕES E SANÇÕES ADMINISTRATIVAS", "Aplica-se ao presente contrato o regime de sanções previsto nos Arts. 155 e seguintes da Lei 14.133/2021."),
    ("DA FORMA DE SELEÇÃO E CRITÉRIO DE JULGAMENTO", "A seleção do fornecedor dar-se-á por licitação na modalidade Pregão/Concorrência pelo critério de {criterio}."),
)
WARRANTY = {True: "Sim, no percentual de 5%.", False: "Isento de garantia."}
NO_VALUE = "A definir em pesquisa de mercado"
#: Bounds of the parameters' lengths and of the months.
BOUNDS = {"objeto": (10, 1000), "justificativa": (15, 2000)}
MONTHS = (1, 60)


def label(value: Column, names: dict[str, str]) -> Column:
    known = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.try_element_at(known, value), value)


def valid_request() -> Column:
    ok = F.col("prazo_meses").between(*MONTHS)
    for name, (low, high) in BOUNDS.items():
        ok = ok & F.length(name).between(low, high)
    return F.coalesce(ok, F.lit(False))


def sections(requests: DataFrame, key: str = "id") -> DataFrame:
    """Ten items per request: key, item_order, item_number, title, content, item_type.

    requests: key, tipo_contratacao, objeto, justificativa, valor_estimado, prazo_meses, garantia_exigida, criterio_julgamento.
    """
    values = {
        "objeto": F.col("objeto"),
        "justificativa": F.col("justificativa"),
        "tipo": label(F.col("tipo_contratacao"), TYPES),
        "prazo": F.col("prazo_meses").cast("string"),
        "valor": F.when(F.coalesce("valor_estimado", F.lit(0)) != 0, F.concat(F.lit("R$ "), F.format_number("valor_estimado", 2))).otherwise(NO_VALUE),
        "garantia": F.when(F.col("garantia_exigida"), WARRANTY[True]).otherwise(WARRANTY[False]),
        "criterio": label(F.col("criterio_julgamento"), CRITERIA),
    }

    def filled(template: str) -> Column:
        out = F.lit(template)
        for name, value in values.items():
            if f"{{{name}}}" in template:
                out = F.replace(out, F.lit(f"{{{name}}}"), value)
        return out

    rows = F.array(*(F.struct(F.lit(i + 1).alias("item_order"), F.lit(f"{i + 1}.0").alias("item_number"), F.lit(title).alias("title"), filled(body).alias("content")) for i, (title, body) in enumerate(SECTIONS)))
    return requests.select(key, F.inline(rows)).withColumn("item_type", F.lit("section"))


def html(items: DataFrame, requests: DataFrame, key: str = "id") -> DataFrame:
    """The document as HTML: line breaks become <br/>."""
    part = F.concat(F.lit("<h2>"), F.col("item_number"), F.lit(" "), F.col("title"), F.lit("</h2>\n<p>"), F.replace("content", F.lit("\n"), F.lit("<br/>")), F.lit("</p>\n"))
    listed = items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("item_order", part.alias("part")))).alias("parts"))
    head = F.concat(F.lit("<h1>TERMO DE REFERÊNCIA — "), F.upper(label(F.col("tipo_contratacao"), TYPES)), F.lit("</h1>\n"))
    return listed.join(requests.select(key, "tipo_contratacao"), key).select(key, F.concat(head, F.array_join(F.transform("parts", lambda p: p["part"]), "")).alias("html"))


__all__ = ["CRITERIA", "SECTIONS", "TYPES", "html", "label", "sections", "valid_request"]
