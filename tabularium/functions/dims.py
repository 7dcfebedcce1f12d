"""Dimension rows of the collection's profile, as small DataFrames. Fixed values, in the order that decides ties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# kinds of note, with the code used in file names
KINDS = (("Doutrina", "DOUT"), ("Legislação", "LEGIS"), ("Jurisprudência", "JURIS"), ("Súmula", "SUM"), ("Artigo", "ART"), ("Parecer", "PAR"), ("Modelo", "MODELO"))
# part of a typed area -> area
AREA_KEYS = (
    ("tribut", "Tributário"), ("fiscal", "Tributário"), ("civil", "Civil"), ("penal", "Penal"), ("criminal", "Penal"), ("trabalh", "Trabalhista"),
    ("laboral", "Trabalhista"), ("administrativ", "Administrativo"), ("constitucional", "Constitucional"), ("empresarial", "Empresarial"),
    ("comercial", "Empresarial"), ("societ", "Empresarial"), ("consumidor", "Consumidor"), ("previdenci", "Previdenciário"), ("ambient", "Ambiental"),
    ("famil", "Família"), ("processual", "Processual"), ("processo", "Processual"), ("economic", "Econômico"), ("financeir", "Financeiro"),
    ("internacional", "Internacional"), ("eleitoral", "Eleitoral"),
)
AREA_CODES = (
    ("Tributário", "TRIB"), ("Civil", "CIVIL"), ("Penal", "PEN"), ("Trabalhista", "TRAB"), ("Administrativo", "ADMIN"), ("Constitucional", "CONST"),
    ("Empresarial", "EMPR"), ("Consumidor", "CONS"), ("Previdenciário", "PREV"), ("Ambiental", "AMB"), ("Família", "FAM"), ("Processual", "PROC"),
    ("Econômico", "ECON"), ("Financeiro", "FIN"), ("Internacional", "INTL"), ("Eleitoral", "ELEI"),
)
# kinds a source type may carry
KINDS_BY_SOURCE = (
    ("livro", "Doutrina"), ("livro_ebook_leitor", "Doutrina"), ("livro_ebook_online", "Doutrina"), ("capitulo_livro", "Doutrina"),
    ("artigo_periodico", "Artigo"), ("artigo_periodico", "Doutrina"), ("trabalho_academico", "Doutrina"), ("trabalho_academico", "Artigo"),
    ("evento", "Doutrina"), ("evento", "Artigo"), ("legislacao", "Legislação"), ("jurisprudencia", "Jurisprudência"), ("jurisprudencia", "Súmula"),
    ("ato_administrativo", "Parecer"), ("ato_administrativo", "Legislação"),
    ("documento_online", "Doutrina"), ("documento_online", "Legislação"), ("documento_online", "Jurisprudência"), ("documento_online", "Súmula"),
    ("documento_online", "Artigo"), ("documento_online", "Parecer"), ("documento_online", "Modelo"),
    ("verbete", "Doutrina"), ("norma_tecnica", "Legislação"), ("norma_tecnica", "Doutrina"),
    ("audiovisual", "Doutrina"), ("audiovisual", "Legislação"), ("audiovisual", "Jurisprudência"), ("audiovisual", "Súmula"),
    ("audiovisual", "Artigo"), ("audiovisual", "Parecer"), ("audiovisual", "Modelo"),
    ("correspondencia", "Parecer"), ("correspondencia", "Modelo"), ("correspondencia", "Doutrina"), ("peca_interna", "Modelo"), ("peca_interna", "Parecer"),
)
# source types whose texts must bear page anchors
ANCHORED = ("livro", "livro_ebook_leitor", "livro_ebook_online", "capitulo_livro", "artigo_periodico", "trabalho_academico", "evento")
STATUS = ("Vigente", "A-conferir", "Revogado", "Alterado", "Superado", "Modulado")
STATUS_OK, STATUS_PENDING, STATUS_OLD = "Vigente", ("A-conferir",), ("Revogado", "Superado", "Alterado", "Modulado")
TRUST = ("Oficial", "Doutrinária", "Interna", "A-conferir", "Conferida")
KIND_GROUPS = (("doutrina", ("Doutrina", "Artigo")), ("jurisprudencia", ("Jurisprudência", "Súmula")), ("legislacao", ("Legislação", "Parecer")))
# identifiers cited in texts; each pattern has one group, its digits are the identifier
IDENTIFIERS = (
    ("lei", r"\blei(?:\s+complementar)?\s*(?:n[ºo°.]{0,2})?\s*([\d][\d.]{2,9})"),
    ("decreto", r"\bdecreto(?:-lei)?\s*(?:n[ºo°.]{0,2})?\s*([\d][\d.]{2,9})"),
    ("mp", r"\bmedida\s+provis[óo]ria\s*(?:n[ºo°.]{0,2})?\s*([\d][\d.]{1,9})"),
    ("emenda", r"\bemenda\s+constitucional\s*(?:n[ºo°.]{0,2})?\s*(\d{1,3})"),
    ("tema", r"\btema\s*(?:repetitivo\s*)?(?:n[ºo°.]{0,2})?\s*(\d{1,5})"),
    ("sumula", r"\bs[úu]mula\s*(?:vinculante\s*)?(?:n[ºo°.]{0,2})?\s*(\d{1,4})"),
    ("processo", r"(\d{7}-?\d{2}\.\d{4}\.\d\.\d{2}\.\d{4})"),
)
# norms that become hubs however seldom they are cited
NOTABLE = (
    ("lei", "5172"), ("lei", "10406"), ("lei", "13105"), ("lei", "6830"), ("lei", "8078"), ("lei", "8429"),
    ("lei", "9784"), ("lei", "12016"), ("lei", "4320"), ("lei", "8666"), ("lei", "14133"), ("decreto", "70235"),
)
# signs in a text's content that tell its source type, with their weight; matched whatever the case
CONTENT_RULES = (
    (r"\bLEI\s+N[ºo°\.]", "legislacao", 2), (r"\bDECRETO(-LEI)?\s+N[ºo°\.]", "legislacao", 2), (r"\bMEDIDA\s+PROVIS[ÓO]RIA\b", "legislacao", 2),
    (r"PRESID[ÊE]NCIA\s+DA\s+REP[ÚU]BLICA", "legislacao", 2), (r"O\s+CONGRESSO\s+NACIONAL\s+decreta", "legislacao", 2),
    (r"\bArt\.\s*1[ºo°]", "legislacao", 1), (r"\bAC[ÓO]RD[ÃA]O\b", "jurisprudencia", 2), (r"\bRELATOR[A]?\s*:", "jurisprudencia", 2),
    (r"\bEMENTA\s*:", "jurisprudencia", 1),
    (r"RECURSO\s+ESPECIAL|APELA[ÇC][ÃA]O\s+C[ÍI]VEL|AGRAVO\s+DE\s+INSTRUMENTO|HABEAS\s+CORPUS", "jurisprudencia", 2),
    (r"\d{7}-?\d{2}\.\d{4}\.\d\.\d{2}\.\d{4}", "jurisprudencia", 2), (r"\bISBN\b", "livro", 2), (r"©|\bCopyright\b", "livro", 1),
    (r"\bSum[áa]rio\b", "livro", 1), (r"\bPref[áa]cio\b", "livro", 1), (r"\bDOI\s*:", "artigo_periodico", 2), (r"\bAbstract\b|\bResumo\s*:", "artigo_periodico", 1),
    (r"\bPORTARIA\s+N[ºo°\.]|\bINSTRU[ÇC][ÃA]O\s+NORMATIVA|\bRESOLU[ÇC][ÃA]O\s+N[ºo°\.]", "ato_administrativo", 2),
    (r"EXCELENT[ÍI]SSIMO|Nestes\s+termos,?\s+pede\s+deferimento", "peca_interna", 2),
)
# parts of a document's name that tell its source type; a group counts once
NAME_RULES = (
    (("acordao", "acórdão", "resp ", "resp-", "agravo", "apela", "habeas", "sumula", "súmula", "jurisprud"), "jurisprudencia"),
    (("lei", "decreto", "codigo", "código", "constituic", "medida-provisoria", "emenda"), "legislacao"),
    (("portaria", "instrucao-normativa", "instrução", "resolucao", "resolução", "edital", "parecer", "oficio", "ofício"), "ato_administrativo"),
    (("tese", "dissertacao", "dissertação", "monografia", "tcc"), "trabalho_academico"),
    (("artigo", "revista", "periodico", "periódico"), "artigo_periodico"),
    (("peticao", "petição", "contestacao", "contestação", "recurso", "minuta", "contrato"), "peca_interna"),
)


def rows(spark: SparkSession, values: tuple, schema: str) -> DataFrame:
    """A dimension as a DataFrame; single values become one column."""
    return spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema)


def area_keys(spark: SparkSession) -> DataFrame:
    return rows(spark, tuple((i, k, a) for i, (k, a) in enumerate(AREA_KEYS, 1)), "ord int, key string, area string")


def kinds_by_source(spark: SparkSession) -> DataFrame:
    return rows(spark, KINDS_BY_SOURCE, "tipo_fonte string, tipo string")


def self_test() -> list[str]:
    """Names used by one dimension and missing from another; empty if all refer to each other."""
    kinds = {k for k, _ in KINDS}
    wrong = [f"kind {k}" for _, k in KINDS_BY_SOURCE if k not in kinds]
    wrong += [f"group {k}" for _, ks in KIND_GROUPS for k in ks if k not in kinds]
    wrong += [f"area {a}" for a in {a for _, a in AREA_KEYS} ^ {a for a, _ in AREA_CODES}]
    wrong += [f"status {s}" for s in (STATUS_OK, *STATUS_PENDING, *STATUS_OLD) if s not in STATUS]
    return wrong


def sql_values(values: tuple, *names: str) -> str:
    """The same rows as a VALUES list for a DuckDB oracle."""
    cell = lambda v: str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(cell(x) for x in (v if isinstance(v, tuple) else (v,))) + ")" for v in values)
    return f"(values {body}) as t({', '.join(names)})"


# fields a source type must have, of those that notes keep
REQUIRED = (
    ("livro", "autoria"), ("livro", "titulo"), ("livro", "ano"), ("livro_ebook_leitor", "autoria"), ("livro_ebook_leitor", "titulo"), ("livro_ebook_leitor", "ano"),
    ("livro_ebook_online", "autoria"), ("livro_ebook_online", "titulo"), ("livro_ebook_online", "ano"),
    ("capitulo_livro", "autoria"), ("capitulo_livro", "titulo"), ("capitulo_livro", "ano"), ("capitulo_livro", "pagina_inicio"), ("capitulo_livro", "pagina_fim"),
    ("artigo_periodico", "autoria"), ("artigo_periodico", "titulo"), ("artigo_periodico", "pagina_inicio"), ("artigo_periodico", "pagina_fim"), ("artigo_periodico", "ano"),
    ("trabalho_academico", "autoria"), ("trabalho_academico", "titulo"), ("trabalho_academico", "ano"), ("evento", "autoria"), ("evento", "titulo"), ("evento", "ano"),
    ("legislacao", "autoria"), ("legislacao", "ano"), ("documento_online", "titulo"), ("documento_online", "ano"), ("verbete", "titulo"), ("verbete", "ano"),
    ("norma_tecnica", "autoria"), ("norma_tecnica", "titulo"), ("norma_tecnica", "ano"), ("audiovisual", "titulo"), ("audiovisual", "autoria"), ("audiovisual", "ano"),
    ("correspondencia", "autoria"), ("correspondencia", "titulo"), ("peca_interna", "titulo"),
)
