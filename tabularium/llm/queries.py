"""Queries of the problems on text, and their SQL where SQL can say the same."""

from __future__ import annotations

from tabularium.llm import canonical, chunks, language, mixture, names, scanned, subjects, tokens
from tabularium.sources.tables import table

QUERIES = {
    "p1_found": lambda spark, d: canonical.found(table(spark, d, "notes"), table(spark, d, "vocabulary")),
    "p1_misses": lambda spark, d: canonical.misses(table(spark, d, "notes"), table(spark, d, "vocabulary")),
    "p3_found": lambda spark, d: names.found(table(spark, d, "author_names")),
    "p3_groups": lambda spark, d: names.groups(table(spark, d, "author_names")),
    "p4_found": lambda spark, d: chunks.found(table(spark, d, "masters"), table(spark, d, "slice_limits")),
    "p4_pieces": lambda spark, d: chunks.split(table(spark, d, "masters"), table(spark, d, "slice_limits")),
    "p5_found": lambda spark, d: scanned.found(table(spark, d, "masters")),
    "p5_repaired": lambda spark, d: scanned.repair(table(spark, d, "masters")),
    "p6_found": lambda spark, d: language.found(table(spark, d, "notes")),
    "p6_languages": lambda spark, d: language.detect(table(spark, d, "notes")).distinct(),
    "p8_ids": lambda spark, d: tokens.encode(table(spark, d, "documents")),
    "p9_mix": lambda spark, d: mixture.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0],
    "p9_shares": lambda spark, d: mixture.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1],
    "p9_sequence": lambda spark, d: mixture.sequence(table(spark, d, "documents"), table(spark, d, "mix_targets")),
    "p10_found": lambda spark, d: subjects.found(table(spark, d, "documents"), table(spark, d, "doc_labels"), table(spark, d, "subjects")),
    "p10_corpus": lambda spark, d: subjects.composition(table(spark, d, "documents"), table(spark, d, "doc_labels"), table(spark, d, "subjects")),
}

SQL = {
    "p4_found": r"""
with l as (select * from slice_limits),
m as (select master_id, len(regexp_extract_all(corpo, '\S+')) n, case when tipo_fonte in (select tipo_fonte from l) then tipo_fonte else 'outro' end k from masters)
select distinct m.master_id from m join l on l.tipo_fonte = m.k where m.n > l.teto and m.master_id is not null
""",
}
