"""Queries of the general training-data problems (2 and 7)."""

from __future__ import annotations

from tabularium.operators import multivalue, references
from tabularium.sources.tables import table

QUERIES = {
    "p2_found": lambda spark, d: references.found(table(spark, d, "notes"), table(spark, d, "removals")),
    "p2_report": lambda spark, d: references.summary(references.found(table(spark, d, "notes"), table(spark, d, "removals"))),
    "p2_gaps": lambda spark, d: references.gaps(table(spark, d, "notes"), table(spark, d, "removals")),
    "p7_found": lambda spark, d: multivalue.found(table(spark, d, "notes"), table(spark, d, "vocabulary")),
    "p7_values": lambda spark, d: multivalue.split_values(table(spark, d, "notes").select("note_id", "area", "autoria").distinct(), ("area", "autoria"), vocabulary=table(spark, d, "vocabulary")),
}

SQL = {
    "p2_found": references.FOUND_SQL,
    "p2_gaps": references.GAPS_SQL,
    "p2_report": f"select campo, periodo, caso, count(*) n_refs, count(distinct note_id) n_notes from ({references.FOUND_SQL}) group by campo, periodo, caso",
}
