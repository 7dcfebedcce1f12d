"""The source type of a document, told from its name and its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularium.functions import dims

LEAST = 2  # score under which the type stays undecided
STRONG = 4  # score of the text alone that is trusted without the name


def inferred_type(docs: DataFrame, name: str = "obra", text: str = "text") -> DataFrame:
    """(doc_id, tipo_fonte, score, confianca): one row a document; type '' and 'baixa' where nothing scores ``LEAST``.

    A group of keywords in the name counts 2, a rule of the text its weight,
    each once; of equal scores the type named first wins, names before texts.
    'alta': name and text agree, or the text is ``STRONG``; 'media' otherwise,
    and where both speak and the name speaks for other types. Rows of one
    document are taken together; null ids are left out.
    """
    n = len(dims.NAME_RULES)
    seen = [F.arrays_overlap(F.transform(F.array(*map(F.lit, keys)), lambda k: F.lower(F.col(name)).contains(k)), F.array(F.lit(True))) for keys, _ in dims.NAME_RULES]
    # whether Unicode letters, digits and spaces count as such is part of the rules
    seen += [F.col(text).rlike(f"(?iU){p}") for p, _, _ in dims.CONTENT_RULES]
    rules = [(t, 2) for _, t in dims.NAME_RULES] + [(t, w) for _, t, w in dims.CONTENT_RULES]
    mask = sum((F.when(s, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, s in enumerate(seen)), F.lit(0).cast("long"))
    once = docs.where("doc_id is not null").select("doc_id", mask.alias("m")).groupBy("doc_id").agg(F.bit_or("m").alias("m"))

    def hit(i: int) -> Column:
        return F.col("m").bitwiseAND(F.lit(1 << i).cast("long")) != 0

    def scored(kind: str) -> Column:
        own = [i for i, (t, _) in enumerate(rules) if t == kind]
        points = lambda ids: sum((F.when(hit(i), rules[i][1]).otherwise(0) for i in ids), F.lit(0)).cast("long")
        named, told = points([i for i in own if i < n]), points([i for i in own if i >= n])
        first = F.coalesce(*[F.when(hit(i), -i) for i in own], F.lit(-len(rules)))
        return F.struct((named + told).alias("score"), first.alias("first"), F.lit(kind).alias("kind"), named.alias("named"), told.alias("told"))

    kinds = list(dict.fromkeys(t for t, _ in rules))
    best = once.select("doc_id", "m", F.array_max(F.array(*map(scored, kinds))).alias("b"))
    both = (F.col("m").bitwiseAND(F.lit((1 << n) - 1).cast("long")) != 0) & (F.shiftright("m", n) != 0)
    sure = ((F.col("b.named") > 0) & (F.col("b.told") > 0)) | ((F.col("b.told") >= STRONG) & ~(both & (F.col("b.named") == 0)))
    decided = F.col("b.score") >= LEAST
    return best.select(
        "doc_id",
        F.when(decided, F.col("b.kind")).otherwise("").alias("tipo_fonte"),
        F.col("b.score").alias("score"),
        F.when(~decided, "baixa").when(sure, "alta").otherwise("media").alias("confianca"),
    )
