"""Language of a text by the share of function words, the lists being taken from the corpus itself.

The lists are a rule, not a table: the ``k`` commonest words of the documents
labelled with a language. A word's weight is divided by the number of
languages whose list holds it. Weights are whole numbers (parts of ``UNIT``),
so that sums don't depend on their order; scores are whole millionths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOKEN = r"[\p{L}]+"
UNIT = 27_720  # divides by up to 12 languages without a rest


def tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, word, n): lower-case words of each text and how often."""
    return docs.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))).alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))


def function_words(docs: DataFrame, k: int = 40) -> DataFrame:
    """(lang, word, weight): the k words found in most documents of each labelled language, ties by the word."""
    held = docs.where("lang is not null and text is not null").select("lang", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0)))).alias("word"))
    df = held.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("df"))
    top = df.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("df").desc(), "word"))).where(F.col("r") <= k)
    return top.withColumn("langs", F.count(F.lit(1)).over(Window.partitionBy("word"))).select("lang", "word", F.expr(f"{UNIT}L div langs").alias("weight"))


def ranked(docs: DataFrame, k: int = 40, least_words: int = 30) -> DataFrame:
    """(doc_id, lang, score, rk, next): every language of each text of 30 words or more, best first; scores in millionths."""
    t = tokens(docs)
    total = t.groupBy("doc_id").agg(F.sum("n").alias("total")).where(F.col("total") >= least_words)
    lists = function_words(docs, k)
    scored = t.join(F.broadcast(lists), "word").groupBy("doc_id", "lang").agg(F.sum(F.col("n") * F.col("weight")).alias("hits")).join(total, "doc_id")
    scored = scored.select("doc_id", "lang", F.expr(f"(2000000L * hits + {UNIT}L * total) div (2L * {UNIT}L * total)").alias("score"))
    w = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "lang")
    return scored.withColumn("rk", F.row_number().over(w).cast("long")).withColumn("next", F.lead("score", 1, 0).over(w))


def detect(docs: DataFrame, k: int = 40, least_words: int = 30, margin: float = 0.05) -> DataFrame:
    """(doc_id, idioma, score, ambiguous): best language of texts of 30 words or more; the first in name order on ties.

    Shorter texts, and texts none of whose words is listed, give no row.
    """
    best = ranked(docs, k, least_words).where("rk = 1")
    return best.select("doc_id", F.col("lang").alias("idioma"), (F.col("score") / F.lit(1_000_000.0)).alias("score"), (F.col("score") - F.col("next") < round(margin * 1_000_000)).alias("ambiguous"))


def top(docs: DataFrame, n: int = 3, k: int = 40, least_words: int = 30) -> DataFrame:
    """(doc_id, rk, idioma, score): the n best languages of each text."""
    return ranked(docs, k, least_words).where(F.col("rk") <= n).select("doc_id", "rk", F.col("lang").alias("idioma"), (F.col("score") / F.lit(1_000_000.0)).alias("score"))
