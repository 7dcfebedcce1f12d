"""Mechanical cleaning of converted texts by fixed rules, and signs that a text still needs it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabularium.operators.anchors import ANCHOR, lines

# The letters and patterns that must act on the same text as the rules always did.
LOWER = "a-záàâãéêíóôõúüçñäöüß"
NOISE = r"(?<=\s)[|¦¬~^`]{1,3}(?=\s)"
BROKEN_LINE = rf"(?<![.:;!?—\-])\n(?=[{LOWER}])"
CUT_WORD = rf"([\p{{L}}\p{{N}}_])-\n(?=[{LOWER}])"
# Lines that are nothing but page furniture.
JUNK = (r"(?i)^\s*p[áa]gina\s+\d+\s*(de\s+\d+)?\s*$", r"^\s*\d{1,4}\s*$", r"^\s*[-–—_=~*.]{3,}\s*$", r"^\s*[|¦]+\s*$", r"(?i)^\s*(scanned|digitalizado|www\.|http)")


def repeated_edges(texts: DataFrame, key: str = "master_id", text: str = "corpo", least: int = 4, share: float = 0.7) -> DataFrame:
    """(key, line, times, near): short lines that occur ``least`` times, ``share`` of them within two lines of an anchor.

    One window over the lines of a text finds the nearest anchors; nothing is
    compared pairwise.
    """
    ls = lines(texts, key, text).withColumn("s", F.trim("line")).withColumn("a", F.col("line").rlike(ANCHOR).cast("int"))
    near = F.max("a").over(Window.partitionBy(key).orderBy("line_no").rowsBetween(-2, 2))
    ls = ls.withColumn("near", near).where("a = 0 and length(s) between 3 and 70").where(~F.col("s").rlike(r"^[#>\-*]"))
    per = ls.groupBy(key, F.col("s").alias("line")).agg(F.count(F.lit(1)).alias("times"), F.sum("near").cast("long").alias("near"))
    return per.where(f"times >= {least} and near >= {share} * times")


def signs(texts: DataFrame, key: str = "master_id", text: str = "corpo") -> DataFrame:
    """(key, cut_words, loose_numbers, noise, short_lines, dirty): counts of scanner damage, and whether any is over its bound."""
    once = texts.where(F.col(key).isNotNull() & F.col(text).isNotNull()).groupBy(key).agg(F.max(text).alias("t"))
    n = lambda p: F.regexp_count("t", F.lit(p)).cast("long")
    out = once.select(
        key,
        n(r"[\p{L}\p{N}_]-\n[\p{L}\p{N}_]").alias("cut_words"),
        n(r"(?im)^[ \t]*(p[áa]gina[ \t]+\d+[ \t]+de[ \t]+\d+|\d{1,4})[ \t]*$").alias("loose_numbers"),
        n(r"[|¬~^]{2,}").alias("noise"),
        n(r"(?m)^.{1,2}$").alias("short_lines"),
        F.length("t").alias("size"),
    )
    return out.withColumn("dirty", (F.col("cut_words") > 3) | (F.col("loose_numbers") > 5) | (F.col("noise") > F.col("size") / 500) | (F.col("short_lines") > 30)).drop("size")


def join_hyphens(c: Column) -> Column:
    """Words cut at a line's end joined, where the next line goes on in lower case."""
    return F.regexp_replace(c, CUT_WORD, "$1")


def clean(texts: DataFrame, key: str = "master_id", text: str = "corpo") -> DataFrame:
    """(key, texto, n_joined, n_headers, n_junk): each text after the fixed rules, in their order.

    Words cut at line ends are joined, repeated edge lines and junk lines
    dropped, loose noise taken out, broken lines joined, white space put right
    and anchors set between blank lines. Anchors are never touched.
    """
    once = texts.where(F.col(key).isNotNull() & F.col(text).isNotNull()).groupBy(key).agg(F.max(text).alias("t"))
    joined = once.select(key, join_hyphens(F.col("t")).alias("t"), F.regexp_count("t", F.lit(rf"[\p{{L}}\p{{N}}_]-\n[{LOWER}]")).cast("long").alias("n_joined"))
    heads = repeated_edges(joined, key, "t").groupBy(key).agg(F.collect_set("line").alias("heads"))
    rows = joined.join(heads, key, "left").withColumn("ls", F.split("t", "\n")).withColumn("heads", F.coalesce("heads", F.array().cast("array<string>")))
    is_anchor = lambda x: x.rlike(ANCHOR)
    is_head = lambda x: F.array_contains(F.col("heads"), F.trim(x)) & ~is_anchor(x)
    junk = "|".join(f"(?:{p})" for p in JUNK)
    is_junk = lambda x: x.rlike(junk) & ~is_anchor(x)
    rows = rows.withColumn("n_headers", F.size(F.filter("ls", is_head)).cast("long")).withColumn("n_junk", F.size(F.filter("ls", lambda x: is_junk(x) & ~is_head(x))).cast("long"))
    t = F.array_join(F.filter("ls", lambda x: ~is_head(x) & ~is_junk(x)), "\n")
    t = F.regexp_replace(t, NOISE, " ")
    t = F.regexp_replace(t, BROKEN_LINE, " ")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]{2,}", " "), r"[ \t]+\n", "\n")
    t = F.regexp_replace(t, r"\n*(" + ANCHOR + r")\n*", "\n\n$1\n\n")
    t = F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    return rows.select(key, t.alias("texto"), "n_joined", "n_headers", "n_junk")
