"""Page anchors in texts: their order, gaps and doubles, what page a line is on, and what cleaning lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: how a page or position anchor is written.
ANCHOR = r"\{\{(?:p|loc)\.([0-9ivxlcdm]+)\}\}"


def anchors(texts: DataFrame, key: str = "master_id", text: str = "corpo") -> DataFrame:
    """(key, pos, label, n): anchors of each text in order from 1; n is the number of arabic ones, null for roman.

    Texts repeated with equal content count once; null texts give no row.
    """
    once = texts.where(F.col(key).isNotNull() & F.col(text).isNotNull()).groupBy(key).agg(F.max(text).alias("t"))
    got = once.select(key, F.posexplode(F.regexp_extract_all("t", F.lit(ANCHOR), F.lit(1))).alias("i", "label"))
    return got.select(key, (F.col("i") + 1).cast("long").alias("pos"), "label", F.when(F.col("label").rlike("^[0-9]+$"), F.col("label").try_cast("long")).alias("n"))


def out_of_order(a: DataFrame, key: str = "master_id") -> DataFrame:
    """(key, pos, n, before): arabic anchors lower than the one before them."""
    w = Window.partitionBy(key).orderBy("pos")
    return a.where("n is not null").withColumn("before", F.lag("n").over(w)).where("n < before").select(key, "pos", "n", "before")


def doubles(a: DataFrame, key: str = "master_id") -> DataFrame:
    """(key, label, times): labels set more than once in a text."""
    return a.groupBy(key, "label").agg(F.count(F.lit(1)).alias("times")).where("times > 1")


def gaps(a: DataFrame, key: str = "master_id") -> DataFrame:
    """(key, first, last, missing): how many page numbers between the first and last have no anchor."""
    per = a.where("n is not null").groupBy(key).agg(F.min("n").alias("first"), F.max("n").alias("last"), F.count_distinct("n").alias("c"))
    return per.select(key, "first", "last", (F.col("last") - F.col("first") + 1 - F.col("c")).alias("missing")).where("missing > 0")


def ends(a: DataFrame, key: str = "master_id") -> DataFrame:
    """(key, first_label, last_label, n_anchors) of each text."""
    return a.groupBy(key).agg(F.min_by("label", "pos").alias("first_label"), F.max_by("label", "pos").alias("last_label"), F.count(F.lit(1)).alias("n_anchors"))


def integrity(texts: DataFrame, a: DataFrame, key: str = "master_id") -> DataFrame:
    """(key, n_anchors, n_double, n_disorder, n_missing, verdict): none, doubles or disorder fail, gaps warn."""
    base = texts.where(F.col(key).isNotNull()).select(key).distinct()
    total = a.groupBy(key).agg(F.count(F.lit(1)).alias("n_anchors"))
    dbl = doubles(a, key).groupBy(key).agg(F.count(F.lit(1)).alias("n_double"))
    dis = out_of_order(a, key).groupBy(key).agg(F.count(F.lit(1)).alias("n_disorder"))
    gap = gaps(a, key).select(key, F.col("missing").alias("n_missing"))
    j = base.join(total, key, "left").join(dbl, key, "left").join(dis, key, "left").join(gap, key, "left").fillna(0)
    return j.withColumn("verdict", F.when((F.col("n_anchors") == 0) | (F.col("n_double") > 0) | (F.col("n_disorder") > 0), "fail").when(F.col("n_missing") > 0, "warn").otherwise("ok"))


def fenced(texts: DataFrame, key: str = "master_id", text: str = "corpo") -> DataFrame:
    """(key, fenced): does a code fence open before an anchor, with no other backtick between? Null texts give no row."""
    once = texts.where(F.col(key).isNotNull() & F.col(text).isNotNull()).groupBy(key).agg(F.max(text).alias("t"))
    return once.select(key, F.col("t").rlike(r"```[^`]*\{\{p\.").alias("fenced"))


def difference(before: DataFrame, after: DataFrame, key: str = "master_id") -> DataFrame:
    """(key, label, change, times): anchors lost or invented between two versions, as multisets."""
    b = before.groupBy(key, "label").agg(F.count(F.lit(1)).alias("b"))
    c = after.groupBy(key, "label").agg(F.count(F.lit(1)).alias("c"))
    d = b.join(c, [key, "label"], "full").select(key, "label", (F.coalesce("c", F.lit(0)) - F.coalesce("b", F.lit(0))).alias("d")).where("d != 0")
    return d.select(key, "label", F.when(F.col("d") < 0, "lost").otherwise("invented").alias("change"), F.abs("d").alias("times"))


def lines(texts: DataFrame, key: str = "master_id", text: str = "corpo") -> DataFrame:
    """(key, line_no, line): the lines of each text from 1; equal repeated rows count once."""
    once = texts.where(F.col(key).isNotNull() & F.col(text).isNotNull()).groupBy(key).agg(F.max(text).alias("t"))
    return once.select(key, F.posexplode(F.split("t", "\n")).alias("i", "line")).select(key, (F.col("i") + 1).cast("long").alias("line_no"), "line")


def page_of_lines(texts: DataFrame, key: str = "master_id", text: str = "corpo") -> DataFrame:
    """(key, line_no, page): as-of, the last anchor at or before each non-empty line that isn't an anchor itself."""
    ls = lines(texts, key, text).withColumn("a", F.nullif(F.regexp_extract("line", r"^\s*" + ANCHOR + r"\s*$", 1), F.lit("")))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return ls.withColumn("page", F.last("a", ignorenulls=True).over(w)).where("a is null and trim(line) != '' and page is not null").select(key, "line_no", "page")


def page_label(physical, roman: int, offset: int):
    """Printed label of a physical page: roman up to page ``roman``, arabic less ``offset`` behind it."""
    from tabularium.operators.notes import to_roman

    return F.when(physical <= roman, to_roman(physical)).otherwise((physical - offset).cast("string"))
