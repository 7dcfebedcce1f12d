"""Long texts cut into index and slices by the fixed-size rule: blocks that are never broken, cuts at titles first.

The running word count starts afresh at each cut, so it isn't a window sum.
Blocks are folded by ``aggregate``; only their number, level and words go in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabularium.operators.anchors import ANCHOR, lines


def blocks(texts: DataFrame, key: str = "master_id", text: str = "corpo") -> DataFrame:
    """(key, block, kind, level, words, first_line): paragraphs, titles and anchors, none of which may be cut.

    A title (one to four #) or a lone anchor is a block; other lines run on to
    the next blank line. One blank line behind lines with a quote (``>``) among
    them doesn't end their block. Numbers count from 1.
    """
    ls = lines(texts, key, text)
    title = F.col("line").rlike(r"^#{1,4}\s+\S")
    anchor = F.trim("line").rlike("^" + ANCHOR + "$")
    blank = F.trim("line") == ""
    ls = ls.withColumn("kind", F.when(title, "title").when(anchor, "anchor").when(blank, "blank").otherwise("text"))
    w = Window.partitionBy(key).orderBy("line_no")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    quote = (F.col("kind") == "text") & F.trim("line").startswith(">")
    last = lambda cond: F.coalesce(F.max(F.when(cond, F.col("line_no"))).over(so_far), F.lit(0))
    ls = ls.withColumn("quoted", last(quote) > last(F.col("kind") != "text"))
    goes_on = (F.lag("kind").over(w) == "blank") & (F.lag("kind", 2).over(w) == "text") & F.lag("quoted", 2).over(w)
    begins = (F.coalesce(F.lag("kind").over(w), F.lit("blank")) != "text") & ~F.coalesce(goes_on, F.lit(False))
    opens = (F.col("kind").isin("title", "anchor")) | ((F.col("kind") == "text") & begins)
    ls = ls.withColumn("open", F.when(opens, 1).otherwise(0)).where("kind != 'blank'").withColumn("block", F.sum("open").over(w))
    words = F.size(F.filter(F.split(F.col("line"), r"\s+"), lambda x: x != ""))
    level = F.when(F.col("kind") == "title", F.length(F.regexp_extract("line", "^(#+)", 1)))
    return ls.groupBy(key, "block").agg(F.min_by("kind", "line_no").alias("kind"), F.max(level).cast("long").alias("level"), F.sum(words).alias("words"), F.min("line_no").alias("first_line"))


def slice_numbers(b: DataFrame, target: int, key: str = "master_id") -> DataFrame:
    """(key, block, parte): the slice each block falls in, from 1.

    A title of level 1 or 2 cuts once 0.4 of the target is reached; else a block
    that would pass 1.3 of the target cuts once 0.5 of it is reached.
    """
    most = int(target * 1.3)
    seq = b.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("block").cast("long").alias("block"), F.coalesce("level", F.lit(9)).cast("long").alias("level"), F.col("words").cast("long").alias("words")))).alias("bs"))
    step = f"""
      aggregate(bs, named_struct('parte', 1L, 'n', 0L, 'out', cast(array() as array<struct<block: bigint, parte: bigint>>)), (acc, x) ->
        case when acc.n > 0 and ((x.level <= 2 and acc.n >= {target} * 0.4) or (x.level > 2 and acc.n + x.words > {most} and acc.n >= {target} * 0.5))
          then named_struct('parte', acc.parte + 1L, 'n', x.words, 'out', array_append(acc.out, named_struct('block', x.block, 'parte', acc.parte + 1L)))
          else named_struct('parte', acc.parte, 'n', acc.n + x.words, 'out', array_append(acc.out, named_struct('block', x.block, 'parte', acc.parte))) end).out
    """
    return seq.select(key, F.explode(F.expr(step)).alias("s")).select(key, "s.block", "s.parte")


def slices(texts: DataFrame, target: int = 1200, key: str = "master_id", text: str = "corpo") -> DataFrame:
    """(key, parte, words, n_blocks, first_line): the slices of each text."""
    b = blocks(texts, key, text)
    j = b.join(slice_numbers(b, target, key), [key, "block"])
    return j.groupBy(key, "parte").agg(F.sum("words").alias("words"), F.count(F.lit(1)).alias("n_blocks"), F.min("first_line").alias("first_line"))


def delivered(texts: DataFrame, target: int = 1200, least: int = 4000, key: str = "master_id", text: str = "corpo") -> DataFrame:
    """(key, words, n_slices, whole): works under ``least`` words, or of fewer than two slices, are delivered whole."""
    s = slices(texts, target, key, text).groupBy(key).agg(F.sum("words").cast("long").alias("words"), F.count(F.lit(1)).alias("n_slices"))
    return s.withColumn("whole", (F.col("words") < least) | (F.col("n_slices") < 2))


def navigation(notes: DataFrame) -> DataFrame:
    """(note_id, work, parte, previous, following): neighbours of each slice in its work."""
    from tabularium.functions.text import is_blank, link_stem, squeeze
    from tabularium.operators.notes import once

    n = once(notes, "stem", "parte", "obra").where(~is_blank(F.col("parte")))
    s = n.select("note_id", "stem", link_stem(F.col("obra")).alias("work"), squeeze(F.col("parte")).try_cast("bigint").alias("parte")).where("work is not null and parte is not null")
    w = Window.partitionBy("work").orderBy("parte", "stem")
    return s.select("note_id", "work", "parte", F.lag("stem").over(w).alias("previous"), F.lead("stem").over(w).alias("following"))


def slice_name(prefix: str, n: Column) -> Column:
    """File stem of slice n: two digits at least."""
    return F.concat(F.lit(prefix), F.format_string("_p%02d", n))
