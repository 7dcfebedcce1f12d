"""Works connected by the rare identifiers they share: extraction, weights, best relations, hubs, catalogue.

A work is an index with its slices, or a note that is neither; its identifiers
are those of all its notes. Identifiers in more than half of all works are left
out before the self-join, which is what keeps it from growing with the square
of a common one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabularium.functions import dims
from tabularium.functions.text import is_blank, link_stem
from tabularium.operators.notes import once
from tabularium.sources.tables import cut, spread

PLACES = 6  # decimals at which weights are compared; sums of doubles depend on their order


def extract(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, label, num, n): identifiers in each text and how often, by the profile's patterns."""
    got = [
        texts.select(key, F.lit(label).alias("label"), F.explode(F.regexp_extract_all(text, F.lit("(?iu)" + p), F.lit(1))).alias("raw"))
        for label, p in dims.IDENTIFIERS
    ]
    out = got[0]
    for g in got[1:]:
        out = out.unionByName(g)
    return out.select(key, "label", F.regexp_replace("raw", r"\D", "").alias("num")).where("num != ''").groupBy(key, "label", "num").agg(F.count(F.lit(1)).alias("n"))


def work_of(notes: DataFrame) -> DataFrame:
    """(note_id, stem, work): the stem of the index a slice links to, else the note's own stem."""
    n = once(notes, "stem", "parte", "obra")
    target = F.when(~is_blank(F.col("parte")), link_stem(F.col("obra")))
    return n.where("stem is not null").select("note_id", "stem", F.coalesce(target, F.col("stem")).alias("work"))


def work_identifiers(notes: DataFrame, mentions: DataFrame) -> DataFrame:
    """(work, label, num, n): mentions of all notes of a work added up; a mention delivered twice counts once, null labels don't."""
    m = mentions.where("mention_id is not null and label is not null and num is not null").groupBy("mention_id").agg(*[F.max(c).alias(c) for c in ("note_id", "label", "num", "n")])
    # added up per note first: a note or norm that holds a third of all rows shrinks before the join
    per = m.groupBy("note_id", "label", "num").agg(F.sum("n").alias("n"))
    return per.join(work_of(notes).select("note_id", "work"), "note_id").groupBy("work", "label", "num").agg(F.sum("n").alias("n"))


def document_frequency(ids: DataFrame) -> DataFrame:
    """(label, num, df): works that cite each identifier."""
    return ids.groupBy("label", "num").agg(F.count(F.lit(1)).alias("df"))


def _weighted(ids: DataFrame) -> DataFrame:
    """(label, num, df, w): identifiers of 2 works at least and half of them at most, weighted ln(N / df)."""
    total = ids.select("work").distinct().agg(F.count(F.lit(1)).alias("N"))
    d = document_frequency(ids).join(F.broadcast(total))
    return d.where((F.col("df") >= 2) & (F.col("df") <= F.ceil(F.col("N") / 2))).select("label", "num", "df", F.log(F.col("N") / F.col("df")).alias("w"))


WORKS = 50_000  # works of a block at most; any two blocks are compared in a place of their own
LOOKUP = 500_000  # works whose names are broadcast


def numbered(one: DataFrame) -> DataFrame:
    """(work, id): works numbered from 0 in the order of their names."""
    names = one.select("work").distinct()
    s = cut(names.repartitionByRange("work").sortWithinPartitions("work").withColumn("p", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id()))
    first = s.groupBy(F.col("p").alias("q")).agg(F.min("i").alias("i0"), F.count(F.lit(1)).alias("c"))
    start = first.withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return s.join(F.broadcast(start), F.col("p") == F.col("q")).select("work", (F.col("i") - F.col("i0") + F.col("before")).alias("id"))


def cells(one: DataFrame, ids: DataFrame, works: int = WORKS, both: bool = False) -> tuple[DataFrame, int]:
    """one(work, label, num, w), ids(work, id) -> ((i, j, w, a, b), width): for blocks i <= j (any, if ``both``) of ``width`` works and each identifier, the works of either block that have it.

    The lists of works are what travels, not their pairs.
    """
    n = ids.count()
    width = max(1, min(works, -(-n // max(1, int((2 * spread(ids.sparkSession)) ** 0.5)))))
    block = cut(one.join(ids, "work").groupBy("label", "num", F.floor(F.col("id") / width).cast("int").alias("k")).agg(F.first("w").alias("w"), F.array_sort(F.collect_list(F.col("id").cast("int"))).alias("l")))
    met = block.select("label", "num", F.col("k").alias("i"), "w", F.col("l").alias("a")).join(block.select("label", "num", F.col("k").alias("j"), F.col("l").alias("b")), ["label", "num"]).where("(i = j and size(a) > 1) or " + ("i != j" if both else "i < j"))
    return met.select("i", "j", "label", "num", "w", "a", "b").repartition(max(spread(ids.sparkSession), (-(-n // width) + 1) ** 2), "i", "j").sortWithinPartitions("i", "j", "label", "num"), width


def _sums(batches: Iterator[pd.DataFrame], width: int, both: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of ``cells`` -> (a, partners b, how many identifiers they share, their summed weights), a < b unless ``both``, cell by cell and work by work."""

    def whole(rows: list[tuple]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        (i, j), lists = rows[0][:2], [np.asarray(r[4], dtype="int64") - width * rows[0][1] for r in rows]
        weight = np.array([r[2] for r in rows])
        at = np.repeat(np.arange(len(rows)), [len(r[3]) for r in rows])
        who = np.concatenate([r[3] for r in rows])
        order = np.argsort(who, kind="stable")
        at, who = at[order], who[order]
        ends = np.flatnonzero(np.diff(who, append=-1)) + 1
        for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist()):
            own, a = at[lo:hi], int(who[lo])
            to = np.concatenate([lists[k] for k in own])
            w = np.repeat(weight[own], [len(lists[k]) for k in own])
            if i == j:
                later = to != a - width * i if both else to > a - width * i
                to, w = to[later], w[later]
            if len(to) * 20 > width:
                n = np.bincount(to, minlength=width)
                b = np.flatnonzero(n)
                n, s = n[b], np.bincount(to, w, minlength=width)[b]
            else:
                b, back = np.unique(to, return_inverse=True)
                n, s = np.bincount(back, minlength=len(b)), np.bincount(back, w, minlength=len(b))
            if len(b):
                yield a, b + width * j, n, s

    rows: list[tuple] = []
    for batch in batches:
        for i, j, w, a, b in zip(batch["i"], batch["j"], batch["w"], batch["a"], batch["b"]):
            if rows and rows[0][:2] != (i, j):
                yield from whole(rows)
                rows = []
            rows.append((i, j, w, a, b))
    if rows:
        yield from whole(rows)


def _tables(parts: Iterator[tuple], names: list[str], size: int = 200_000) -> Iterator[pd.DataFrame]:
    """Tables of about ``size`` rows from parts (a, columns...)."""
    held, n = [], 0
    for a, *cols in parts:
        held.append([np.full(len(cols[0]), a), *cols])
        n += len(cols[0])
        if n >= size:
            yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*held)))))
            held, n = [], 0
    if held:
        yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*held)))))


def _named(df: DataFrame, ids: DataFrame, *cols: str) -> DataFrame:
    """Numbers of works replaced by their names; a lookup of up to ``LOOKUP`` works is broadcast."""
    few = ids.count() <= LOOKUP
    for c in cols:
        names = ids.select(F.col("work").alias(f"name_{c}"), F.col("id").alias(c))
        df = df.join(F.broadcast(names) if few else names, c).drop(c).withColumnRenamed(f"name_{c}", c)
    return df



def shared(one: DataFrame, works: int = WORKS) -> DataFrame:
    """one(work, label, num) -> (work, other, common): all pairs of works that share identifiers, work < other, none of them shuffled."""
    ids = cut(numbered(one))
    met, width = cells(one.withColumn("w", F.lit(1.0)), ids, works)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _tables(((a, b, n) for a, b, n, _ in _sums(batches, width)), ["work", "other", "common"])

    return _named(met.select("i", "j", "w", "a", "b").mapInPandas(run, "work long, other long, common long"), ids, "work", "other").select("work", "other", "common")


def relations(ids: DataFrame, least: float = 2.0, top: int = 8, common: int | None = None, works: int = WORKS) -> DataFrame:
    """(work, other, common, weight, rk): each work's ``top`` related works by the summed weight of shared identifiers.

    Ties go to the name of the other work. Null works are left out. Pairs are
    summed where two blocks of works meet; from there only the ``top`` of each
    work in each meeting go on, which hold the ``top`` of all. ``common`` is
    taken for older callers; it makes no difference.
    """
    one = cut(ids.where("work is not null").select("work", "label", "num").join(_weighted(ids), ["label", "num"]))
    no = cut(numbered(one))
    met, width = cells(one, no, works, both=True)

    def best(b: np.ndarray, n: np.ndarray, s: np.ndarray) -> list[np.ndarray]:
        s = np.round(s, PLACES)
        last = max(least, np.partition(s, -top)[-top]) if len(s) > top else least  # ties of the last stay for the order of names
        near = np.flatnonzero(s >= last)
        near = near[np.lexsort((b[near], -s[near]))[:top]]
        return [b[near], n[near], s[near]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _tables(((a, *best(b, n, s)) for a, b, n, s in _sums(batches, width, True)), ["work", "other", "common", "weight"])

    pairs = met.select("i", "j", "w", "a", "b").mapInPandas(run, "work long, other long, common long, weight double")
    rank = F.row_number().over(Window.partitionBy("work").orderBy(F.col("weight").desc(), "other")).cast("long")
    kept = cut(pairs.withColumn("rk", rank).where(F.col("rk") <= top))  # numbers are in the order of names
    return _named(kept, no, "work", "other").select("work", "other", "common", "weight", "rk")


def proofs(ids: DataFrame, rel: DataFrame, top: int = 5) -> DataFrame:
    """(work, other, label, num, df, rk): the ``top`` rarest identifiers that relate two works."""
    d = document_frequency(ids)
    one = ids.select("work", "label", "num")
    pairs = rel.select("work", "other").join(one, "work").join(one.withColumnRenamed("work", "other"), ["other", "label", "num"], "left_semi").join(d, ["label", "num"])
    rank = F.row_number().over(Window.partitionBy("work", "other").orderBy("df", "label", "num")).cast("long")
    return pairs.withColumn("rk", rank).where(F.col("rk") <= top).select("work", "other", "label", "num", "df", "rk")


def hubs(ids: DataFrame, share: float = 0.10, least: int = 4) -> DataFrame:
    """(label, num, df, notable): identifiers cited by max(least, a share of all works), and notable norms cited at all."""
    total = ids.select("work").distinct().agg(F.count(F.lit(1)).alias("N"))
    notable = dims.rows(ids.sparkSession, dims.NOTABLE, "label string, num string").withColumn("notable", F.lit(True))
    d = document_frequency(ids).join(F.broadcast(total)).join(F.broadcast(notable), ["label", "num"], "left").withColumn("notable", F.coalesce("notable", F.lit(False)))
    return d.where(F.col("notable") | (F.col("df") >= F.greatest(F.lit(least), F.ceil(F.lit(share) * F.greatest(F.lit(1), F.col("N")))))).select("label", "num", "df", "notable")


def hub_works(ids: DataFrame, hub: DataFrame) -> DataFrame:
    """(label, num, work, n, rk): works that cite each hub, most mentions first."""
    j = ids.join(F.broadcast(hub.select("label", "num")), ["label", "num"])
    return j.withColumn("rk", F.row_number().over(Window.partitionBy("label", "num").orderBy(F.col("n").desc(), "work")).cast("long")).select("label", "num", "work", "n", "rk")


def densest_slices(notes: DataFrame, mentions: DataFrame, hub: DataFrame, top: int = 3) -> DataFrame:
    """(label, num, work, stem, n, rk): per hub and work the slices with most mentions."""
    m = mentions.where("mention_id is not null and label is not null and num is not null").groupBy("mention_id").agg(*[F.max(c).alias(c) for c in ("note_id", "label", "num", "n")])
    per = m.groupBy("note_id", "label", "num").agg(F.sum("n").alias("n")).join(F.broadcast(hub.select("label", "num")), ["label", "num"])
    j = per.join(work_of(notes), "note_id").where("n > 0 and stem != work")
    rank = F.row_number().over(Window.partitionBy("label", "num", "work").orderBy(F.col("n").desc(), "stem")).cast("long")
    return j.withColumn("rk", rank).where(F.col("rk") <= top).select("label", "num", "work", "stem", "n", "rk")


def distinctive(ids: DataFrame, top: int = 10) -> DataFrame:
    """(work, label, num, df, n, rk): each work's identifiers by rarity, then mentions."""
    j = ids.join(document_frequency(ids), ["label", "num"])
    return j.withColumn("rk", F.row_number().over(Window.partitionBy("work").orderBy("df", F.col("n").desc(), "label", "num")).cast("long")).where(F.col("rk") <= top).select("work", "label", "num", "df", "n", "rk")


CELL = 20_000_000  # pairs of a finding and a note that one place of a common identifier makes
LINE = 50_000  # findings or notes of a place, about
TILE = 256  # notes of a place that are laid beside one finding after the other
TASKS = 2_000  # tasks that places are dealt to, at most


def affected(findings: DataFrame, notes_ids: DataFrame, cell: int = CELL, tile: int = TILE) -> DataFrame:
    """findings(finding, label, num) x notes(note_id, label, num) -> (finding, note_id, common): notes an incoming finding touches.

    An identifier with many findings and notes is spread: its findings over
    rows, its notes over columns, so that each pair meets in one place.
    Only pairs of findings with more than one identifier are shuffled. Notes
    travel in lists of ``tile``, and a list goes by all findings before the next:
    in a columnar file the finding is then a run and the notes repeat after few
    bytes, which takes a small part of what pairs in other orders take.
    """
    spark = findings.sparkSession
    f = cut(findings.select("finding", "label", "num").distinct())
    n = cut(notes_ids.select("note_id", "label", "num").distinct().join(f.select("label", "num").distinct(), ["label", "num"], "left_semi"))
    nf, nn = f.groupBy("label", "num").agg(F.count(F.lit(1)).alias("nf")), n.groupBy("label", "num").agg(F.count(F.lit(1)).alias("nn"))
    side = F.ceil(F.sqrt(F.col("nf") * F.col("nn") / cell)).cast("long")  # rows and columns, so cells of the size at most on average
    lines = lambda c: F.least(F.greatest(side, F.ceil(F.col(c) / LINE).cast("long")), c)
    grid = cut(nf.join(nn, ["label", "num"]).select("label", "num", lines("nf").alias("rows"), lines("nn").alias("cols"), (F.col("nf") * F.col("nn")).alias("pairs")))
    pairs = grid.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]
    several = cut(f.groupBy("finding").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("finding"))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    place = ["label", "num", "i", "j"]
    # a task has few places, so a file has few different values; adaptive execution would lump small places together
    dealt = lambda of: of.repartition(min(TASKS, max(spread(spark), 2 * -(-pairs // cell))), *place) if pairs > cell else of
    left = f.join(grid, ["label", "num"]).withColumn("i", F.pmod(F.xxhash64("finding"), F.col("rows"))).withColumn("j", every("cols")).select(*place, "finding")
    ids = F.expr("concat(array_sort(collect_list(note_id)), if(count(*) > count(note_id), array(null), array()))")
    lists = n.join(grid, ["label", "num"]).withColumn("j", F.pmod(F.xxhash64("note_id"), F.col("cols"))).groupBy("label", "num", "j").agg(F.first("rows").alias("rows"), ids.alias("l"))
    tiles = F.transform(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / tile).cast("int")), lambda k: F.slice("l", k * tile + 1, tile))
    right = dealt(lists.select("label", "num", "j", "rows", F.explode(tiles).alias("tile")).withColumn("i", every("rows")).select(*place, "tile"))
    # by sorting: the lists stream past the findings of their place; a hash join would hold all rows of a list at once
    met = lambda of: right.hint("merge").join(dealt(of), place).select("finding", F.explode("tile").alias("note_id"))
    if not several.limit(1).count():
        return met(left).select("finding", "note_id", F.lit(1).cast("long").alias("common"))
    one = met(left.join(several, "finding", "left_anti")).select("finding", "note_id", F.lit(1).cast("long").alias("common"))
    return one.unionByName(met(left.join(several, "finding", "left_semi")).groupBy("finding", "note_id").agg(F.count(F.lit(1)).alias("common")))


def touched(findings: DataFrame, notes_ids: DataFrame) -> DataFrame:
    """findings(finding, label, num), notes(note_id, label, num) -> (note_id): notes that a finding other than the note itself touches; no pairs are formed."""
    ends = findings.groupBy("label", "num").agg(F.min("finding").alias("lo"), F.max("finding").alias("hi"))
    return notes_ids.select("note_id", "label", "num").distinct().join(ends, ["label", "num"]).where("lo != note_id or hi != note_id").select("note_id").distinct()


def label_text(label: Column, num: Column) -> Column:
    """How an identifier is shown: number grouped by points, except of processes and short numbers."""
    grouped = F.regexp_replace(num, r"(?<=\d)(?=(?:\d{3})+$)", ".")
    return F.concat_ws(" ", label, F.when((label == "processo") | (F.length(num) <= 3), num).otherwise(grouped))
