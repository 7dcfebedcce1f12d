"""Oversized texts cut into pieces at natural boundaries, with an overlap.

Balanced targets: the least number of pieces under the limit fixes equally long
targets; each is moved to the strongest boundary nearby (heading, page anchor,
paragraph, sentence, line, clause, else any word), and if a piece then breaks
the limit, one more piece is tried. A piece is at most ``teto`` words and opens
with the last ``sobreposicao`` words of the one before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.sources.tables import balanced

CHARS_AT_ONCE = 8_000_000  # characters of texts a worker cuts before it hands the pieces on; memory only
_WORD = re.compile(r"\S+")
# Strength of a boundary, strongest first; the number is what the ranking uses.
HEADING, ANCHOR, PARAGRAPH, SENTENCE, LINE, CLAUSE, WORD = 6, 5, 4, 3, 2, 1, 0
_CLOSERS = "\"'”’»)]*_"


def strength(text: str, before: tuple[int, int], after: tuple[int, int]) -> int:
    """How natural it is to cut between two neighbouring words, given by their spans."""
    gap = text[before[1] : after[0]]
    nxt = text[after[0] : after[1]]
    if "\n" in gap:
        line = text[text.rfind("\n", 0, before[0]) + 1 : before[1]]
        if line.lstrip().startswith("#"):
            return WORD  # a heading stays with what it heads
        if re.match(r"#{1,6}$", nxt):
            return HEADING
        if nxt.startswith("{{") or nxt.startswith("<!--"):
            return ANCHOR
        if line.strip().startswith("{{") and line.strip().endswith("}}"):
            return WORD  # an anchor stays with its page
        if gap.count("\n") > 1:
            return PARAGRAPH
    last = text[before[0] : before[1]].rstrip(_CLOSERS)[-1:]
    if last and last in ".!?…":
        return SENTENCE
    if "\n" in gap:
        return LINE
    return CLAUSE if last and last in ";:,—–" else WORD


def cuts(text: str, spans: list[tuple[int, int]], limit: int, overlap: int, reach: int) -> list[int]:
    """Numbers of the words before which to cut; empty if the text fits."""
    total = len(spans)
    limit = max(1, limit)
    overlap = max(0, min(overlap, limit - 1))
    if total <= limit:
        return []
    known: dict[int, int] = {}
    pieces = -(-(total - overlap) // (limit - overlap))
    while True:
        # the first piece repeats nothing, so it may hold ``overlap`` words more
        step = (total - overlap) / pieces
        near = max(0, min(reach, int(step / 2) - 1))
        out, last, ok = [], 0, True
        for i in range(1, pieces):
            goal = overlap + i * step
            lo = max(last + 1, int(goal) - near)
            hi = min(total - 1, int(goal) + near)
            best = max(1, min(total - 1, int(goal)))
            if lo <= hi:
                for w in range(lo, hi + 1):
                    if w not in known:
                        known[w] = strength(text, spans[w - 1], spans[w])
                best = min(range(lo, hi + 1), key=lambda w: (-known[w], abs(w - goal), w))
            out.append(best)
            last = best
        ends = [*out, total]
        start = 0
        for i, e in enumerate(ends):
            first = start if i == 0 else max(0, start - overlap)
            ok &= 0 < e - first <= limit and e > start
            start = e
        if ok:
            return out
        if pieces >= total or reach == 0:
            # even the plainest balance fails only if a piece would hold no new word: advance word by word
            return list(range(limit, total, limit - overlap))
        pieces += 1
        if step <= 2:
            reach = 0


def split(texts: DataFrame, limits: DataFrame, key: str = "master_id", text: str = "corpo", kind: str = "tipo_fonte", default: str = "outro", with_text: bool = True) -> DataFrame:
    """One row per piece: (key, piece, n_pieces, first_word, last_word, n_words, n_overlap, n_total, teto[, text]).

    Words count from 1 and are runs of anything but white space. A text within
    its limit is one piece. Null, empty and blank texts give no row. Rows
    repeated with equal content count once. A kind that is null or not listed
    takes the limits of ``default``; where that is missing too, the text stays
    whole. Whole texts are cut, however long.
    """
    lim = limits.groupBy(F.col("tipo_fonte").alias("__k")).agg(F.min("alvo").alias("alvo"), F.min("teto").alias("teto"), F.max("sobreposicao").alias("sobreposicao"))
    rows = texts.select(key, F.col(kind).alias("__kind"), F.col(text).cast("string").alias("__t")).where(F.col("__t").isNotNull() & F.col(key).isNotNull())
    listed = lim.where(f"__k is not null and __k != '{default}'")
    other = lim.where(f"__k = '{default}'").select(F.col("alvo").alias("a0"), F.col("teto").alias("t0"), F.col("sobreposicao").alias("o0"))
    rows = rows.join(F.broadcast(listed), F.col("__kind") == F.col("__k"), "left").join(F.broadcast(other), F.lit(True), "left")
    rows = rows.select(key, F.coalesce("alvo", "a0").alias("alvo"), F.coalesce("teto", "t0").alias("teto"), F.coalesce("sobreposicao", "o0").alias("over"), "__t")
    rows = balanced(rows, key, factor=2).dropDuplicates([key, "__t", "teto"])
    kind_of_key = rows.schema[key].dataType.simpleString()
    out = f"{key} {kind_of_key}, piece long, n_pieces long, first_word long, last_word long, n_words long, n_overlap long, n_total long, teto long" + (", text string" if with_text else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [key, "piece", "n_pieces", "first_word", "last_word", "n_words", "n_overlap", "n_total", "teto"] + ["text"] * with_text
        for b in batches:
            got, size = [], 0
            for k, alvo, teto, over, t in zip(b[key], b["alvo"], b["teto"], b["over"], b["__t"]):
                spans = [m.span() for m in _WORD.finditer(t)]
                if not spans:
                    continue
                n = len(spans)
                limit = n if pd.isna(teto) else int(teto)
                overlap = 0 if pd.isna(over) else max(0, min(int(over), max(1, limit) - 1))
                reach = max(0, (limit - int(alvo)) // 2) if not pd.isna(alvo) else limit // 8
                at = [0, *cuts(t, spans, limit, overlap, reach), n]
                for i, (a, e) in enumerate(zip(at, at[1:]), 1):
                    first = a if i == 1 else max(0, a - overlap)
                    row = (k, i, len(at) - 1, first + 1, e, e - first, a - first, n, limit)
                    got.append((*row, t[spans[first][0] : spans[e - 1][1]]) if with_text else row)
                size += len(t)
                if size > CHARS_AT_ONCE:
                    yield pd.DataFrame(got, columns=cols)
                    got, size = [], 0
            yield pd.DataFrame(got, columns=cols)

    return rows.mapInPandas(run, out)


def found(masters: DataFrame, limits: DataFrame) -> DataFrame:
    """p4_found: works that had to be cut, that is, with more words than their limit."""
    return split(masters, limits, with_text=False).where("n_pieces > 1").select("master_id").distinct()
