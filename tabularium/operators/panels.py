"""Panels over notes: the eight fixed ones, and a translator for the small query language they are written in."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabularium.functions import dims
from tabularium.functions.text import is_blank
from tabularium.operators.notes import once
from tabularium.sources.tables import cut

COLUMNS = ("stem", "tipo", "status", "confiabilidade", "autoria", "ano", "mtime", "parte", "area", "tags")


def board(notes: DataFrame, predicate: Column | None = None) -> DataFrame:
    """Notes that panels show: one row per note, no slices, within a stored predicate."""
    n = once(notes, *COLUMNS).where(is_blank(F.col("parte")))
    return n.where(predicate) if predicate is not None else n


def ready(b: DataFrame) -> DataFrame:
    return b.where(F.col("status") == dims.STATUS_OK).select("note_id", "stem", "tipo", "autoria", "ano")


def pending(b: DataFrame) -> DataFrame:
    return b.where(F.col("status").isin(*dims.STATUS_PENDING) | F.col("confiabilidade").isin(*dims.STATUS_PENDING)).select("note_id", "stem", "status", "confiabilidade", "ano")


def superseded(b: DataFrame) -> DataFrame:
    return b.where(F.col("status").isin(*dims.STATUS_OLD)).select("note_id", "stem", "status", "ano")


def by_group(b: DataFrame, group: str) -> DataFrame:
    kinds = dict(dims.KIND_GROUPS)[group]
    return b.where(F.col("tipo").isin(*kinds)).select("note_id", "stem", "autoria", "ano", "status")


def recent(b: DataFrame, today: str, days: int = 30) -> DataFrame:
    """Notes changed in the last days; ``today`` is a parameter, so that results can be repeated."""
    return b.where(F.col("mtime") >= F.date_sub(F.to_date(F.lit(today)), days)).select("note_id", "stem", "tipo", "mtime")


def ordered(b: DataFrame) -> DataFrame:
    """``pos`` of every note within its kind: latest year first, then by stem; all rows are kept.

    A kind may hold most notes, so there is no window over a kind: a range sort,
    then offsets of each kind in each partition.
    """
    keys = ["tipo", F.col("ano").desc_nulls_last(), "stem", "note_id"]
    s = cut(b.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("p", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id()))
    first = s.groupBy(F.col("tipo").alias("t"), F.col("p").alias("q")).agg(F.min("i").alias("i0"), F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("t").orderBy("q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = F.broadcast(first.withColumn("before", before))
    return s.join(start, F.col("tipo").eqNullSafe(F.col("t")) & (F.col("p") == F.col("q"))).withColumn("pos", F.col("i") - F.col("i0") + 1 + F.col("before")).drop("p", "i", "t", "q", "i0", "c", "before")


def health(b: DataFrame) -> DataFrame:
    return b.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


_TOKEN = re.compile(r'\s*(?:(?P<str>"[^"]*")|(?P<num>\d+(?:\.\d+)?)|(?P<op>>=|<=|!=|=|>|<|!|\(|\)|,|-|\+)|(?P<name>[A-Za-z_À-ÿ][\w.À-ÿ]*))')


class QueryError(ValueError):
    """The text is no query of the language."""


def _tokens(text: str) -> list[tuple[str, str]]:
    out, i = [], 0
    while i < len(text):
        m = _TOKEN.match(text, i)
        if not m:
            if text[i:].strip():
                raise QueryError(f"can't read {text[i : i + 20]!r}")
            break
        out.append((m.lastgroup, m.group(m.lastgroup)))
        i = m.end()
    return out


class _Reader:
    """Reads one query; fields are columns of the notes, ``file.mtime``, ``file.name`` and ``file.path`` the file's own."""

    FILE = {"file.mtime": "mtime", "file.name": "stem", "file.link": "stem", "file.path": "path"}

    def __init__(self, text: str, df: DataFrame, today: str):
        self.t, self.i, self.df, self.today = _tokens(text), 0, df, today

    def peek(self, *words: str) -> bool:
        return all(self.i + k < len(self.t) and self.t[self.i + k][1].upper() == w for k, w in enumerate(words))

    def take(self, word: str | None = None) -> tuple[str, str]:
        if self.i >= len(self.t) or (word and self.t[self.i][1].upper() != word):
            raise QueryError(f"expected {word or 'more'} at {self.t[self.i :][:3]}")
        self.i += 1
        return self.t[self.i - 1]

    def field(self, name: str) -> Column:
        name = self.FILE.get(name, name)
        if name not in self.df.columns:
            return F.lit(None).cast("string")
        return F.col(name)

    def either(self) -> Column:
        c = self.both()
        while self.peek("OR"):
            self.take()
            c = c | self.both()
        return c

    def both(self) -> Column:
        c = self.single()
        while self.peek("AND"):
            self.take()
            c = c & self.single()
        return c

    def single(self) -> Column:
        if self.peek("!"):
            self.take()
            kind, name = self.take()
            if kind == "name" and not self.peek("("):
                return is_blank(self.field(name).cast("string"))
            self.i -= 1
            return ~self.single()
        if self.peek("("):
            self.take()
            c = self.either()
            self.take(")")
            return c
        if self.peek("CONTAINS", "("):
            self.take(), self.take()
            _, name = self.take()
            self.take(",")
            what = self.value()
            self.take(")")
            col = self.field(name)
            array = dict(self.df.dtypes).get(self.FILE.get(name, name), "").startswith("array")
            return F.coalesce(F.array_contains(col, what) if array else F.contains(col.cast("string"), what), F.lit(False))
        kind, name = self.take()
        if kind != "name":
            raise QueryError(f"expected a field, not {name!r}")
        left = self.field(name)
        if self.i < len(self.t) and self.t[self.i][1] in ("=", "!=", ">", "<", ">=", "<="):
            _, op = self.take()
            right = self.value()
            c = {"=": left == right, "!=": left != right, ">": left > right, "<": left < right, ">=": left >= right, "<=": left <= right}[op]
            return F.coalesce(c, F.lit(False))
        return ~is_blank(left.cast("string"))

    def value(self) -> Column:
        if self.peek("DATE", "(", "TODAY", ")"):
            self.i += 4
            c = F.to_date(F.lit(self.today))
        elif self.t[self.i][0] == "str":
            return F.lit(self.take()[1][1:-1])
        elif self.t[self.i][0] == "num":
            return F.lit(float(self.take()[1]))
        else:
            return self.field(self.take()[1])
        while self.peek("-", "DUR") or self.peek("+", "DUR"):
            sign = -1 if self.take()[1] == "-" else 1
            self.take("DUR"), self.take("(")
            n = int(float(self.take()[1]))
            unit = self.take()[1].lower().rstrip("s")
            self.take(")")
            c = F.date_add(c, sign * n * {"day": 1, "week": 7}[unit])
        return c


def predicate(text: str, df: DataFrame, today: str = "2026-01-01") -> Column:
    """A panel's stored predicate as a Column."""
    r = _Reader(text, df, today)
    c = r.either()
    if r.i != len(r.t):
        raise QueryError(f"left over: {r.t[r.i :]}")
    return c


def run(query: str, df: DataFrame, today: str = "2026-01-01") -> DataFrame:
    """``TABLE [WITHOUT ID] f AS "a", ... FROM -"folder" WHERE p SORT f ASC|DESC, ... GROUP BY f`` over notes.

    FROM with a minus leaves a folder of ``path`` out, without one keeps only it.
    After GROUP BY the fields are ``key`` and ``length(rows)``.
    """
    r = _Reader(query, df, today)
    r.take("TABLE")
    if r.peek("WITHOUT", "ID"):
        r.i += 2
    picks: list[tuple[str, str]] = []
    while not any(r.peek(w) for w in ("FROM", "WHERE", "SORT", "GROUP")) and r.i < len(r.t):
        _, name = r.take()
        if name.lower() == "length" and r.peek("(", "ROWS", ")"):
            r.i += 3
            name = "length(rows)"
        alias = name
        if r.peek("AS"):
            r.take()
            alias = r.take()[1].strip('"')
        picks.append((name, alias))
        if r.peek(","):
            r.take()
    cond, order, group = F.lit(True), [], None
    while r.i < len(r.t):
        if r.peek("FROM"):
            r.take()
            out = r.peek("-")
            if out:
                r.take()
            folder = r.take()[1].strip('"')
            hit = F.coalesce(r.field("file.path").startswith(folder + "/"), F.lit(False))
            cond = cond & (~hit if out else hit)
        elif r.peek("WHERE"):
            r.take()
            cond = cond & r.either()
        elif r.peek("GROUP", "BY"):
            r.i += 2
            group = r.take()[1]
        elif r.peek("SORT"):
            r.take()
            while True:
                _, name = r.take()
                down = r.peek("DESC")
                if down or r.peek("ASC"):
                    r.take()
                order.append((name, down))
                if not r.peek(","):
                    break
                r.take()
        else:
            raise QueryError(f"left over: {r.t[r.i :]}")
    kept = df.where(cond)
    if group:
        g = kept.groupBy(r.field(group).alias("key")).agg(F.count(F.lit(1)).alias("length(rows)"))
        return g.select(*[F.col(f"`{n}`").alias(a) for n, a in picks])
    if order:
        kept = kept.orderBy(*[r.field(n).desc_nulls_last() if d else r.field(n).asc_nulls_last() for n, d in order])
    return kept.select(*[r.field(n).alias(a) for n, a in picks])
