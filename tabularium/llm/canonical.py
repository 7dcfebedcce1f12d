"""Freely typed values mapped to the entry of a reference list they mean, or reported as misses.

1. Symmetric deletes: every key of the reference list, and every distinct typed
   value, is expanded to the strings left by up to ``k`` deletions; two strings
   within edit distance k share one of them. So the bounded-distance search is
   an equi-join on the deleted form. Candidates are then checked with a weighted
   Damerau-Levenshtein distance and ranked by (distance, frequency in the data,
   order in the list).
2. Other names of an entry (no spelling leads from "laboral" to "Trabalhista")
   are learned from the data: notes of one work bear the same values, and the
   codes in their file names say the same again. A value that means nothing by
   its spelling, and stands again and again where the work names one entry,
   becomes a key of that entry; what is left is looked up among these keys, in
   the same way. A list of such names may be given as a table; none is built in.

Typed values are reduced to distinct (field, value) pairs before anything
costly, so a value that holds a third of all rows is looked up once. The
dictionary side is built from the reference list and broadcast only while it
has at most ``BROADCAST_ROWS`` deletes; a larger one is shuffle-joined.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tabularium.functions.fuzzy import fold
from tabularium.functions.text import link_stem
from tabularium.operators.multivalue import split_values
from tabularium.operators.notes import NAME
from tabularium.sources.tables import balanced, cut

BROADCAST_ROWS = 500_000
LEAST_WORKS = 3  # works in which a value must stand for an entry before it is taken for another name of it,
KAPPA = 0.8  # agreement of the works that tell anything, from 0 for what chance gives to 1 for all of them,
CHANCE = 0.01  # and how likely at most so many would agree if the value stood anywhere
WEAK = 1.0  # distance beyond which what a value stands beside may overrule its spelling
CODE_SHARE = 0.9  # share of the plain values under a code in file names that makes the code mean their entry
_MARKS = re.compile(r"(?:\s*\(\?\)|[\s*.!?]+)$")
_TAIL_DOT = re.compile(r"\.\s*(?:\*|\(\?\))?\s*$")


def bound(key: str) -> int:
    """Edits allowed for a key of this length: none up to 4 letters, 1 up to 6, 2 up to 17, then 3."""
    n = len(key)
    return 0 if n <= 4 else 1 if n <= 6 else 2 if n <= 17 else 3


def deletes(key: str, k: int) -> set[str]:
    """``key`` with up to k letters removed."""
    return {"".join(c for i, c in enumerate(key) if i not in gone) for d in range(k + 1) for gone in combinations(range(len(key)), min(d, len(key)))}


def weighted(a: str, b: str) -> float:
    """Damerau-Levenshtein distance from typed a to listed b; a swap may span letters that were also edited.

    A doubled letter costs 0.7, a swap 0.8, another edit 1, at the first letter 1.2.
    """
    n, m = len(a), len(b)
    d = [[float(j if i == 0 else i) if i == 0 or j == 0 else 0.0 for j in range(m + 1)] for i in range(n + 1)]
    row_of: dict[str, int] = {}
    for i in range(1, n + 1):
        col = 0
        for j in range(1, m + 1):
            same = a[i - 1] == b[j - 1]
            cost = 1.2 if i == 1 or j == 1 else 1.0
            extra = 0.7 if i > 1 and a[i - 1] == a[i - 2] else cost
            best = min(d[i - 1][j] + extra, d[i][j - 1] + cost, d[i - 1][j - 1] + (0.0 if same else cost))
            k = row_of.get(b[j - 1], 0)
            if k and col:
                best = min(best, d[k - 1][col - 1] + (i - k - 1) + 0.8 + (j - col - 1))
            d[i][j] = best
            if same:
                col = j
        row_of[a[i - 1]] = i
    return d[n][m]


def keys_of(value: str, campo: str) -> list[str]:
    """Forms under which a typed value is looked up, the plainest first."""
    key = re.sub(r"\s+", " ", fold(value)).strip()
    while (cut := _MARKS.sub("", key)) != key and cut:
        key = cut
    out = [key]
    words = key.split(" ")
    if campo == "area" and len(words) > 1:
        head = words[0].strip(".")
        if head in ("dir", "materia") or (abs(len(head) - 7) <= 2 and weighted(head, "direito") <= 2) or (abs(len(head) - 7) <= 1 and weighted(head, "materia") <= 1.2):
            rest = words[1:]
            if len(rest) > 1 and rest[0] in ("de", "da", "do", "das", "dos", "d"):
                rest = rest[1:]
            out.append(" ".join(rest))
    return out


_PLAIN = F.pandas_udf(lambda s: s.map(lambda x: re.sub(r"\s+", " ", fold(x)).strip()), StringType())


def reference(vocabulary: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """(campo, ord, canonico, key, main): the list's entries and, of synonyms(campo, valor, canonico), their other names, folded.

    ``main`` marks an entry's own name, whose beginnings also count as abbreviations.
    Null and repeated entries of the list are left out, as are names of entries that aren't listed.
    """
    listed = vocabulary.where("campo is not null and trim(canonico) != ''").groupBy("campo", "canonico").agg(F.min("ord").alias("ord"))
    own = listed.select("campo", "ord", "canonico", _PLAIN("canonico").alias("key"), F.lit(True).alias("main"))
    if synonyms is None:
        return own
    other = synonyms.where("trim(valor) != ''").select("campo", "canonico", _PLAIN("valor").alias("key")).distinct().join(listed, ["campo", "canonico"])
    return own.unionByName(other.select("campo", "ord", "canonico", "key", F.lit(False).alias("main")))


def _reach(key: str) -> int:
    """Deletions of a typed key: a listed one up to two letters longer may allow more edits than its own length does."""
    return max(bound(key), bound(key + "  ")) if len(key) > 2 else 0


def near(keys: DataFrame, ref: DataFrame) -> DataFrame:
    """keys(campo, key), ref(campo, ord, canonico, key, main) -> (campo, key, ord, canonico, listed): within the bounded edit distance.

    The dictionary of deletes goes to every worker while it has at most
    ``BROADCAST_ROWS`` entries; a larger one is joined by shuffle on the deletes.
    """
    sized = ref.agg(F.sum(F.expr("case when length(key) <= 4 then 1 when length(key) <= 6 then length(key) + 1 when length(key) <= 17 then length(key) * length(key) else length(key) * length(key) * length(key) div 4 end")).alias("n")).first()["n"] or 0
    out = "campo string, key string, ord long, canonico string, listed string"
    if sized <= BROADCAST_ROWS:
        index: dict[tuple[str, str], list[tuple]] = {}
        for campo, o, canonico, key, _ in ref.select("campo", "ord", "canonico", "key", "main").distinct().collect():  # as many rows as the check above allows
            for gone in deletes(key, bound(key)):
                index.setdefault((campo, gone), []).append((o, canonico, key))
        sent = keys.sparkSession.sparkContext.broadcast(index)

        def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            listed = sent.value
            for b in batches:
                rows = {(campo, key, *hit) for campo, key in zip(b["campo"], b["key"]) for gone in deletes(key, _reach(key)) for hit in listed.get((campo, gone), ())}
                yield pd.DataFrame(sorted(rows), columns=["campo", "key", "ord", "canonico", "listed"])

        return balanced(keys).mapInPandas(look, out)

    def expand(reach) -> object:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = [(campo, key, x) for campo, key in zip(b["campo"], b["key"]) for x in deletes(key, reach(key))]
                yield pd.DataFrame(rows, columns=["campo", "key", "gone"])

        return run

    schema = "campo string, key string, gone string"
    left = balanced(keys).mapInPandas(expand(_reach), schema)
    right = balanced(ref.select("campo", "key").distinct()).mapInPandas(expand(bound), schema).withColumnRenamed("key", "listed")
    met = left.join(right, ["campo", "gone"]).select("campo", "key", "listed").distinct()
    return met.join(ref.select("campo", F.col("key").alias("listed"), "ord", "canonico").distinct(), ["campo", "listed"]).select("campo", "key", "ord", "canonico", "listed")


def match(values: DataFrame, vocabulary: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """values(campo, valor) -> (campo, valor, canonico, distance), one row per distinct pair.

    ``canonico`` is '' and ``distance`` null where nothing is near enough (a miss).
    A value that is literally an entry maps to it at distance 0. Null values are
    left out; ties go to the more frequent entry, then to the list's order.
    synonyms(campo, valor, canonico) are further names of the entries.
    """
    return lookup(values, reference(vocabulary, synonyms))


def lookup(values: DataFrame, ref: DataFrame) -> DataFrame:
    """``match`` with the keys of ``reference``."""
    typed = cut(values.where("valor is not null and campo is not null").groupBy("campo", "valor").agg(F.count(F.lit(1)).alias("n")))

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(c, v, n, rank, key, bool(_TAIL_DOT.search(v))) for c, v, n in zip(b["campo"], b["valor"], b["n"]) for rank, key in enumerate(keys_of(v, c))]
            yield pd.DataFrame(rows, columns=["campo", "valor", "n", "rank", "key", "dotted"])

    keyed = cut(typed.mapInPandas(forms, "campo string, valor string, n long, rank int, key string, dotted boolean"))
    dist = F.pandas_udf(lambda a, b: pd.Series([weighted(x, y) for x, y in zip(a, b)]), "double")
    limit = F.when(F.length("listed") <= 4, 0.0).when(F.length("listed") <= 6, 1.25).when(F.length("listed") <= 17, 2.25).otherwise(3.3)
    hits = near(keyed.select("campo", "key").distinct(), ref).withColumn("distance", dist("key", "listed")).where(F.col("distance") <= limit)
    # a value that ends in a point may also be the beginning of an entry's own name
    begun = ref.where("main").select("campo", "ord", "canonico", F.explode(F.expr("transform(sequence(3, greatest(3, length(key) - 1)), i -> rtrim(left(key, i)))")).alias("key")).distinct()
    short = keyed.where("dotted").join(begun, ["campo", "key"]).select("campo", "valor", "n", "rank", "ord", "canonico", F.lit(0.5).alias("distance"))
    pairs = keyed.join(hits, ["campo", "key"]).select("campo", "valor", "n", "rank", "ord", "canonico", "distance")
    pairs = cut(pairs.unionByName(short))  # read twice: for the frequencies and for the ranking
    # frequency of an entry: rows whose value names it without any error
    freq = pairs.where("distance = 0").groupBy("campo", "canonico").agg(F.sum("n").alias("freq"))
    ranked = pairs.join(freq, ["campo", "canonico"], "left")
    best = ranked.groupBy("campo", "valor").agg(
        F.min_by(F.struct("canonico", "distance"), F.struct("distance", "rank", (-F.coalesce("freq", F.lit(0))).alias("rare"), "ord")).alias("b")
    )
    return typed.select("campo", "valor").join(best, ["campo", "valor"], "left").select("campo", "valor", F.coalesce("b.canonico", F.lit("")).alias("canonico"), F.col("b.distance").alias("distance"))


def typed_values(notes: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """(note_id, campo, valor, pos, n): each value of ``area``, ``status`` and ``tipo``; area may hold several."""
    once = notes.select("note_id", "area", "status", "tipo").where("note_id is not null").distinct()
    several = split_values(once, ("area",), vocabulary=vocabulary).select("note_id", "campo", "valor", "pos", "n")
    single = once.select("note_id", F.explode(F.create_map(F.lit("status"), F.col("status"), F.lit("tipo"), F.col("tipo"))).alias("campo", "v"))
    bare = F.regexp_replace(F.regexp_replace("v", r"^[\s\[\]\"' ]+|[\s\[\]\"' ]+$", ""), r"^-\s+", "")
    one = F.lit(1).cast("bigint")
    single = single.select("note_id", "campo", bare.alias("valor"), one.alias("pos"), one.alias("n")).where("valor is not null and valor not in ('', 'null')")
    return several.unionByName(single)


def weak(known: DataFrame) -> DataFrame:
    """What spelling doesn't decide: misses, and matches more than ``WEAK`` away."""
    return known.where(f"canonico = '' or distance > {WEAK}")


def learned(values: DataFrame, known: DataFrame, notes: DataFrame) -> DataFrame:
    """(campo, valor, canonico, works): other names of entries, learned from where they stand.

    values(note_id, campo, valor, pos, n) and known(campo, valor, canonico, distance),
    as ``match`` gives it, are all typed values and what their spelling means; a
    value whose spelling is more than ``WEAK`` away counts as unknown. A work is
    what a slice links to, or the note itself. In it an unknown value means the
    one entry that other notes name plainly at its place among as many values;
    where no note has as many, the one entry that the work names and the value's
    own note doesn't; where the work names none, what the code in its file name
    stands for. A value is learned if ``LEAST_WORKS`` works agree, and the
    works that tell anything agree by ``KAPPA`` beyond the entry's share p of
    all works, unless so many would by chance (p to that power is over ``CHANCE``). ``valor`` is
    folded. Every work counts once, however many notes it has.
    """
    of = notes.where("note_id is not null").select(
        "note_id", F.coalesce(link_stem(F.col("obra")), F.col("stem")).alias("work"),
        F.create_map(F.lit("area"), F.regexp_extract("stem", NAME, 1), F.lit("tipo"), F.regexp_extract("stem", NAME, 2)).alias("codes"),
    ).dropDuplicates(["note_id", "work"])
    told = values.join(known, ["campo", "valor"]).join(of, "note_id").withColumn("code", F.nullif(F.try_element_at("codes", F.col("campo")), F.lit("")))
    told = cut(told.withColumn("known", (F.col("canonico") != "") & (F.col("distance") <= WEAK)).drop("codes"))
    plain = told.where("distance = 0")
    # at most as many entries a work as the list has; a place with more than one tells nothing
    named = cut(plain.groupBy("work", "campo").agg(F.collect_set("canonico").alias("has"), F.collect_set("n").alias("sizes")))
    placed = plain.groupBy("work", "campo", "n", "pos").agg(F.collect_set("canonico").alias("here"))
    mine = told.where("known").groupBy("note_id", "campo").agg(F.collect_set("canonico").alias("mine"))
    coded = plain.where("code is not null and n = 1").groupBy("campo", "code", "canonico").agg(F.countDistinct("work").alias("c"))
    coded = coded.groupBy("campo", "code").agg(F.max_by("canonico", F.struct("c", "canonico")).alias("means"), F.max("c").alias("top"), F.sum("c").alias("all")).where(F.col("top") >= CODE_SHARE * F.col("all"))
    last_key = F.pandas_udf(lambda c, v: pd.Series([keys_of(x, f)[-1] for f, x in zip(c, v)]), "string")
    odd = weak(known).select("campo", "valor", last_key("campo", "valor").alias("key")).where("key != ''")
    at = told.where("not known").select("note_id", "work", "campo", "valor", "n", "pos", "code").join(odd, ["campo", "valor"])
    at = at.join(named, ["work", "campo"], "left").join(placed, ["work", "campo", "n", "pos"], "left").join(coded.select("campo", "code", "means"), ["campo", "code"], "left").join(mine, ["note_id", "campo"], "left")
    could = F.when(F.array_contains("sizes", F.col("n")), F.col("here")).when(F.col("has").isNotNull(), F.col("has")).when(F.col("n") == 1, F.array("means"))
    could = F.array_except(F.array_compact(could), F.coalesce("mine", F.array().cast("array<string>")))
    says = at.withColumn("could", could).where("size(could) = 1").select("campo", "key", "work", F.col("could")[0].alias("canonico")).distinct()
    per = says.groupBy("campo", "key", "canonico").agg(F.count(F.lit(1)).alias("c"))
    best = per.groupBy("campo", "key").agg(F.max_by("canonico", F.struct("c", "canonico")).alias("canonico"), F.max("c").alias("works"), F.sum("c").alias("n"))
    works = named.groupBy("campo").agg(F.count(F.lit(1)).alias("all"))
    share = named.select("campo", F.explode("has").alias("canonico")).groupBy("campo", "canonico").agg(F.count(F.lit(1)).alias("with"))
    share = share.join(works, "campo").select("campo", "canonico", (F.col("with") / F.col("all")).alias("p"))
    # entries that no work names plainly (codes may still mean them) count as named by one
    sure = best.join(share, ["campo", "canonico"], "left").join(works, "campo", "left").withColumn("p", F.coalesce("p", 1 / F.greatest(F.coalesce("all", F.lit(1)), F.lit(2))))
    sure = sure.where((F.col("works") >= LEAST_WORKS) & (F.col("works") >= (F.col("p") + KAPPA * (1 - F.col("p"))) * F.col("n")) & (-F.col("works") * F.log("p") >= -math.log(CHANCE)))
    return sure.select("campo", F.col("key").alias("valor"), "canonico", "works")


def mapped(notes: DataFrame, vocabulary: DataFrame, synonyms: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(values, meanings): all typed values (note_id, campo, valor, pos, n), and (campo, valor, canonico, distance, way) of each distinct one.

    way: 'spelling' for what the list's names (and given synonyms) lead to,
    'learned' for what the learned names do, 'miss' for the rest.
    """
    values = cut(typed_values(notes, vocabulary).distinct())
    first = cut(match(values, vocabulary, synonyms))
    names = cut(learned(values, first, notes))
    lost = values.join(weak(first).select("campo", "valor"), ["campo", "valor"])
    listed = reference(vocabulary).select("campo", "canonico", "ord").distinct()
    ref = names.join(listed, ["campo", "canonico"]).select("campo", "ord", "canonico", F.col("valor").alias("key"), F.lit(False).alias("main"))
    second = lookup(lost, ref).where("canonico != ''").select("campo", "valor", F.col("canonico").alias("other"), F.col("distance").alias("off"))
    both = first.join(second, ["campo", "valor"], "left")
    better = F.col("off").isNotNull() & (F.col("distance").isNull() | (F.col("off") < F.col("distance")))
    way = F.when(better, "learned").when(F.col("canonico") == "", "miss").otherwise("spelling")
    return values, cut(both.select("campo", "valor", F.when(better, F.col("other")).otherwise(F.col("canonico")).alias("canonico"), F.when(better, F.col("off")).otherwise(F.col("distance")).alias("distance"), way.alias("way")))


def found(notes: DataFrame, vocabulary: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """p1_found: (note_id, campo, canonico) of values that aren't literally an entry; '' is a miss."""
    # the whole of the values, literal ones too, gives the frequencies and the names
    values, meanings = mapped(notes, vocabulary, synonyms)
    entries = vocabulary.select("campo", F.col("canonico").alias("valor")).where("valor is not null").distinct()
    off = values.join(entries, ["campo", "valor"], "left_anti")
    return off.join(meanings, ["campo", "valor"]).select("note_id", "campo", "canonico").distinct()


def misses(notes: DataFrame, vocabulary: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """(campo, valor, n_notes): values that name no entry, with the notes that bear them."""
    values, meanings = mapped(notes, vocabulary, synonyms)
    lost = meanings.where("canonico = ''").select("campo", "valor")
    return values.join(lost, ["campo", "valor"]).groupBy("campo", "valor").agg(F.countDistinct("note_id").alias("n_notes"))


def names_learned(notes: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(campo, valor, canonico, works): the other names of entries that the notes teach."""
    values = cut(typed_values(notes, vocabulary).distinct())
    return learned(values, cut(match(values, vocabulary)), notes)
