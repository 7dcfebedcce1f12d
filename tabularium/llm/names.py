"""Variant spellings of the names of persons and bodies, linked per person or body.

1. Each name becomes a weighted vector of character n-grams: the runs of three
   letters of its words, each word with its beginning and end marked, weighted
   by inverse document frequency over all names. A nickname counts as the name
   it stands for, a body also has the n-grams of its acronym.
2. The sparse join meets on pairs of n-grams rather than on single ones: the
   beginning or end of the family name with that of another word (of a body:
   of its place with its acronym). Single ones are shared by far too many names
   to join on; a pair is a product of two, and as rare as both together. Of the
   pairs of names that meet the cosine of the whole vectors is taken; it must
   reach ``MIN_COSINE``, and each name keeps its ``TOP`` nearest.
3. A pair whose words contradict each other (another first name, another suffix,
   another kind of body) is none, whatever its cosine.
4. What hangs together is grouped by average linkage over the cosines, in which
   a contradiction counts against a group. Pairs that share no joined n-grams,
   or fell out of the ``TOP``, are compared too where both are linked with a
   third name; what then has no link counts as contradiction, at every size.

Nicknames aren't listed but learned: a name says so itself (Isabel "Bel"), or
one first word stands in place of another beside the same other words again and
again. First names are known by the number of families they are found in.

Names that say the same, word by word, are represented by one that weighs as
many, from the n-grams on, so that copies don't multiply.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabularium.functions.fuzzy import fold, osa
from tabularium.operators.graph import components
from tabularium.sources.tables import balanced, cut, spread

MIN_COSINE = 0.2  # of whole vectors; names that say less in common are none of one person
TOP = 100  # partners each name keeps from the join; what that leaves out is found again over common partners
MIN_LINK = 0.1  # average similarity at which two groups are merged
NICK_TIMES, NICK_SHARE = 3, 0.3  # contexts in which a first word must stand for another, and their share of all it stands in
CROWD = 100  # first words beside the same other words, beyond which their pairs are counted in tables of two parts, not formed one by one
PART = 1_000  # first words in a part of such a table
KNOWN = 10  # families in which a first name is found, so that it isn't an error for another
BLOCK = 500  # names of one meeting that are compared at a time; more are parted, and any two parts compared
LOCAL = 100_000  # links of one component that one task merges; more are merged by joins over all tasks, with the same result
UNIT = 1_000_000  # similarities are summed in whole millionths
# Forms of names and bodies, folded.
SUFFIX = {"filho": "filho", "fo": "filho", "junior": "junior", "jr": "junior", "neto": "neto", "nt": "neto", "sobrinho": "sobrinho"}
PARTICLE = {"de", "da", "do", "dos", "das", "e", "d", "di", "von", "van", "del"}
TITLE = {"prof", "profa", "dr", "dra", "des", "min", "juiz", "prf"}
BODY = {
    "academia": "a", "acad": "a", "associacao": "a", "centro": "c", "ctr": "c", "conselho": "c", "cons": "c", "comissao": "c", "comite": "c",
    "camara": "c", "faculdade": "f", "fundacao": "f", "fund": "f", "instituto": "i", "inst": "i", "ministerio": "m", "nucleo": "n",
    "secretaria": "s", "sec": "s", "sociedade": "s", "tribunal": "t", "universidade": "u", "escola": "e", "ordem": "o",
}
BODY_ROOT = {"acad": "academia", "ctr": "centro", "cons": "conselho", "fund": "fundacao", "inst": "instituto", "sec": "secretaria"}
STATE = {"republica", "rep", "estado", "reino", "municipio", "uniao", "federacao", "governo", "principado"}


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W\d_]+", fold(text))


def _parts(text: str) -> list[str]:
    """Words without particles; a single letter with a point is an initial, never a particle."""
    mixed = text != text.lower()
    return [
        fold(m[1])
        for m in re.finditer(r"([^\W\d_]+)(\.?)", text)
        if not (fold(m[1]) in PARTICLE or (mixed and m[1].islower() and len(m[1]) <= 4)) or (m[2] and len(m[1]) == 1)
    ]


def _body_word(w: str) -> str | None:
    if w in BODY:
        return BODY_ROOT.get(w, w)
    if len(w) >= 5:
        return next((b for b in BODY if len(b) >= 5 and w[0] == b[0] and osa(w, b, 1) <= 1), None)
    return next((BODY_ROOT[b] for b in BODY_ROOT if len(w) >= 3 and w[0] == b[0] and abs(len(w) - len(b)) <= 1 and osa(w, b, 1) <= 1), None) if len(w) in (3, 4, 5) else None


def _suffix(w: str) -> str | None:
    if w in SUFFIX:
        return SUFFIX[w]
    return next((s for s in ("filho", "junior", "sobrinho", "neto") if len(w) >= 4 and w[0] == s[0] and (osa(w, s, 1) <= 1) and (s != "neto" or sorted(set(w)) == sorted(set(s)))), None)


def parse(name: str | None, nicks: dict[str, list[str]] | None = None, known: list[str] | None = None) -> dict | None:
    """What a name says: kind P (person), B (body) or J (state), and its parts; None for blank names.

    nicks: names that words of this name stand for; known: its words that are first names of many families.
    """
    p = _parse(name, nicks or {})
    if p and p["kind"] == "P":
        words = {p["first"], *p["middle"]}
        p["nicks"] = {w: sorted(nicks[w]) for w in sorted(words) if nicks and w in nicks}
        p["known"] = sorted(words.intersection(() if known is None else known))
    return p


def _parse(name: str | None, nicks: dict[str, list[str]]) -> dict | None:
    if not name or not _words(name):
        return None
    text = re.sub(r"\bF\.\s*º|\bFº|\bF\.o\b", "Filho", name)
    bare = re.sub(r"\([^)]*\)", " ", text)
    inside = re.findall(r"\(([^)]*)\)", text)
    words = [w for w in _words(bare) if w not in PARTICLE]
    if not words:
        words = [w for w in _words(text) if w not in PARTICLE] or _words(text)
    # a state, alone or with its form of government
    core = [w for w in words if w not in STATE]
    if len(core) == 1 and (len(words) > 1 or any(w in STATE for x in inside for w in _words(x)) or len(words) == 1):
        return {"kind": "J", "family": core[0], "rest": [], "suffix": ""}
    # a body: place first with a point, kind first, or acronym and place
    m = re.match(r"\s*([^.,]+)\.\s+(.+)$", bare)
    if m and len(_words(m[1])) <= 3 and (w2 := _words(m[2])) and _body_word(w2[0]) and not _body_word(_words(m[1])[0]):
        return _body([w for w in w2 if w not in PARTICLE], [w for w in _words(m[1]) if w not in PARTICLE][-1:])
    first = _words(bare)[0]
    if "," not in bare and _body_word(first) and len(words) >= 3:
        return _body(words[:-1], words[-1:])
    m = re.match(r"\s*([A-ZÀ-Ý]{3,5})[\s-]+([A-ZÀ-Ý]?[\w'-]+)\s*$", bare)
    if m and not m[2].isupper():
        return {"kind": "B", "family": fold(m[2]), "rest": [], "suffix": "", "acronym": fold(m[1]), "root": "", "theme": []}
    # a person
    bare = re.sub(r'"[^"]*"|“[^”]*”', " ", bare)
    before, comma, after = bare.partition(",")
    titled = re.match(r"\s*(\w{2,5})\.", bare)
    left, right = _parts(before), _parts(after)
    if titled and left and not comma and (left[0] in TITLE or (len(left) > 2 and osa(left[0], "prof", 2) <= 2)):
        left = left[1:]
    suffix = ""
    def strip(part: list[str]) -> list[str]:
        nonlocal suffix
        out = []
        for i, w in enumerate(part):
            s = _suffix(w) if (i > 0 or comma) and len(part) > 1 else None
            if s and (not suffix):
                suffix = s
            else:
                out.append(w)
        return out

    left, right = strip(left), strip(right) if len(right) > 1 else right
    if comma and left and right:
        family, given = left[-1], right + left[:-1]
        mother = left[0] if len(left) > 1 else (right[-1] if len(right) > 1 else "")
        middle = right[1:] if len(left) > 1 else right[1:-1]
        return {"kind": "P", "family": family, "rest": given, "suffix": suffix, "first": right[0], "middle": middle, "mother": mother}
    part = left or right
    if not part:
        return None
    if len(part) == 2 and part[0] in nicks:  # nickname and mother's name, the family name left out
        return {"kind": "P", "family": "", "rest": part, "suffix": suffix, "first": part[0], "middle": [], "mother": part[1]}
    letters = [c for c in bare if c.isalpha()]
    if all(c.isupper() for c in letters) and len(part) >= 3 and len(part[0]) > 2:
        family, rest = part[0], part[1:]
    else:
        family, rest = part[-1], part[:-1]
    return {"kind": "P", "family": family, "rest": rest, "suffix": suffix, "first": rest[0] if rest else "", "middle": rest[1:-1], "mother": rest[-1] if len(rest) > 1 else ""}


def _body(words: list[str], place: list[str]) -> dict:
    root = _body_word(words[0]) or words[0]
    return {"kind": "B", "family": place[0] if place else words[-1], "rest": [], "suffix": "", "acronym": "".join(w[0] for w in words), "root": root, "theme": words[1:]}


def _ends(w: str) -> set[str]:
    """Beginning and end of a word, so that one typing error leaves one of them."""
    if len(w) <= 4:
        return {w}
    out = set()
    for k in (3, 4):
        if (k == 4 and len(w) >= 7) or (k == 3 and len(w) <= 8):
            out |= {w[:k] + "-", "-" + w[-k:]}
    return out


def grams(p: dict) -> list[str]:
    """The n-gram features of a parsed name."""
    head = f"{p['kind']}{p['suffix']}:"
    if p["kind"] == "J":
        return [head + a for a in _ends(p["family"])]
    if p["kind"] == "B":
        return [f"{head}{a}+{p['acronym']}" for a in _ends(p["family"])]

    def forms(w: str) -> set[str]:
        out = set().union(*[_ends(x) for x in p["nicks"].get(w, ())])
        return out | (_ends(w) if len(w) > 1 else set())

    mother = [f"{head}m{a}+{b}" for a in _ends(p["mother"]) for b in forms(p["first"])] if len(p["mother"]) > 1 and p["first"] else []
    if not p["family"]:
        return mother
    others = set().union(*[forms(w) for w in p["rest"]]) or {w + "." for w in p["rest"]}
    return mother + [f"{head}{a}+{b}" for a in _ends(p["family"]) for b in others] or [head + a for a in _ends(p["family"])]


def _same(a: str, b: str, p: dict | None = None, q: dict | None = None) -> bool:
    """Do two words of names agree, up to typing errors, initials and (of the given names of p and q) nicknames?"""
    if a == b:
        return True
    if p and q:
        x, y = p["nicks"].get(a, ()), q["nicks"].get(b, ())
        if set(x) & set(y):
            return True
        for fulls, w in ((x, b), (y, a)):
            if any(w[0] == f[0] if len(w) == 1 else osa(w, f, 1) <= 1 for f in fulls):
                return True
    if len(a) == 1 or len(b) == 1:
        return a[0] == b[0]
    n = min(len(a), len(b))
    most = 0 if n <= 3 else 1 if p or n <= 5 or max(len(a), len(b)) <= 7 else 2
    return osa(a, b, most) <= most and not (p and q and a in p["known"] and b in q["known"])


def agree(p: dict, q: dict) -> bool:
    """Can two names be of one person or body? False where any of their words contradicts the other's."""
    if p["kind"] != q["kind"] or p["suffix"] != q["suffix"]:
        return False
    if p["family"] and q["family"]:
        if not _same(p["family"], q["family"]) or len(p["family"]) == 1 or len(q["family"]) == 1:
            return False
    elif p["kind"] != "P" or len(p["mother"]) < 2 or len(q["mother"]) < 2:
        return False
    if p["kind"] == "J":
        return True
    if p["kind"] == "B":
        if not (p["root"] and q["root"]):
            return p["acronym"] == q["acronym"]
        near = lambda a, b: osa(a, b, 2) <= 2 or a.startswith(b) or b.startswith(a) or osa(a[: len(b)], b, 1) <= 1 or osa(b[: len(a)], a, 1) <= 1
        return p["root"] == q["root"] and len(p["theme"]) == len(q["theme"]) and all(map(near, p["theme"], q["theme"]))
    if not p["first"] or not q["first"]:
        return False
    if not _same(p["first"], q["first"], p, q):
        # two errors in the first name pass where the rest agrees and the name isn't another known one
        rest = len(p["mother"]) > 1 and len(q["mother"]) > 1 and _same(p["mother"], q["mother"])
        both = p["first"] in p["known"] and q["first"] in q["known"]
        if not rest or both or min(len(p["first"]), len(q["first"])) < 5 or osa(p["first"], q["first"], 2) > 2:
            return False
    if p["mother"] and q["mother"] and not _same(p["mother"], q["mother"]):
        return False
    if p["middle"] and q["middle"]:
        return len(p["middle"]) == len(q["middle"]) and all(_same(a, b, p, q) for a, b in zip(p["middle"], q["middle"]))
    return True


def trigrams(name: str, p: dict) -> list[str]:
    """The character n-grams of a name, word by word; an initial has one of its own."""
    words = [w for w in _words(name) if w not in PARTICLE]
    words = [x for w in words for x in p.get("nicks", {}).get(w, [w])] + ([p["acronym"]] if p.get("acronym") else [])
    return [("^" + w + "$")[i : i + 3] for w in words for i in range(max(1, len(w)))]


def facts(names: DataFrame) -> DataFrame:
    """(name_id, nome, words, first, family, others, quoted): what the rules for nicknames and first names are learned from.

    Of persons: first word, family name, all other words in order, and a nickname in quotes.
    """
    schema = "name_id long, nome string, words array<string>, given array<string>, first string, family string, others string, quoted string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, n in zip(b["name_id"], b["nome"]):
                if (p := parse(n)) is None:
                    continue
                person = p["kind"] == "P"
                quoted = re.search(r'["“]([^"”]*)["”]', n) if person else None
                said = [w for w in _words(quoted[1])] if quoted else []
                rows.append((i, n, sorted(set(_words(n))), [w for w in (p["first"], *p["middle"]) if len(w) > 1] if person else [], p["first"] if person else None, p["family"] if person else None, " ".join([p["family"], p["mother"]]) if person and len(p["mother"]) > 1 else None, said[0] if len(said) == 1 else None))
            yield pd.DataFrame(rows, columns=["name_id", "nome", "words", "given", "first", "family", "others", "quoted"])

    once = names.where("name_id is not null and nome is not null").groupBy("name_id").agg(F.min("nome").alias("nome"))
    return once.mapInPandas(run, schema)


def crowded(at: DataFrame) -> DataFrame:
    """at(others, first, n, few) -> (x, y, c), x < y: beside how many ``others`` two first words stand, of pairs that can be a nickname and its name.

    n: all others the first word is found beside; few: as many of them may be
    added to what is counted here. The first words are parted, and any two parts
    come together in a place of their own, where one table counts all pairs of
    their words: no pair is formed, whatever the number beside the same others.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, told, count = None, [], None

        def enough() -> pd.DataFrame:
            p, q = np.nonzero(np.triu(count, 1) if cell[0] == cell[1] else count)
            n, few = (np.minimum(x[p], y[q]) for x, y in told)
            ok = count[p, q] + few >= np.maximum(NICK_SHARE * n, NICK_TIMES)
            return pd.DataFrame({"i": cell[0], "j": cell[1], "p": p[ok], "q": q[ok], "c": count[p[ok], q[ok]]})

        for b in batches:
            for i, j, row, p, q in zip(b["i"], b["j"], b["row"], b["p"], b["q"]):
                if (i, j) != cell:
                    if cell:
                        yield enough()
                    cell, told, count = (i, j), [], np.zeros((len(p), len(q)), dtype="int32")
                if row < 2:  # n of the words of both parts, then few, then who stands beside the same others
                    told.append((p, q))
                else:
                    count[np.ix_(p, q)] += 1
        if cell:
            yield enough()

    words = cut(at.select("first", "n", "few").distinct())
    n = spread(at.sparkSession)
    parts = max(-(-words.count() // PART), math.isqrt(2 * n))
    placed = words.withColumn("part", F.pmod(F.xxhash64("first"), F.lit(parts)))
    placed = cut(placed.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("first")) - 1))
    told = placed.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("k", "n", "few"))).alias("v"))
    rows = [told.select(F.lit(i).alias("row"), F.lit("").alias("others"), "part", F.col(f"v.{c}").alias("v")) for i, c in enumerate(("n", "few"))]
    beside = at.join(placed.select("first", "part", "k"), "first").groupBy("others", "part").agg(F.collect_list(F.col("k").cast("long")).alias("v"))
    every = cut(reduce(DataFrame.unionByName, [*rows, beside.withColumn("row", F.lit(2))]))
    side = lambda i, p: every.select("row", "others", F.col("part").alias(i), F.col("v").alias(p))
    cells = side("i", "p").join(side("j", "q"), ["row", "others"]).where("i <= j").drop("others")
    met = cells.repartition(n, "i", "j").sortWithinPartitions("i", "j", "row").mapInPandas(run, "i long, j long, p long, q long, c long")
    word = lambda i, p, w: placed.select(F.col("part").alias(i), F.col("k").cast("long").alias(p), F.col("first").alias(w))
    return met.join(word("i", "p", "a"), ["i", "p"]).join(word("j", "q", "b"), ["j", "q"]).select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "c")


def nicknames(said: DataFrame) -> DataFrame:
    """facts -> (nick, full): first words that stand for another one.

    Either the names themselves say so in quotes, more often of this first name
    than of others; or both stand first before the same other words in
    ``NICK_TIMES`` families or more, ``NICK_SHARE`` of all the nickname is in,
    however many first words these other words are found with.
    """
    own = said.where("quoted is not null and length(quoted) > 1 and length(first) > 1 and quoted != first").groupBy("quoted", "first").agg(F.countDistinct("others", "family").alias("c"))
    own = own.groupBy("quoted").agg(F.max_by("first", F.struct("c", "first")).alias("full"), F.max("c").alias("top"), F.sum("c").alias("n")).where("2 * top > n").select(F.col("quoted").alias("nick"), "full")
    at = cut(said.where("others is not null and length(first) > 1").select("others", "first").distinct())
    of = at.groupBy("first").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {NICK_TIMES}")  # fewer are never enough
    beside = cut(at.join(of, "first").groupBy("others").agg(F.sort_array(F.collect_set("first")).alias("f")).where("size(f) > 1"))
    few, many = beside.where(f"size(f) <= {CROWD}"), beside.where(f"size(f) > {CROWD}")
    pairs = few.select(F.explode(F.expr("flatten(transform(f, (x, i) -> transform(slice(f, i + 2, size(f)), y -> struct(x, y))))")).alias("p")).groupBy("p.x", "p.y").agg(F.count(F.lit(1)).alias("c"))
    if not many.isEmpty():
        pairs, crowd = cut(pairs), cut(many.select("others", F.explode("f").alias("first")))
        held = cut(crowd.groupBy("first").agg(F.count(F.lit(1)).alias("m")))
        # with a word of fewer crowds than NICK_TIMES only those can stand together often enough that also do so elsewhere
        side = lambda w, m: held.select(F.col("first").alias(w), F.col("m").alias(m))
        rest = pairs.join(side("x", "mx"), "x").join(side("y", "my"), "y").where(F.least("mx", "my") < NICK_TIMES)
        rest = rest.select("x", "y", F.when(F.col("mx") <= F.col("my"), F.col("x")).otherwise(F.col("y")).alias("r"), F.when(F.col("mx") <= F.col("my"), F.col("y")).otherwise(F.col("x")).alias("first"))
        rest = rest.join(crowd.withColumnRenamed("first", "r"), "r").join(crowd, ["others", "first"]).select("x", "y", F.lit(1).cast("long").alias("c"))
        told = of.join(held.where(f"m >= {NICK_TIMES}"), "first").join(few.select(F.explode("f").alias("first")).groupBy("first").agg(F.count(F.lit(1)).alias("few")), "first", "left")
        often = crowded(crowd.join(told.select("first", "n", F.coalesce("few", F.lit(0).cast("long")).alias("few")), "first"))
        pairs = pairs.unionByName(rest).unionByName(often).groupBy("x", "y").agg(F.sum("c").alias("c"))
    both = pairs.where(f"c >= {NICK_TIMES}").join(of.select(F.col("first").alias("x"), F.col("n").alias("nx")), "x").join(of.select(F.col("first").alias("y"), F.col("n").alias("ny")), "y")
    less = F.when(F.col("nx") <= F.col("ny"), F.struct(F.col("x").alias("nick"), F.col("y").alias("full"), F.col("nx").alias("n"))).otherwise(F.struct(F.col("y").alias("nick"), F.col("x").alias("full"), F.col("ny").alias("n")))
    met = both.select("c", less.alias("l")).where(F.col("c") >= NICK_SHARE * F.col("l.n")).select("l.nick", "l.full")
    return own.unionByName(met).distinct()


def forms(names: DataFrame, nicks: DataFrame | None = None) -> DataFrame:
    """(name_id, nome, said, form, weight): each name, what it says, the least name_id of the names that say the same, and how many these are.

    Blank and null names, and null ids, are left out; of a name_id that is
    repeated the least spelling counts. Names that don't agree even with their
    like (no first name, a family name of one letter) have a form each.
    nicks(nick, full), folded, is added to what is learned.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, n, short, known in zip(b["name_id"], b["nome"], b["short"], b["known"]):
                alias: dict[str, list[str]] = {}
                for x in short if short is not None else ():
                    alias.setdefault(x["nick"], []).append(x["full"])
                p = parse(n, alias, known)
                said = json.dumps(p, sort_keys=True)
                rows.append((i, n, said, said if agree(p, p) else str(i)))
            yield pd.DataFrame(rows, columns=["name_id", "nome", "said", "key"])

    said = cut(facts(names))
    stands = nicknames(said) if nicks is None else nicknames(said).unionByName(nicks.where("nick is not null and full is not null").select("nick", "full")).distinct()
    common = said.select(F.explode("given").alias("w"), "family").groupBy("w").agg(F.countDistinct("family").alias("n")).where(f"n >= {KNOWN}").select("w", F.lit(True).alias("common"))
    alias = stands.groupBy(F.col("nick").alias("w")).agg(F.collect_set("full").alias("fulls"))
    word = said.select("name_id", F.explode("words").alias("w")).join(common, "w", "left").join(alias, "w", "left").where("common or fulls is not null")
    short = F.flatten(F.collect_list(F.transform("fulls", lambda x: F.struct(F.col("w").alias("nick"), x.alias("full")))))
    told = word.groupBy("name_id").agg(short.alias("short"), F.collect_set(F.when(F.col("common"), F.col("w"))).alias("known"))
    parsed = cut(said.select("name_id", "nome").join(told, "name_id", "left").select("name_id", "nome", "short", "known").mapInPandas(run, "name_id long, nome string, said string, key string"))
    alike = parsed.groupBy("key").agg(F.min("name_id").alias("form"), F.count(F.lit(1)).alias("weight"))
    return cut(parsed.join(alike, "key").select("name_id", "nome", "said", "form", "weight"))


def _features(heads: DataFrame, of) -> DataFrame:
    """(form, weight, gram, tf): the features that ``of(name, said)`` gives of every form, long form."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, w, g, c) for i, n, p, w in zip(b["form"], b["nome"], b["said"], b["weight"]) for g, c in Counter(of(n, json.loads(p))).items()]
            yield pd.DataFrame(rows, columns=["form", "weight", "gram", "tf"])

    return heads.select("form", "nome", "said", "weight").mapInPandas(run, "form long, weight long, gram string, tf long")


def vectors(heads: DataFrame) -> DataFrame:
    """(form, grams, weights): the n-grams of every form and their weights, of unit length."""
    long = cut(_features(heads, trigrams))
    n = heads.agg(F.sum("weight")).first()[0] or 0
    df = long.groupBy("gram").agg(F.sum("weight").alias("df"))
    w = long.join(df, "gram").withColumn("w", (1 + F.log("tf")) * (1 + F.log(F.lit(float(n) + 1) / F.col("df"))))
    per = w.groupBy("form").agg(F.array_sort(F.collect_list(F.struct("gram", "w"))).alias("v"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return per.select("form", F.transform("v", lambda x: x["gram"]).alias("grams"), F.transform("v", lambda x: (x["w"] / F.col("norm")).cast("float")).alias("weights"))


def meetings(heads: DataFrame) -> DataFrame:
    """(gram, form): the pairs of n-grams that two forms at least have."""
    keys = cut(_features(heads, lambda n, p: set(grams(p))).select("gram", "form"))
    held = keys.groupBy("gram").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    return keys.join(held, "gram").select("gram", "form")


@lru_cache(50_000)
def _letters(w: str) -> int:
    """The letters of a word as bits; other letters may share one."""
    return reduce(lambda m, c: m | 1 << ord(c) % 64, w, 0)


def _may(words: list[str], given: bool) -> np.ndarray:
    """Of all pairs of rows whether ``_same`` can hold of their words (or two errors, of first names), by lengths and letters; a blank word passes."""
    size, bits = np.array([len(w) for w in words]), np.array([_letters(w) for w in words], dtype="uint64")
    start = np.array([ord(w[0]) if w else 0 for w in words])
    least, most = np.minimum.outer(size, size), np.maximum.outer(size, size)
    # an error adds or takes a letter, or puts one in place of another
    errors = np.where(least >= 5, 2, 1) if given else np.where(least <= 3, 0, np.where((least <= 5) | (most <= 7), 1, 2))
    near = (np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 2 * errors) & (most - least <= errors)
    return near | (least == 0) | ((least == 1) & (start[:, None] == start[None, :]))


def _agreeing(ids: list[int], said: list[dict], part: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (a, b), a < b, of rows that agree; where there are two parts, those of different parts."""
    may = np.triu(np.ones((len(ids), len(ids)), dtype=bool), 1)
    if part.min() != part.max():
        may &= part[:, None] != part[None, :]
    if len(ids) > 5 and all(p["kind"] == "P" for p in said):  # most pairs are told apart by lengths and letters
        nick = np.array([p["first"] in p["nicks"] for p in said])
        may &= _may([p["first"] for p in said], True) | nick[:, None] | nick[None, :]
        may &= _may([p["family"] for p in said], False) & _may([p["mother"] for p in said], False)
    return [(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in np.argwhere(may).tolist() if agree(said[i], said[j])]


def agreeing(met: DataFrame, heads: DataFrame) -> DataFrame:
    """met(key, form) -> (a, b), a < b: forms that share a key and don't contradict each other.

    Pairs are formed where the forms of a key are together, and only those that
    agree go on: names travel once a key, not once a pair. Where a key has more
    than ``BLOCK`` forms, these are parted, and any two parts come together in a
    place of their own, so that no task has more than two parts at a time.
    """
    met = met.toDF("key", "form")
    sized = met.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("parts"))
    own = F.pmod(F.xxhash64("form"), F.col("parts"))
    placed = met.join(sized, "key").withColumn("part", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cells = placed.join(heads.select("form", "said"), "form").select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "form", "said")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[tuple[int, int]] = []
        cell, ids, said, part = None, [], [], []
        for b in batches:
            for *at, k, f, p in b.itertuples(index=False):
                if at != cell:
                    if len(ids) > 1:
                        found += _agreeing(ids, said, np.array(part))
                    cell, ids, said, part = at, [], [], []
                ids.append(f), said.append(json.loads(p)), part.append(k)
            if len(found) > 100_000:
                yield pd.DataFrame(set(found), columns=["a", "b"])
                found = []
        if len(ids) > 1:
            found += _agreeing(ids, said, np.array(part))
        yield pd.DataFrame(sorted(set(found)), columns=["a", "b"], dtype="int64")

    n = spread(met.sparkSession)
    return cells.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInPandas(run, "a long, b long").distinct()


def _cosines(pairs: DataFrame, vec: DataFrame, min_cosine: float) -> DataFrame:
    """pairs(a, b) -> (a, b, sim, weight_a, weight_b), with the cosine of their vectors, of those at least ``min_cosine`` alike.

    vec(form, grams, weights, said, weight): of each form its vector and what it says.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[["a", "b", "weight_a", "weight_b"]].copy()
            out["sim"] = [_dot(*v) for v in zip(b["grams_a"], b["weights_a"], b["grams_b"], b["weights_b"])]
            yield out.loc[out["sim"] >= min_cosine, ["a", "b", "sim", "weight_a", "weight_b"]]

    side = lambda x: vec.select(F.col("form").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("grams", "weights", "weight")])
    return balanced(pairs.join(side("a"), "a").join(side("b"), "b")).mapInPandas(run, "a long, b long, sim double, weight_a long, weight_b long")


def _dot(ga: np.ndarray, wa: np.ndarray, gb: np.ndarray, wb: np.ndarray) -> float:
    other = dict(zip(gb, wb.tolist()))
    return sum(w * other.get(g, 0.0) for g, w in zip(ga, wa.tolist()))


def similar(alike: DataFrame, min_cosine: float = MIN_COSINE, top: int = TOP) -> tuple[DataFrame, DataFrame]:
    """((a, b, sim, weight_a, weight_b), vectors): the forms that may be one, at least ``min_cosine`` alike, a < b.

    Of every form the ``top`` nearest; a pair stays if either keeps the other.
    """
    heads = alike.where("name_id = form")
    vec = cut(vectors(heads).join(heads.select("form", "said", "weight"), "form"))
    all_pairs = cut(_cosines(cut(agreeing(meetings(heads), heads)), vec, min_cosine))
    ends = all_pairs.select(F.col("a").alias("x"), "a", "b", "sim").unionByName(all_pairs.select(F.col("b").alias("x"), "a", "b", "sim"))
    near = ends.withColumn("rk", F.row_number().over(Window.partitionBy("x").orderBy(F.col("sim").desc(), "a", "b"))).where(F.col("rk") <= top).select("a", "b").distinct()
    return cut(all_pairs.join(near, ["a", "b"], "left_semi")), vec


def completed(edges: DataFrame, vec: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """The links, and those found by comparing the forms that have a link to a third in common but aren't linked yet."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = cut(agreeing(both.select("b", "a"), vec).join(edges, ["a", "b"], "left_anti"))
    return edges.unionByName(_cosines(near, vec, min_cosine))


def average_linkage(sim: np.ndarray, least: float) -> list[list[int]]:
    """Groups of row numbers: the two groups with the highest average similarity are merged while it is at least ``least``.

    The definition, over a full matrix; ``linkage`` does the same over links.
    """
    n = len(sim)
    groups: list[list[int] | None] = [[i] for i in range(n)]
    total = sim.astype(float).copy()
    np.fill_diagonal(total, -np.inf)
    size = np.ones(n)
    while True:
        mean = total / np.outer(size, size)
        i, j = np.unravel_index(np.argmax(mean), mean.shape) if n > 1 else (0, 0)
        if i == j or not mean[i, j] >= least:
            return [g for g in groups if g]
        groups[i] += groups[j]
        groups[j] = None
        total[i] += total[j]
        total[:, i] += total[:, j]
        total[i, i] = -np.inf
        total[j] = total[:, j] = -np.inf
        size[i] += size[j]


def _priority(a: int, b: int) -> int:
    """Decides among equal averages, in no order of ids, so that many of them merge in one round."""
    return zlib.crc32(f"{a}-{b}".encode())


def merged(e: pd.DataFrame, least: float) -> dict[int, int]:
    """Node -> least node of its group, for links (a, b, t, wa, wb) that one task holds; nodes that stay alone are left out.

    Rounds: the pairs of groups that are each other's best merge. As no average
    of a merged group exceeds the higher of its parts', this is the result of
    merging the best pair of all one by one.
    """
    ids, ends = np.unique(np.concatenate([e["a"].to_numpy("int64"), e["b"].to_numpy("int64")]), return_inverse=True)
    a, b = ends[: len(e)], ends[len(e) :]  # as rows of ids, which keep their order
    t = e["t"].to_numpy("int64")
    size = np.ones(len(ids), dtype="int64")
    size[a], size[b] = e["wa"], e["wb"]
    steps = []
    while True:
        q = t / (size[a] * size[b])
        ok = np.flatnonzero(q >= (1 + least) * UNIT)
        if not len(ok):
            break
        # a group none of whose averages suffices stays as it is, and bears on no other
        live = np.zeros(len(ids), dtype=bool)
        live[a[ok]] = live[b[ok]] = True
        h = np.array([_priority(x, y) for x, y in zip(ids[a[ok]].tolist(), ids[b[ok]].tolist())], dtype="int64")
        ok = ok[np.lexsort((b[ok], a[ok], h, -q[ok]))]
        rank = np.arange(len(ok))
        best = np.full(len(ids), len(ok))
        np.minimum.at(best, a[ok], rank)
        np.minimum.at(best, b[ok], rank)
        both = ok[(best[a[ok]] == rank) & (best[b[ok]] == rank)]
        steps.append((ids[a[both]].tolist(), ids[b[both]].tolist()))
        into = np.arange(len(ids))
        into[b[both]] = a[both]
        size[a[both]] += size[b[both]]
        kept = live[a] & live[b]
        x, y, t = into[a[kept]], into[b[kept]], t[kept]
        a, b, t = np.minimum(x, y)[x != y], np.maximum(x, y)[x != y], t[x != y]
        pair, at = np.unique(a * len(ids) + b, return_inverse=True)
        a, b, was, t = pair // len(ids), pair % len(ids), t, np.zeros(len(pair), dtype="int64")
        np.add.at(t, at, was)
    out: dict[int, int] = {}
    for xs, ys in reversed(steps):
        for x, y in zip(xs, ys):
            out[y] = out.setdefault(x, x)
    return out


def _round(e: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """One round of ``merged`` by joins: the merges (a, b), and the links that remain."""
    q = e.withColumn("q", F.col("t") / (F.col("wa") * F.col("wb"))).where(F.col("q") >= (1 + least) * UNIT)
    ranked = q.select("a", "b", "wa", "wb", F.struct((-F.col("q")).alias("q"), F.crc32(F.concat_ws("-", "a", "b").cast("binary")).alias("h"), "a", "b").alias("r"))
    ends = ranked.select(F.col("a").alias("node"), "r", "wa", "wb").unionByName(ranked.select(F.col("b").alias("node"), "r", "wa", "wb"))
    best = cut(ends.groupBy("node").agg(F.min_by(F.struct("r", "wa", "wb"), "r").alias("x")).select("node", "x.r.a", "x.r.b", "x.wa", "x.wb"))
    both = cut(best.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), (F.first("wa") + F.first("wb")).alias("w")).where("n = 2").select("a", "b", "w"))
    to = both.select(F.col("a").alias("node"), F.col("a").alias("into"), "w").unionByName(both.select(F.col("b").alias("node"), F.col("a").alias("into"), "w"))
    state = cut(best.select("node").join(to, "node", "left"))
    side = lambda x: state.select(F.col("node").alias(x), F.col("into").alias(f"into_{x}"), F.col("w").alias(f"more_{x}"))
    x = e.join(side("a"), "a").join(side("b"), "b").select(F.coalesce("into_a", "a").alias("a"), F.coalesce("into_b", "b").alias("b"), "t", F.coalesce("more_a", "wa").alias("wa"), F.coalesce("more_b", "wb").alias("wb")).where("a != b")
    x = x.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "t", F.when(F.col("a") < F.col("b"), F.col("wa")).otherwise(F.col("wb")).alias("wa"), F.when(F.col("a") < F.col("b"), F.col("wb")).otherwise(F.col("wa")).alias("wb"))
    return both.select("a", "b"), cut(x.groupBy("a", "b").agg(F.sum("t").alias("t"), F.first("wa").alias("wa"), F.first("wb").alias("wb")))


def linkage(edges: DataFrame, least: float = MIN_LINK) -> DataFrame:
    """(node, into): the least node of each group of average linkage; nodes that stay alone are left out.

    edges(a, b, sim, weight_a, weight_b): pairs that aren't listed contradict
    each other (-1). Components of more than ``LOCAL`` links take the same
    rounds by joins until so few are left.
    """
    # sums of similarity + 1 in whole units: exact, whatever the order
    e = cut(edges.select("a", "b", (F.round((F.col("sim") + 1) * UNIT).cast("long") * F.col("weight_a") * F.col("weight_b")).alias("t"), F.col("weight_a").alias("wa"), F.col("weight_b").alias("wb")))
    placed = cut(e.join(components(e.select("a", "b")), F.col("a") == F.col("node")).drop("node"))
    sized = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    n = max(spread(e.sparkSession), 4 * e.count() // LOCAL)

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        out = merged(pdf[["a", "b", "t", "wa", "wb"]], least)
        return pd.DataFrame({"node": pd.Series(list(out), dtype="int64"), "into": pd.Series(list(out.values()), dtype="int64")})

    # a stated number of partitions stays as it is: adaptive execution would fold small tables into one task
    few = placed.join(sized.where(F.col("n") <= LOCAL), "component").withColumn("part", F.pmod(F.hash("component"), F.lit(n))).repartition(n, "part")
    done = few.groupBy("part").applyInPandas(local, "node long, into long")
    big = cut(placed.join(sized.where(F.col("n") > LOCAL), "component").select("a", "b", "t", "wa", "wb"))
    merges: list[DataFrame] = []
    while (left := big.count()) > LOCAL:
        step, big = _round(big, least)
        merges.append(step)
    if merges:
        if left:
            merges.append(big.groupBy().applyInPandas(local, "node long, into long").select(F.col("into").alias("a"), F.col("node").alias("b")))
        done = done.unionByName(components(reduce(DataFrame.unionByName, merges)).select("node", F.col("component").alias("into")))
    return done


def groups(names: DataFrame, min_cosine: float = MIN_COSINE, min_link: float = MIN_LINK, nicks: DataFrame | None = None) -> DataFrame:
    """(name_id, nome, group_id, links): names of one person or body share the least name_id of their group.

    One row for every name; one that stands alone is its own group. ``links``
    counts the other names that are similar and don't contradict it. Null and
    blank names, and null ids, are left out. Of a name_id that is repeated the
    least spelling counts. nicks(nick, full) adds to the nicknames learned.
    """
    alike = forms(names, nicks)
    edges = cut(completed(*similar(alike, min_cosine), min_cosine))
    ends = edges.select(F.col("a").alias("form"), F.col("weight_b").alias("w")).unionByName(edges.select(F.col("b").alias("form"), F.col("weight_a").alias("w")))
    linked = ends.groupBy("form").agg(F.sum("w").alias("w"))
    into = linkage(edges, min_link).select(F.col("node").alias("form"), "into")
    n = F.coalesce("w", F.lit(0)) + F.col("weight") - 1
    return alike.join(linked, "form", "left").join(into, "form", "left").select("name_id", "nome", F.coalesce("into", "form").alias("group_id"), n.alias("links"))


def found(names: DataFrame, min_cosine: float = MIN_COSINE, min_link: float = MIN_LINK, nicks: DataFrame | None = None) -> DataFrame:
    """p3_found: all pairs of name_id of one person or body, the smaller first."""
    g = groups(names, min_cosine, min_link, nicks)
    lists = g.groupBy("group_id").agg(F.array_sort(F.collect_set("name_id")).alias("ids")).where("size(ids) > 1")
    pairs = lists.select("ids", F.posexplode("ids").alias("i", "name_a")).select("name_a", F.explode(F.expr("slice(ids, i + 2, size(ids))")).alias("name_b"))
    return pairs
