"""Repair of text from scanned pages: edge lines, words cut across lines, misread words.

* Edge lines. A page number is a line of a number and nothing else that fits
  the page sequence. A running header is a short line that breaks the flow of
  the wrapped text or lies at a page edge, and says the title, a heading of the
  work, or the same as other such lines.
* Cut words. A line that ends in a hyphen is a cut word unless the hyphen is
  the word's own; the evidence is which of the joined and the hyphened form the
  corpus uses.
* Misread words. Every word has an anagram hash: the sum of a fixed number per
  character, whatever their order. A confusion (``rn`` read for ``m``) changes
  the hash by a fixed difference. So rare words are joined with frequent ones
  by equality of hash minus difference, in SQL, over all words of the corpus;
  the few pairs found are then checked for the substitution itself and ranked
  by (number of confusions, frequency).

The repaired text keeps page anchors and headings, drops edge lines, joins cut
words, corrects misread ones and flows lines into paragraphs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations_with_replacement

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.functions.fuzzy import fold, osa
from tabularium.sources.tables import balanced, cut

# What the scanner reads, and what stood there.
CONFUSIONS = (
    ("|", "i"), ("|", "l"), ("|", "í"), ("1", "l"), ("1", "i"), ("0", "o"), ("0", "ó"), ("5", "s"), ("6", "é"), ("6", "e"), ("4", "a"), ("4", "á"), ("8", "b"), ("9", "g"),
    ("rn", "m"), ("ri", "n"), ("ii", "u"), ("cl", "d"), ("f", "t"), ("c", "e"), ("b", "h"), ("vv", "w"), ("c¸", "ç"), ("a~", "ã"), ("o~", "õ"), ("n~", "ñ"), ("m", "rn"), ("d", "cl"), ("ﬁ", "fi"), ("ﬂ", "fl"),
)
HYPHENS = "-¬\xad‐‑"
ROWS_AT_ONCE = 50_000  # rows a worker holds before it hands them on; memory only
RATIO = 5  # a misread spelling is at least this many times rarer than the right one,
RATE = 0.01  # and no more frequent than misreading this share of it would make it, give or take three standard deviations
ODD = r"[|¸~ﬁﬂ]|\p{L}\d|\d\p{L}"  # signs only a scanner writes into words: a bar, a loose mark, a ligature, a digit beside a letter
_ANCHOR = re.compile(r"^\s*(?:\{\{\s*(?:p|loc)\.\s*([^}\s]+)\s*\}\}|<!--.*?-->)\s*$")
_NUMBER = re.compile(r"^[\s\[\](){}<>—–\-·.*|]*(p[áa]g(?:ina)?\.?|p\.|página|seite|s\.|page)?\s*(\d{1,5}|[ivxlcdm]+|[IVXLCDM]+)(?:\s+(?:de|of|von|/|sur|di)\s+\d+)?[\s\[\](){}<>—–\-·*|]*$", re.I)
_HEADWORD = re.compile(r"^(?:t[íi]tulo|cap[íi]tulo|se[çc][ãa]o|parte|livro|anexo|artigo|chapter|part|section|kapitel|teil|abschnitt|chapitre|partie|titre|capitolo|sezione|titolo|cap[íi]tulo|secci[óo]n)\s+(?:\d+|[ivxlcdm]+)\b", re.I)
_EDGE_NUMBER = re.compile(r"^\s*(?:\d{1,5}|[ivxlcdm]{1,9})\s*(?:[|·—–-]\s*|\s{2,})|(?:\s*[|·—–-]\s*|\s{2,})(?:\d{1,5}|[ivxlcdm]{1,9})\s*$|\s+\d{1,5}\s*$")
_SQUASH = str.maketrans({"|": "i", "0": "o", "5": "s", "1": "l", "6": "e", "4": "a", "¸": "", "~": ""})
_TOKEN = re.compile(r"[^\W_]+(?:[|¸~][^\W_]*)*|[|][^\W_]+(?:[|¸~]+[^\W_]*)*")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_] ){3,}[^\W\d_](?![^\W_])")  # a word whose letters were read one by one
_ORDINAL = re.compile(r"^\d+(?:[ºªoa°]|st|nd|rd|th|er|e|ème)?$")
_PAIR = re.compile(r"[^\W\d_]+-[^\W\d_]+")
_ENDS = (".", "!", "?", ":", ";", ",")


def squash(line: str) -> str:
    """What a header line says, without page number, case, accents, spaces and misread characters."""
    text = _EDGE_NUMBER.sub("", line.strip())
    return re.sub(r"[^a-z]", "", fold(text.strip()).translate(_SQUASH))


def alike(a: str, b: str) -> bool:
    """Do two squashed lines say the same, give or take misread characters?"""
    if a == b:
        return True
    most = max(1, min(len(a), len(b)) // 7)
    return min(len(a), len(b)) >= 6 and abs(len(a) - len(b)) <= most and osa(a, b, most) <= most


def roman(text: str) -> int | None:
    """Value of a roman number, None if it isn't one in plain form."""
    value = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    t = text.lower()
    if not t or any(c not in value for c in t):
        return None
    n = [value[c] for c in t]
    return sum(-x if i + 1 < len(n) and x < n[i + 1] else x for i, x in enumerate(n))


def edges(lines: list[str], title: str | None) -> dict[int, str]:
    """Line number (from 0) -> 'header' or 'pageno' of one work."""
    n = len(lines)
    bare = [x.strip() for x in lines]
    anchor = [bool(_ANCHOR.match(x)) for x in lines]
    marks = [int(m[1]) for x in lines if (m := _ANCHOR.match(x)) and m[1] and m[1].isdigit()]
    found: dict[int, str] = {}
    # page numbers: not in a list of numbers, and within the pages the anchors tell
    numbers: dict[int, int] = {}
    for i, x in enumerate(bare):
        if x and not anchor[i] and (m := _NUMBER.match(lines[i])) and not x.endswith((",", ";", ":")) and not (x.endswith(".") and not m[1]):
            v = int(m[2]) if m[2].isdigit() else roman(m[2])
            if v is not None and (m[2].isdigit() or len(m[2]) > 1 or m[2].lower() in "ivx"):
                numbers[i] = v
    near = lambda i, step: next((j for j in range(i + step, n if step > 0 else -1, step) if bare[j]), None)
    for i, v in numbers.items():
        up, down = near(i, -1), near(i, 1)
        listed = (up is not None and up == i - 1 and (up in numbers or bare[up].endswith(":"))) or (down is not None and down == i + 1 and down in numbers)
        if not listed and (not marks or min(marks) - 3 <= v <= max(marks) + 3):
            found[i] = "pageno"
    # running headers
    body = sorted(len(x) for i, x in enumerate(bare) if x and i not in numbers and not anchor[i] and not x.startswith("#"))
    width = body[int(len(body) * 0.95) - (len(body) > 20)] if body else 0
    wrapped = width and width <= 120
    heads: dict[str, int] = {}
    candidates: dict[int, str] = {}
    for i, x in enumerate(bare):
        if not x or anchor[i] or i in found:
            continue
        up_blank, down_blank = i == 0 or not bare[i - 1], i == n - 1 or not bare[i + 1]
        key = squash(x.lstrip("#"))
        alone = up_blank and down_blank
        if x.startswith("#"):
            heads.setdefault(key, i)
            continue
        if len(x) > 90 or x.endswith(_ENDS) or not key or x[:1] == "(" or (x[:1] in ">-*+" and x[1:2] in (" ", "")):
            continue
        if alone and _HEADWORD.match(x) and not x.isupper() and not re.search(r"(?:\||\s{2,})\s*\d+\s*$", x) and not any(alike(key, h) for h in heads):
            heads[key] = i
            continue
        candidates[i] = key
    t = squash(title or "")
    edge, flow = {}, {}
    for i in candidates:
        up = next((j for j in range(i - 1, -1, -1) if bare[j] and j not in found), None)
        down = next((j for j in range(i + 1, n) if bare[j] and j not in found), None)
        edge[i] = (up is None or anchor[up]) or (down is None or anchor[down]) or (i - 1 in found) or (i + 1 in found)
        nxt = next((j for j in range(i + 1, n) if bare[j] and not anchor[j] and j not in found), None)
        before = next((j for j in range(i - 1, -1, -1) if bare[j] and not anchor[j] and j not in found), None)
        word = bare[nxt].split()[0] if nxt is not None else ""
        short = wrapped and len(bare[i]) + 1 + len(word) <= width - 3
        starts = not bare[i][:1].islower()
        cuts_text = before is not None and before == i - 1 and not bare[before].endswith((".", "!", "?"))
        flow[i] = bool(short and starts and (nxt is None or nxt == i + 1 or edge[i]) and (cuts_text or edge[i]))
    seen: Counter[str] = Counter()
    for i, key in candidates.items():
        if edge[i] or flow[i]:
            seen[key] += 1
    common = [k for k, c in seen.items() if c >= 2]
    for i, key in candidates.items():
        at_start = not any(bare[j] for j in range(i))
        as_title = len(t) >= 6 and alike(key, t) and not (at_start and (i + 1 >= n or not bare[i + 1]))
        as_head = any(alike(key, h) for h in heads)
        number = bool(re.search(r"(?:\||\s{2,})\s*\d{1,5}\s*$|^\s*\d{1,5}\s{2,}", lines[i].rstrip()))
        again = key in seen and (seen[key] >= 2 or any(alike(key, k) for k in common))
        if as_title or (as_head and (edge[i] or flow[i] or number)) or ((again or number) and (edge[i] or flow[i]) and len(key) >= 5 and _name_like(bare[i])) or (flow[i] and len(bare[i].split()) >= 2 and _name_like(bare[i])):
            found[i] = "header"
    # headers just found may show that a number beside them is a page number; nothing more to do for the rest
    return found


def _name_like(text: str) -> bool:
    """Words of a title or name: most begin with a capital, or all letters are capitals."""
    words = [w for w in re.findall(r"[^\W\d_][\w|¸~'’-]*", text) if len(w) > 3]
    return bool(words) and sum(w[0].isupper() for w in words) >= 0.6 * len(words)


def cut_words(lines: list[str], edge: dict[int, str]) -> list[tuple[int, int, str, str]]:
    """(line, line of the rest, first part, rest) of words that a line of running text ends in the middle of."""
    out = []
    for i, x in enumerate(lines):
        s = x.rstrip()
        s = re.sub(r"(?<=[^\W_]) (?=[" + HYPHENS + r"]$)", "", s) if len(s) > 6 and s[-4] == " " else s
        s = _SPACED.sub(lambda m: m.group().replace(" ", ""), s)
        if i in edge or len(s) < 2 or s[-1] not in HYPHENS or not (s[-2].isalnum() or s[-2] in "|¸~") or _ANCHOR.match(x) or s.lstrip().startswith("#"):
            continue
        j = i + 1
        while j < len(lines) and (not lines[j].strip() or j in edge or _ANCHOR.match(lines[j])):
            j += 1
        if j >= len(lines):
            continue
        head = re.search(r"((?:[^\W_]|(?<=[^\W_])[|¸~]|[|](?=[^\W_]))+)[" + HYPHENS + r"]$", s)
        if head and head[1].isdigit():
            continue
        rest = re.match(r"\s*(?:>\s*)?([^\W_]+(?:[|¸~][^\W_]*)*)", lines[j])
        if head and rest and (rest[1][0].islower() or rest[1][0] in "|" or rest[1][0].isdigit()):
            out.append((i, j, head[1], rest[1]))
    return out


def tokens(lines: list[str], edge: dict[int, str]) -> tuple[list[tuple[int, str]], list[tuple[int, int, str, str]]]:
    """((line, word) of running text, cut words). Words are lower case; of a cut word neither part is listed."""
    broken = cut_words(lines, edge)
    heads, rests = {i for i, _, _, _ in broken}, {j for _, j, _, _ in broken}
    out = []
    for i, x in enumerate(lines):
        s = x.strip()
        if not s or i in edge or _ANCHOR.match(x) or s.startswith("#") or (_HEADWORD.match(s) and (i == 0 or not lines[i - 1].strip()) and (i + 1 == len(lines) or not lines[i + 1].strip())):
            continue
        words = [m.group() for m in _TOKEN.finditer(_SPACED.sub(" ", s) if i not in heads else _SPACED.sub(lambda m: m.group().replace(" ", ""), s))]
        if i in heads and words:
            words = words[:-1]
        if i in rests and words:
            words = words[1:]
        out += [(i, w.lower()) for w in words if any(c.isalpha() for c in w) and not _ORDINAL.match(w)]
    return out, broken


def word_hash(w: str) -> int:
    """Anagram hash: the sum over the characters of a fixed number each; below 2**56 for words under 2**15 letters."""
    return sum((ord(c) ** 3) % 2199023255531 for c in w)


def differences(most: int = 2) -> dict[int, int]:
    """Hash difference -> number of confusions, of one or ``most`` confusions together; the least number counts."""
    one = sorted({word_hash(a) - word_hash(b) for a, b in CONFUSIONS})
    out: dict[int, int] = {}
    for k in range(most, 0, -1):
        for c in combinations_with_replacement(one, k):
            if sum(c):
                out[sum(c)] = k
    return out


def reads_as(seen: str, meant: str, most: int = 2) -> bool:
    """Can ``seen`` be ``meant`` with at most ``most`` confusions?"""

    def go(i: int, j: int, left: int) -> bool:
        while i < len(seen) and j < len(meant) and seen[i] == meant[j]:
            if left and any(seen.startswith(a, i) and meant.startswith(b, j) and go(i + len(a), j + len(b), left - 1) for a, b in CONFUSIONS):
                return True
            i, j = i + 1, j + 1
        if i == len(seen) and j == len(meant):
            return True
        return bool(left) and any(seen.startswith(a, i) and meant.startswith(b, j) and go(i + len(a), j + len(b), left - 1) for a, b in CONFUSIONS)

    return go(0, 0, most)


def _once(masters: DataFrame) -> DataFrame:
    rows = masters.select("master_id", F.col("titulo").cast("string").alias("titulo"), F.col("corpo").cast("string").alias("corpo"))
    return balanced(rows.where("master_id is not null and corpo is not null and corpo != ''"), "master_id", factor=2).dropDuplicates(["master_id", "corpo"])


_SCAN = pa.schema([("master_id", pa.int64()), ("line_no", pa.int64()), ("kind", pa.string()), ("word", pa.string()), ("rest", pa.string()), ("rest_no", pa.int64()), ("n", pa.int64()), ("lines", pa.list_(pa.int32()))])


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SCAN.types)], schema=_SCAN)


def scan(masters: DataFrame) -> DataFrame:
    """(master_id, line_no, kind, word, rest, rest_no, n, lines): what one pass over each work finds.

    kind 'header' and 'pageno' are edge lines; 'word' a word of running text
    with the number of its uses and the lines that hold it, one row a work;
    'cut' a word cut at a line's end with its rest on line rest_no, 'pair' a
    compound with its own hyphen, 'spaced' a word read letter by letter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for k, title, text in zip(*[b.column(i).to_pylist() for i in range(3)]):
                lines = text.split("\n")
                edge = edges(lines, title)
                words, broken = tokens(lines, edge)
                rows += [(k, i + 1, kind, None, None, None, 1, None) for i, kind in edge.items()]
                at: dict[str, list[int]] = {}
                for i, w in words:
                    at.setdefault(w, []).append(i + 1)
                rows += [(k, None, "word", w, None, None, len(on), sorted(set(on))) for w, on in at.items()]
                for i, x in enumerate(lines):
                    if i in edge:
                        continue
                    if not x.startswith("#"):
                        rows += [(k, i + 1, "spaced", m.group().replace(" ", "").lower(), None, None, 1, None) for m in _SPACED.finditer(x)]
                    if "-" in x:
                        rows += [(k, i + 1, "pair", m.group().lower(), None, None, 1, None) for m in _PAIR.finditer(x)]
                rows += [(k, i + 1, "cut", h.lower(), r.lower(), j + 1, 1, None) for i, j, h, r in broken]
                if len(rows) >= ROWS_AT_ONCE:
                    yield _packed(rows)
                    rows = []
            if rows:
                yield _packed(rows)

    once = _once(masters).select(F.col("master_id").cast("long").alias("master_id"), "titulo", "corpo")
    return once.mapInArrow(run, "master_id long, line_no long, kind string, word string, rest string, rest_no long, n long, lines array<int>")


def corrections(words: DataFrame, ratio: float = RATIO, rate: float = RATE) -> DataFrame:
    """words(word, n) -> (word, meant, steps): rare words and the frequent confusable variant each stands for.

    All words of the corpus take part on both sides. The best variant is the one
    with the fewest confusions, then the most frequent, then the first. Two
    confusions in a word are looked for only where one explains nothing. Words
    too frequent to be misread are left out before hashes are shifted.
    """
    h = F.pandas_udf(lambda s: s.map(word_hash).astype("int64"), "long")
    check = F.pandas_udf(lambda a, b: pd.Series([reads_as(x, y) for x, y in zip(a, b)]), "boolean")
    hw = cut(balanced(words.where("word is not null and n > 0")).withColumn("h", h("word")).withColumn("odd", F.col("word").rlike(ODD)))
    good = hw.where("not odd and length(word) >= 2").select(F.col("word").alias("meant"), F.col("n").alias("m"), "h")
    steps = differences()
    # no word is misread so often that even the most frequent one couldn't be what stood there: such words aren't laid out
    most = good.agg(F.max("m")).first()[0] or 0
    bound = min(most / ratio, 1 + rate * most + 3 * (rate * most) ** 0.5)

    def look(rare: DataFrame, k: int) -> DataFrame:
        shifts = [d for d, x in steps.items() if x == k]
        probe = rare.select("word", "n", "odd", F.col("h").alias("own"), F.explode(F.lit(shifts)).alias("d")).select("word", "n", "odd", (F.col("own") - F.col("d")).alias("h"))
        met = probe.join(good, "h").where(f"meant != word and (odd or (m >= {ratio} * n and n <= 1 + {rate} * m + 3 * sqrt({rate} * m))) and abs(length(word) - length(meant)) <= {k}")
        sure = met.select("word", "n", "meant", "m").distinct().where(check("word", "meant"))
        return sure.groupBy("word").agg(F.max_by("meant", F.struct("m", "meant")).alias("meant")).withColumn("steps", F.lit(k))

    rare = hw.where(f"odd or (length(word) >= 3 and n <= {bound!r})")
    first = cut(look(rare, 1))
    second = look(rare.join(first.select("word"), "word", "left_anti").where("odd or length(word) >= 5"), 2)
    return first.unionByName(second)


def _counts(seen: DataFrame) -> DataFrame:
    """(word, n): words of running text, cut ones joined, and compounds with their own hyphen."""
    whole = seen.where("kind in ('word', 'pair')").select("word", "n")
    joined = seen.where("kind = 'cut'").select(F.concat("word", "rest").alias("word"), "n")
    return whole.unionByName(joined).groupBy("word").agg(F.sum("n").alias("n"))


def judged(seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(corrections, cut words with ``own``): what the whole corpus says about the words found by ``scan``.

    A cut is the word's own hyphen where the corpus uses the hyphened form more
    often than the joined one (either read through the corrections).
    """
    counts = cut(_counts(seen))
    fixes = cut(corrections(counts.where("word not like '%-%'")))
    # compounds are few; parts and joined forms are looked up by equi-joins
    cuts = seen.where("kind = 'cut'").select("master_id", "line_no", "rest_no", "word", "rest").withColumn("joined", F.concat("word", "rest"))
    fix = fixes.select(F.col("word").alias("w"), "meant")

    def through(df: DataFrame, col: str, out: str) -> DataFrame:
        return df.join(fix.select(F.col("w").alias(col), F.col("meant").alias("__m")), col, "left").withColumn(out, F.coalesce("__m", col)).drop("__m")

    cuts = through(through(through(cuts, "word", "word_ok"), "rest", "rest_ok"), "joined", "joined_ok")
    cuts = cuts.withColumn("pair", F.concat_ws("-", "word_ok", "rest_ok"))
    cuts = cuts.join(counts.select(F.col("word").alias("pair"), F.col("n").alias("n_pair")), "pair", "left").join(counts.select(F.col("word").alias("joined_ok"), F.col("n").alias("n_joined")), "joined_ok", "left")
    own = F.coalesce(F.col("n_pair"), F.lit(0)) > F.coalesce(F.col("n_joined"), F.lit(0))
    return fixes, cuts.withColumn("own", own)


def found(masters: DataFrame) -> DataFrame:
    """p5_found: (master_id, line_no, defect) with defect header, pageno, hyphen or char.

    Null, empty and blank texts give no row, nor do null ids; repeated rows
    count once. Whole texts are read; all counts are over the whole corpus.
    """
    seen = cut(scan(masters))
    fixes, cuts = judged(seen)
    cuts = cut(cuts)
    edge = seen.where("kind in ('header', 'pageno')").select("master_id", "line_no", F.col("kind").alias("defect"))
    hyphen = cuts.where("not own").select("master_id", "line_no", F.lit("hyphen").alias("defect"))
    wrong = fixes.select("word", "meant")
    spaced = seen.where("kind = 'spaced'").select("master_id", "line_no")
    inline = seen.where("kind = 'word'").select("master_id", "lines", "word").join(wrong, "word").select("master_id", F.explode(F.col("lines").cast("array<long>")).alias("line_no"))
    # of a cut word, the line that holds the misread characters
    diff = F.pandas_udf(lambda a, b: pd.Series([_same_ends(x, y) for x, y in zip(a, b)]), "array<long>")
    broken = cuts.where("not own and joined != joined_ok").withColumn("e", diff("joined", "joined_ok"))
    first = broken.where("e[0] < length(word)").select("master_id", "line_no")
    second = broken.where("length(joined) - e[1] > length(word)").select("master_id", F.col("rest_no").alias("line_no"))
    parts = cuts.where("own")
    own = parts.where("word != word_ok").select("master_id", "line_no").unionByName(parts.where("rest != rest_ok").select("master_id", F.col("rest_no").alias("line_no")))
    char = inline.unionByName(spaced).unionByName(first).unionByName(second).unionByName(own).withColumn("defect", F.lit("char"))
    return edge.unionByName(hyphen).unionByName(char).distinct()


def _same_ends(a: str, b: str) -> list[int]:
    """Lengths of the common beginning and of the common end of two words."""
    n = min(len(a), len(b))
    p = next((i for i in range(n) if a[i] != b[i]), n)
    q = next((i for i in range(n - p) if a[-1 - i] != b[-1 - i]), n - p)
    return [p, q]


def repair(masters: DataFrame) -> DataFrame:
    """(master_id, texto): each work as continuous paragraphs, one a line, parted by blank lines.

    Anchors and headings stay on lines of their own. A paragraph that an edge
    line or an anchor interrupts goes on behind it: it is closed only by a blank
    line where the text before ends a sentence. Works with null or empty text
    give no row; of a repeated master one row is given for each different text.
    """
    seen = cut(scan(masters))
    fixes, cuts = judged(seen)
    edge = seen.where("kind in ('header', 'pageno')").select("master_id", "line_no")
    wrong = seen.where("kind = 'word'").select("master_id", "word").join(fixes.select("word", "meant"), "word").select("master_id", "word", "meant")
    wrong = wrong.unionByName(cuts.where("not own and joined != joined_ok").select("master_id", F.col("joined").alias("word"), F.col("joined_ok").alias("meant"))).distinct()
    # words read letter by letter: the longest beginning of the run that the corpus knows
    run_of = seen.where("kind = 'spaced'").select("master_id", "word").distinct()
    tries = run_of.select("master_id", "word", F.explode(F.array("word", F.expr("left(word, length(word) - 1)"), F.expr("left(word, length(word) - 2)"))).alias("meant"))
    known = tries.join(_counts(seen).where("n >= 3").select(F.col("word").alias("meant")), "meant").groupBy("master_id", "word").agg(F.max_by("meant", F.length("meant")).alias("meant"))
    wrong = wrong.unionByName(known.select("master_id", F.concat(F.lit(" "), "word").alias("word"), "meant"))
    rows = _once(masters)
    per = (
        rows.join(edge.groupBy("master_id").agg(F.collect_set("line_no").alias("edge")), "master_id", "left")
        .join(cuts.groupBy("master_id").agg(F.collect_set(F.struct("line_no", "rest_no", "own")).alias("cuts")), "master_id", "left")
        .join(wrong.groupBy("master_id").agg(F.collect_set(F.struct("word", "meant")).alias("fixes")), "master_id", "left")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [
                repaired(t, set(e) if e is not None else set(), {(x["line_no"], x["rest_no"]): x["own"] for x in (c if c is not None else [])}, {x["word"]: x["meant"] for x in (f if f is not None else [])})
                for t, e, c, f in zip(b["corpo"], b["edge"], b["cuts"], b["fixes"])
            ]
            yield pd.DataFrame({"master_id": b["master_id"], "texto": out})

    return per.select("master_id", "corpo", "edge", "cuts", "fixes").mapInPandas(run, "master_id long, texto string")


def repaired(text: str, edge: set[int], cuts: dict[tuple[int, int], bool], fixes: dict[str, str]) -> str:
    """One work put right; lines count from 1."""
    blocks: list[str] = []
    now = ""
    joins = {a: own for (a, _), own in cuts.items()}
    glue: bool | None = None  # None: a space; else the last word goes on, with its own hyphen or not

    def close() -> None:
        nonlocal now
        if now.strip():
            blocks.append(now.strip())
        now = ""

    for i, line in enumerate(text.split("\n"), 1):
        s = line.strip()
        if i in edge:
            continue
        if _ANCHOR.match(line):
            if now and not now.rstrip().endswith((".", "!", "?", ":")):
                now = now.rstrip() + (" " if glue is None else "") + s + (" " if glue is None else "")  # inside a sentence
            else:
                close()
                blocks.append(s)
            continue
        if not s:
            if glue is None and now.rstrip().endswith((".", "!", "?", ":")):
                close()
            continue
        if s.startswith("#") or _HEADWORD.match(s):
            close()
            blocks.append(s)
            glue = None
            continue
        own = joins.get(i)
        if own is not None and not own:
            s = s[:-1]
        now = now + s if glue is not None else (now.rstrip() + " " + s if now.strip() else s)
        glue = own
    close()

    def spaced(m: re.Match) -> str:
        letters = m.group().replace(" ", "")
        meant = fixes.get(" " + letters.lower(), letters)
        return " ".join([letters[: len(meant)], *letters[len(meant) :]])

    def fix(m: re.Match) -> str:
        w = m.group()
        right = fixes.get(w.lower())
        if right is None:
            return w
        return right.upper() if w.isupper() and len(w) > 1 else right[:1].upper() + right[1:] if w[:1].isupper() else right

    return "\n\n".join(x if _ANCHOR.match(x) else _TOKEN.sub(fix, _SPACED.sub(spaced, x)) for x in blocks)
