"""Language of each note and of each paragraph in another language, with a confidence.

Hyperdimensional profiles: every letter has a random vector of +1 and -1. A
run of three letters (``RUNS``) is the product of their vectors, each rotated by
as many places as letters follow it, so that order matters. A text is the sum of its
runs; a language is the sum of its texts. Texts are compared with languages by
cosine, and the confidence is how far the best stands out: a softmax of the
cosines.

The prototypes are fitted on a bounded sample of labelled notes (``PER_LABEL``
notes a language, ``FIT_CHARS`` characters each). Labels are partly wrong, so
the sample is re-assigned by its own prototypes and bundled again a few times.
Everything else covers all notes and whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabularium.functions.fuzzy import fold
from tabularium.sources.tables import balanced

LANGUAGES = ("por", "eng", "deu", "fra", "ita", "spa")
PER_LABEL = 300
FIT_CHARS = 20_000
DIM = 1024
RUNS = (3,)  # lengths of the letter runs, 3 and 4 at most
LETTERS = 96
SEED = 7
SHARPNESS = 20.0
SURE = 0.1  # difference of the two best cosines from which a sample text counts as sure
RATE = 0.01  # share of a sentence moved between prototypes when it was missed
MARGIN = 0.03  # a sentence counts as missed under this difference of cosines
PORTION = 200_000  # characters laid out at once; memory only
BLOCK = 256  # texts bundled in one matrix product; memory only
# Ways to name each language, folded; a region after "-" or "_" is ignored.
NAMES = {
    "por": "por pt portugues portuguese portugiesisch portugais portoghese portugues-br brasileiro",
    "eng": "eng en ingles english englisch anglais inglese",
    "deu": "deu ger de alemao german deutsch allemand tedesco aleman",
    "fra": "fra fre fr frances french franzosisch francais francese",
    "ita": "ita it italiano italian italienisch italien",
    "spa": "spa es espanhol spanish spanisch espagnol spagnolo espanol castelhano castellano castilian esp",
}
_CODE = {name: code for code, names in NAMES.items() for name in names.split()}
_PARTS = re.compile(r"\n(?:[^\S\n]*\n)+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\s*[()]\s*")
_SKIP_LINE = re.compile(r"^\s*(?:#|\{\{[^}]*\}\}\s*$|<!--.*-->\s*$|---+\s*$|.*\[\[)")
_ANCHOR = re.compile(r"\{\{[^}]*\}\}|<!--.*?-->|https?://\S+")
MIN_WORDS = 3


def code_of(label: str | None) -> str | None:
    """The code a language label names; None for blank labels and such as name none of the six."""
    if label is None:
        return None
    name = fold(label.strip()).strip("[]\"' .")
    return _CODE.get(name) or _CODE.get(re.split(r"[-_ (]", name)[0])


def paragraphs(text: str) -> list[tuple[int, str]]:
    """(number, running text) of the paragraphs with any; what blank lines part, from 1, empty ones not counted."""
    out = []
    for k, part in enumerate((p for p in _PARTS.split(text.replace("\r\n", "\n")) if p.strip()), 1):
        lines = [x for x in part.split("\n") if not _SKIP_LINE.match(x)]
        body = _ANCHOR.sub(" ", " ".join(lines))
        if len(re.findall(r"[^\W\d_]{2,}", body)) >= MIN_WORDS:
            out.append((k, body))
    return out


def _letters() -> np.ndarray:
    """Letter number of each code point below 0x250: 0 for what is no letter; higher ones share numbers."""
    table = np.zeros(0x250, dtype=np.int64)
    seen = 0
    for cp in range(0x250):
        c = chr(cp)
        if c.isalpha() and c == c.lower():
            seen += 1
            table[cp] = 1 + (seen - 1) % (LETTERS - 1)
    return table


class Profiles:
    """Random letter vectors and the sums made of them."""

    def __init__(self, prototypes: np.ndarray | None = None):
        rng = np.random.default_rng(SEED)
        base = rng.choice(np.array([-1, 1], dtype=np.int8), size=(LETTERS, DIM))
        self.rolled = [np.roll(base, k, axis=1) for k in range(4)]
        self.table = _letters()
        self.prototypes = prototypes

    def vectors(self, texts: list[str]) -> np.ndarray:
        """One row per text: the sum of the vectors of its runs of letters."""
        joined = "  ".join(texts).lower() if all(len(t) == len(t.lower()) for t in texts) else None
        texts = texts if joined is not None else [t.lower() for t in texts]
        joined = joined if joined is not None else "  ".join(texts)
        cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])[: len(cps)]
        letter = np.where(cps < 0x250, self.table[np.minimum(cps, 0x24F)], 1 + cps % (LETTERS - 1))
        wide = cps >= 0x250
        if wide.any():  # punctuation above Latin is no letter
            letter[wide] = [1 + int(x) % (LETTERS - 1) if chr(x).isalpha() else 0 for x in cps[wide]]
        keep = np.ones(len(letter), bool)
        keep[1:] = (letter[1:] != 0) | (letter[:-1] != 0) | (owner[1:] != owner[:-1])
        letter, owner = letter[keep], owner[keep]
        runs, whose = [], []
        for n in RUNS:
            if len(letter) >= n:
                same = owner[n - 1 :] == owner[: len(owner) - n + 1]
                code = sum(letter[k : len(letter) - n + 1 + k] * LETTERS ** (n - 1 - k) for k in range(n)) + (LETTERS**4 if n == 4 else 0)
                runs.append(code[same])
                whose.append(owner[n - 1 :][same])
        if not runs:
            return np.zeros((len(texts), DIM), dtype=np.float32)
        run, who = np.concatenate(runs), np.concatenate(whose)
        order = np.argsort(who, kind="stable")
        codes, index = np.unique(run[order], return_inverse=True)
        return self._bundle(codes, index, who[order], len(texts))

    def _vector(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of coded runs: the product of the rotated vectors of their letters."""
        four = codes >= LETTERS**4
        c = codes - four * LETTERS**4
        out = self.rolled[0][c % LETTERS] * self.rolled[1][c // LETTERS % LETTERS] * self.rolled[2][c // LETTERS**2 % LETTERS]
        out[four] *= self.rolled[3][c[four] // LETTERS**3]
        return out

    def _bundle(self, codes: np.ndarray, index: np.ndarray, whose: np.ndarray, n: int) -> np.ndarray:
        """Counts of runs per text times the runs' vectors, a block of texts at a time."""
        out = np.zeros((n, DIM), dtype=np.float32)
        for first in range(0, n, BLOCK):
            a, b = np.searchsorted(whose, (first, first + BLOCK))
            if a == b:
                continue
            here, at = np.unique(index[a:b], return_inverse=True)
            rows = min(BLOCK, n - first)
            counts = np.bincount((whose[a:b] - first) * len(here) + at, minlength=rows * len(here)).reshape(rows, len(here)).astype(np.float32)
            for s in range(0, len(here), 4096):  # a bound on the vectors laid out at once
                out[first : first + rows] += counts[:, s : s + 4096] @ self._vector(codes[here[s : s + 4096]]).astype(np.float32)
        return out

    def bundle(self, texts: list[str]) -> np.ndarray:
        """``vectors`` in portions of some ``PORTION`` characters, so that memory doesn't grow with the batch.

        A longer text is taken in parts that overlap by two letters, and the
        parts' vectors are added: no run of letters is lost.
        """
        out = np.zeros((len(texts), DIM), dtype=np.float32)
        parts: list[str] = []
        owner: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if parts:
                np.add.at(out, owner, self.vectors(parts))
            parts.clear(), owner.clear()
            size = 0

        for i, t in enumerate(texts):
            for a in range(0, max(1, len(t)), PORTION):
                part = t[max(0, a - 2) : a + PORTION]
                parts.append(part)
                owner.append(i)
                size += len(part)
                if size >= PORTION:
                    flush()
        flush()
        return out

    def compare(self, texts: list[str]) -> np.ndarray:
        """Cosine of each text with each prototype."""
        got = [np.zeros((0, len(self.prototypes)), dtype=np.float32)]
        for a in range(0, len(texts), 4096):
            v = self.bundle(texts[a : a + 4096])
            got.append((v @ self.prototypes.T) / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9))
        return np.concatenate(got)


def train(texts: list[str], labels: list[int], rounds: int = 6, passes: int = 30) -> np.ndarray:
    """Prototypes (languages x DIM, unit length) from partly wrong labels.

    ``rounds`` of assigning and bundling anew wash wrong labels out. Then the
    single sentences of texts that were clear take their text's language, and
    those missed are added to the right prototype and taken off the wrong one,
    ``passes`` times at most: short texts are where plain sums err.
    """
    prof = Profiles()
    v = _unit(prof.bundle(texts))
    now = np.array(labels)
    proto = np.zeros((len(LANGUAGES), DIM), dtype=np.float32)
    for _ in range(rounds):
        for k in range(len(LANGUAGES)):
            if (now == k).any():
                proto[k] = v[now == k].mean(axis=0)
        proto = _unit(proto - proto.mean(axis=0))  # what all languages share tells nothing
        then, now = now, (v @ proto.T).argmax(axis=1)
        if (then == now).all():
            break
    two = np.sort(v @ proto.T, axis=1)[:, -2:]
    known: dict[str, int] = {}
    for i in np.flatnonzero(two[:, 1] - two[:, 0] >= SURE):
        for x in _SENTENCE.split(texts[i]):
            if len(x.split()) >= MIN_WORDS:
                known.setdefault(x, int(now[i]))
    if not known:
        return proto
    right = np.fromiter(known.values(), dtype=np.int64)
    w = _unit(prof.bundle(list(known)))
    for _ in range(passes):
        cos = w @ proto.T
        own = cos[np.arange(len(w)), right]
        cos[np.arange(len(w)), right] = -1
        got = cos.argmax(axis=1)
        bad = np.flatnonzero(own - cos.max(axis=1) < MARGIN)
        if not len(bad):
            break
        np.add.at(proto, right[bad], RATE * w[bad])
        np.add.at(proto, got[bad], -RATE * w[bad])
        proto = _unit(proto)
    return proto


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fit(notes: DataFrame, per_label: int = PER_LABEL, chars: int = FIT_CHARS) -> np.ndarray:
    """Prototypes from a bounded sample: the ``per_label`` notes of each named language that come first by a hash of their id."""
    labels = notes.where("idioma is not null and note_id is not null and corpo is not null and trim(corpo) != ''").groupBy("idioma", "note_id").agg(F.lit(1).alias("one"))
    named = F.pandas_udf(lambda s: s.map(code_of), "string")
    forms = labels.select("idioma").distinct().withColumn("code", named("idioma")).where("code is not null")
    first = Window.partitionBy("code").orderBy(F.xxhash64("note_id"), "note_id")
    # chosen by id and label alone; texts are read for the chosen notes only
    chosen = labels.join(forms, "idioma").withColumn("r", F.row_number().over(first)).where(f"r <= {int(per_label)}").select("note_id", "code")
    sample = notes.select("note_id", F.substring("corpo", 1, chars).alias("t")).join(F.broadcast(chosen), "note_id").distinct().toPandas()
    texts, labels = [], []
    for code, t in sorted(zip(sample["code"], sample["t"])):
        for _, body in paragraphs(t):
            texts.append(body)
            labels.append(LANGUAGES.index(code))
    return train(texts, labels) if texts else np.zeros((len(LANGUAGES), DIM), dtype=np.float32)


def detect(notes: DataFrame, prototypes: np.ndarray | None = None) -> DataFrame:
    """(note_id, paragrafo, idioma, confianca, main, named): the language of each paragraph of running text.

    paragrafo 0 is the note: the language most of its paragraphs are in (ties:
    more letters, then the order of the codes), confidence the share of its
    paragraphs weighted by theirs. ``main`` is that language, ``named`` the code
    the label names, null if none. Notes with a null or blank body, or without
    running text, give no row; null note ids are left out; repeated notes give
    repeated rows.
    """
    proto = fit(notes) if prototypes is None else prototypes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prof = Profiles(proto)
        for b in batches:
            owner, number, texts = [], [], []
            ids, named = b["note_id"].tolist(), [code_of(x) if isinstance(x, str) else None for x in b["idioma"]]
            for i, t in enumerate(b["corpo"]):
                for k, body in paragraphs(t):
                    owner.append(i)
                    number.append(k)
                    texts.append(body)
            rows = []
            if texts:
                cos = prof.compare(texts)
                e = np.exp(SHARPNESS * (cos - cos.max(axis=1, keepdims=True)))
                conf = e.max(axis=1) / e.sum(axis=1)
                best = cos.argmax(axis=1)
                who = np.array(owner)
                size = np.array([len(t) for t in texts])
                for i in np.unique(who):
                    at = np.flatnonzero(who == i) if len(texts) < 512 else np.arange(np.searchsorted(who, i), np.searchsorted(who, i, "right"))
                    votes = [((best[at] == k).sum(), size[at][best[at] == k].sum(), -k) for k in range(len(LANGUAGES))]
                    main = -max(votes)[2]
                    share = float(conf[at][best[at] == main].sum() / len(at))
                    rows.append((ids[i], 0, LANGUAGES[main], share, LANGUAGES[main], named[i]))
                    rows += [(ids[i], number[j], LANGUAGES[best[j]], float(conf[j]), LANGUAGES[main], named[i]) for j in at]
            yield pd.DataFrame(rows, columns=["note_id", "paragrafo", "idioma", "confianca", "main", "named"])

    rows = balanced(notes.select("note_id", "idioma", "corpo").where("note_id is not null and corpo is not null and trim(corpo) != ''"))
    return rows.mapInPandas(run, "note_id long, paragrafo long, idioma string, confianca double, main string, named string")


def found(notes: DataFrame, prototypes: np.ndarray | None = None) -> DataFrame:
    """p6_found: notes whose label is absent or wrong, and paragraphs in another language than most."""
    rows = detect(notes, prototypes)
    return rows.where("(paragrafo = 0 and (named is null or named != idioma)) or (paragrafo > 0 and idioma != main)").select("note_id", "paragrafo", "idioma").distinct()
