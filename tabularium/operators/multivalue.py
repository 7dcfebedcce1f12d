"""Several values packed in one field: split into one row per value, position kept.

The scan works on the bytes of a whole Arrow batch at once: quote parity by a
running count, delimiter masks by a lookup table, child offsets from the set
bits of the mask; the values become a list array, which is flattened with the
ordinals of its parents.

A comma or the word ``e`` is a *weak* delimiter: it parts values or belongs to
one, as the words around it tell. That too is decided for all rows at once:

* between words that are joined in one value elsewhere (``windows``: entries of
  a reference list, and items in quotes, which are one value by their quotes)
  it parts nothing;
* a comma in a field of names parts where what stands before it is a whole
  name. As a comma behind an inverted name always follows one that doesn't
  part, the commas behind incomplete parts alternate: not, yes, not, ...
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabularium.functions.fuzzy import fold, within

STRONG = b";|/&+\n"
NAMES = ("autoria",)  # fields whose values are names that hold commas
SEEN = 2  # quoted items that must join two words before they count as joined
MOST_WINDOWS = 200_000  # joined pairs of words that are sent to all workers; more than that is an error, not a guess
# Words that open the name of a body, folded.
BODY_WORDS = (
    "academia", "associacao", "camara", "centro", "comissao", "comite", "conselho", "escola", "faculdade", "fundacao",
    "instituto", "ministerio", "nucleo", "ordem", "secretaria", "sociedade", "tribunal", "universidade", "ctr", "inst",
    "fund", "sec", "acad", "cons", "republica", "estado",
)
# What may end an inverted name in capitals without ending it.
OPEN_ENDS = ("junior", "neto", "filho", "sobrinho", "de", "da", "do", "dos", "das")
# Words that join the last of several values, in the six languages.
JOINERS = "e|and|und|et|y|ed"
_E_BYTES = re.compile(rf"(?<=\S)[ \t]+(?:{JOINERS})[ \t]+(?=\S)".encode())
_SINGLE = re.compile(rb"(?:(?<=\x00)|(?<=[\[,;|/]))\s*('(?:[^'\n\x00]|'(?!\s*[\],;|/\x00]))*')(?=\s*[\],;|/\x00])")
_WINDOW_END = np.zeros(256, bool)
_WINDOW_END[list(b" \t\r,;|/&+\n\"'[]()")] = True
Window = tuple[str, str, str]  # word, "e" or ",", word; folded


def windows_of(text: str) -> list[Window]:
    """The pairs of words in one value that a weak delimiter joins."""
    out = [(m[1], "e", m[2]) for m in re.finditer(rf"(?i)([^\W]+)\.?\s+(?:{JOINERS})\s+(?=([^\W]+))", text)]
    out += [(m[1], ",", m[2]) for m in re.finditer(r"([^\W]+)\.?\s*,\s*(?=([^\W]+))", text)]
    return [(fold(a), d, fold(b)) for a, d, b in out]


def listed_windows(vocabulary: DataFrame | None, fields: Iterable[str]) -> dict[str, set[Window]]:
    """Per field, the pairs of words that entries of vocabulary(campo, canonico) join."""
    found: dict[str, set[Window]] = {f: set() for f in fields}
    if vocabulary is not None:
        joined = vocabulary.where(F.col("campo").isin(list(found)) & F.col("canonico").rlike(rf"(?i),|\s(?:{JOINERS})\s")).select("campo", "canonico").limit(MOST_WINDOWS + 1).collect()
        if len(joined) > MOST_WINDOWS:
            raise ValueError(f"more than {MOST_WINDOWS} entries that join words")
        for r in joined:
            found[r["campo"]].update(windows_of(r["canonico"]))
    return found


def learned_windows(df: DataFrame, fields: Iterable[str]) -> dict[str, set[Window]]:
    """Per field, the pairs of words that ``SEEN`` or more items in double quotes join.

    Such an item is one value. Commas of names are no evidence.
    """
    word, gap = r"[\p{L}\p{N}_]+", rf"(?:\.?\s+(?i:{JOINERS})\s+|\.?\s*,\s*)"
    found: dict[str, set[Window]] = {}
    for f in fields:
        v = F.col(f).cast("string")
        items = df.where(F.contains(v, F.lit('"')) & (F.regexp_count(v, F.lit('"')) % 2 == 0)).select(F.explode(F.regexp_extract_all(v, F.lit('"([^"]*)"'), F.lit(1))).alias("item"))
        # a window may begin with the word that ends the one before: taken by look-ahead
        seen = items.select(F.explode(F.regexp_extract_all(F.lower("item"), F.lit(rf"(?=((?<![\p{{L}}\p{{N}}_]){word}{gap}{word}))."), F.lit(1))).alias("w"))
        seen = seen.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {SEEN}").select("w").limit(MOST_WINDOWS + 1).collect()
        if len(seen) > MOST_WINDOWS:
            raise ValueError(f"more than {MOST_WINDOWS} joined pairs of words in {f}")
        found[f] = {x for r in seen for x in windows_of(r["w"]) if x[1] == "e" or f not in NAMES}
    return found


class _Joined:
    """Which pairs of words are joined, give or take errors in one of them; in both, for those of a reference list."""

    def __init__(self, windows: set[Window], listed: set[Window] = frozenset()):
        self.windows, self.listed = windows | listed, listed
        windows = self.windows
        self.right: dict[tuple[str, str], list[str]] = {}
        self.left: dict[tuple[str, str], list[str]] = {}
        for a, d, b in windows:
            self.right.setdefault((a, d), []).append(b)
            self.left.setdefault((d, b), []).append(a)

    def holds(self, a: str, d: str, b: str) -> bool:
        near = lambda x, ys: any(len(y) > 3 and within(x, y, max(1, min(3, len(y) // 4))) for y in ys)
        far = lambda x, y: within(x, y, max(1, min(3, (len(y) + 1) // 3)))
        return (a, d, b) in self.windows or near(b, self.right.get((a, d), ())) or near(a, self.left.get((d, b), ())) or any(d == e and far(a, x) and far(b, y) for x, e, y in self.listed)


def _strings(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.LargeStringArray:
    """The texts between the given bytes, as one array."""
    size = np.maximum(ends - starts, 0)
    offs = np.concatenate(([0], np.cumsum(size)))
    at = np.repeat(starts - offs[:-1], size) + np.arange(offs[-1])
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(raw[at].tobytes()))


def _folded(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.utf8_normalize(pc.utf8_lower(texts), form="NFKD"), r"\p{Mn}", "")


def _complete(parts: pa.Array) -> np.ndarray:
    """Is each part, the text between two delimiters, a whole name rather than a family name?"""
    bare = pc.utf8_trim(parts, " \t[]\"'")
    words = pc.utf8_split_whitespace(bare)
    n = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, offs = words.flatten(), words.offsets.to_numpy()
    has = n > 0
    first = flat.take(pa.array(offs[:-1][has]))
    last = flat.take(pa.array(offs[1:][has] - 1))
    full = lambda x: x.to_numpy(zero_copy_only=False).astype(bool)
    capitals = full(pc.equal(pc.utf8_upper(bare), bare))
    body, ends, head = np.zeros(len(n), bool), np.zeros(len(n), bool), np.zeros(len(n), bool)
    body[has] = full(pc.is_in(pc.utf8_trim(_folded(first), "."), pa.array(BODY_WORDS, first.type)))
    ends[has] = full(pc.is_in(pc.utf8_trim(_folded(last), "."), pa.array(OPEN_ENDS, last.type)))
    head[has] = full(pc.utf8_is_upper(first)) & (pc.utf8_length(first).to_numpy(zero_copy_only=False) > 2)
    return has & (body | np.where(capitals, (n >= 3) & ~ends, (n >= 2) & ~head))


def split_batch(col: pa.Array, field: str, windows: set[Window] | _Joined = frozenset()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Child spans of all rows of a batch: (parent row, start, end) in bytes, and the bytes."""
    joined = windows if isinstance(windows, _Joined) else _Joined(windows)
    col = pa.concat_arrays([col]).cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    n = len(col)
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64, count=n + 1 + col.offset)[col.offset :]
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[: offs[-1]] if data is not None and offs[-1] else np.zeros(0, np.uint8)
    raw, offs = raw[int(offs[0]) :], offs - int(offs[0])
    size = len(raw)
    row_of = np.repeat(np.arange(n), np.diff(offs))
    if not size:
        return np.arange(n), offs[:-1], offs[1:], raw
    any_of = lambda mask: np.bincount(row_of[mask], minlength=n) > 0

    # Quote parity, each row from zero; rows with an odd count are taken as unquoted.
    run = np.concatenate(([0], np.cumsum(raw == 0x22)))
    odd = (run[offs[1:]] - run[offs[:-1]]) % 2 == 1
    inside = ((run[:-1] - run[offs[:-1]][row_of]) % 2 == 1) & ~odd[row_of]
    # Single quotes that wrap an item of a list: one pattern over all rows that hold any, parted by zeros.
    some = np.flatnonzero(any_of(raw == 0x27))
    if len(some):
        texts = [raw[offs[r] : offs[r + 1]].tobytes() for r in some.tolist()]
        first = np.cumsum([1] + [len(t) + 1 for t in texts[:-1]])
        for m in _SINGLE.finditer(b"\x00" + b"\x00".join(texts) + b"\x00"):
            k = int(np.searchsorted(first, m.start(1), "right")) - 1
            at = int(offs[some[k]] - first[k])
            inside[m.start(1) + at : m.end(1) + at] = True

    table = np.zeros(256, bool)
    table[list(STRONG)] = True
    strong = table[raw] & ~inside
    solid = ~np.isin(raw, np.frombuffer(b" \t\r\n\x0b\x0c", np.uint8))
    at = np.arange(size)
    lead, tail = np.full(n, size), np.full(n, -1)  # first and last byte of each row that isn't white space
    np.minimum.at(lead, row_of[solid], at[solid])
    np.maximum.at(tail, row_of[solid], at[solid])
    lines = any_of((raw == 0x0A) & (at > lead[row_of]) & (at < tail[row_of]))
    listed = lines | ((lead < size) & (raw[np.minimum(lead, size - 1)] == 0x5B))

    # Weak delimiters: start, end, and whether they part.
    es = np.array([m.span() for m in _E_BYTES.finditer(raw.tobytes())], dtype=np.int64).reshape(-1, 2)
    es = es[(row_of[es[:, 0] - 1] == row_of[es[:, 1]]) & ~inside[es[:, 0] + 1] & ~listed[row_of[es[:, 0]]]] if len(es) else es
    commas = np.flatnonzero((raw == 0x2C) & ~inside)
    before = np.maximum.accumulate(np.where(solid, at, -1))  # nearest solid byte at or before
    after = np.minimum.accumulate(np.where(solid, at, size)[::-1])[::-1]
    start = np.concatenate((es[:, 0], commas))
    end = np.concatenate((es[:, 1], commas + 1))
    is_comma = np.concatenate((np.zeros(len(es), bool), np.ones(len(commas), bool)))
    order = np.argsort(start, kind="stable")
    start, end, is_comma = start[order], end[order], is_comma[order]
    row = row_of[start]
    prev = np.where(start > 0, before[np.maximum(start - 1, 0)], -1)
    nxt = np.where(end < size, after[np.minimum(end, size - 1)], size)
    has_prev, has_next = prev >= offs[:-1][row], nxt < offs[1:][row]
    sign = lambda i, ok: np.where(ok, raw[np.clip(i, 0, size - 1)], 0)
    left_sign, right_sign = sign(prev, has_prev), sign(nxt, has_next)

    parts = np.ones(len(start), bool)
    if joined.windows and len(start):
        ends_at = np.maximum.accumulate(np.where(_WINDOW_END[raw], at, -1))
        begins_at = np.minimum.accumulate(np.where(_WINDOW_END[raw], at, size)[::-1])[::-1]
        left = np.maximum(np.where(has_prev, ends_at[np.maximum(prev, 0)] + 1, start), offs[:-1][row])
        right = np.minimum(np.where(has_next, begins_at[np.minimum(nxt, size - 1)], end), offs[1:][row])
        plain = lambda x: pc.utf8_trim(_folded(x), ".")
        key = pc.binary_join_element_wise(plain(_strings(raw, np.minimum(left, prev + 1), prev + 1)), pa.array(np.where(is_comma, ",", "e"), pa.large_string()), plain(_strings(raw, nxt, np.maximum(right, nxt))), pa.scalar("\x00", pa.large_string()))
        code = key.dictionary_encode()  # every pair of words is looked up once
        held = np.array([joined.holds(*k.split("\x00")) for k in code.dictionary.to_pylist()], dtype=bool)
        parts = ~held[code.indices.to_numpy()]
    if field in NAMES:
        quoted = np.isin(left_sign, (0x22, 0x27)) | np.isin(right_sign, (0x22, 0x27))
        alone = ~any_of(strong)[row]
        forced = parts & (~is_comma | quoted)  # these part whatever stands before them
        seg_from = np.concatenate(([0], end[:-1])) if len(end) else end
        seg_from = np.where(np.concatenate(([True], row[1:] != row[:-1])) if len(row) else np.zeros(0, bool), offs[:-1][row], seg_from)
        one = forced.copy()
        look = np.flatnonzero(is_comma & ~quoted & alone)
        if len(look):
            one[look] = _complete(_strings(raw, seg_from[look], start[look]))
        # x[i] = one[i], or else not x[i - 1]: the place in a run of zeros decides; rows begin afresh
        k = np.arange(len(one))
        fresh = np.concatenate(([True], row[1:] != row[:-1])) if len(one) else np.zeros(0, bool)
        anchor = np.maximum.accumulate(np.maximum(np.where(one, k, -1), np.where(fresh, k - 1, -1))) if len(one) else k
        flow = one | ((k - anchor) % 2 == 0)
        parts = np.where(is_comma, (quoted | (alone & flow)) & has_prev & parts, parts)
    else:
        parts &= ~(is_comma & lines[row])
    parts &= ~(is_comma & (right_sign == 0x2E))  # an abbreviated phrase that holds a comma

    hard = np.flatnonzero(strong)
    marks = np.concatenate((hard, start[parts]))
    width = np.concatenate((np.ones(len(hard), np.int64), (end - start)[parts]))
    order = np.argsort(marks, kind="stable")
    marks, width = marks[order], width[order]
    starts = np.concatenate((offs[:-1], marks + width))
    ends = np.concatenate((marks, offs[1:]))
    begun, ended = np.concatenate((np.arange(n), row_of[marks])), np.concatenate((row_of[marks], np.arange(n)))
    i, j = np.lexsort((starts, begun)), np.lexsort((ends, ended))
    return begun[i], starts[i], ends[j], raw


_LEAD = re.compile(r"^(?:\s|\[|-\s|-$|\*\s)+")


def clean_value(text: str) -> str:
    """One value without list marks, quotes and white space around it; doubled inner quotes made single."""
    while True:
        was = text
        text = text.strip().strip("﻿ ")
        text = _LEAD.sub("", text)
        if text.endswith("]") and "[" not in text:
            text = text[:-1].rstrip()
        if len(text) >= 2 and text[0] == text[-1] and text[0] in "\"'" and _wraps(text):
            text = text[1:-1]
        elif text[:1] in ('"', "'") and text.count(text[0]) == 1:
            text = text[1:]
        elif text[-1:] == '"' and text.count('"') == 1:
            text = text[:-1]
        if text == was:
            return text.replace('""', '"').replace('\\"', '"')


def _wraps(text: str) -> bool:
    """Do the first and last quotes belong together (not ``"a" b "c"``)?"""
    inner = text[1:-1]
    q = text[0]
    if q == "'":
        return True
    return inner.replace('""', "").count(q) % 2 == 0 and not re.match(r'^[^"]*"\s+[^"]*\s"[^"]*$', inner)


# Texts of a field that stand for no value.
BLANK = ("", "null", "[]", "~")


def lists(col: pa.Array, field: str, windows: set[Window] | _Joined = frozenset()) -> pa.LargeListArray:
    """The values of every row of a batch, cleaned, as one list array; blank ones are left out."""
    parent, start, end, raw = split_batch(col, field, windows)
    values = pc.utf8_trim_whitespace(_strings(raw, start, end))
    # marks and quotes are few: their values are cleaned one by one, each different one once
    marked = np.flatnonzero(pc.match_substring_regex(values, "[\\[\\]\"'\ufeff\\\\]|^[-*]").to_numpy(zero_copy_only=False))
    if len(marked):
        code = values.take(pa.array(marked)).dictionary_encode()
        cleaned = pa.array([clean_value(x) for x in code.dictionary.to_pylist()], pa.large_string()).take(code.indices)
        mask = np.zeros(len(values), bool)
        mask[marked] = True
        values = pc.replace_with_mask(values, pa.array(mask), cleaned)
    keep = ~pc.is_in(values, pa.array(BLANK, pa.large_string())).to_numpy(zero_copy_only=False)
    count = np.bincount(parent[keep], minlength=len(col))
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int64()), values.filter(pa.array(keep)))


def split_values(df: DataFrame, fields: Iterable[str], key: str = "note_id", windows: dict[str, set[Window]] | None = None, vocabulary: DataFrame | None = None) -> DataFrame:
    """One row per value of each of ``fields``: (key, campo, pos, valor, n).

    ``pos`` counts the non-empty values of a field from 1, ``n`` is their number.
    Null, empty and blank fields, ``null`` and ``[]`` give no row; a field of one
    value gives one row with n = 1. Repeated input rows give repeated output rows.
    Delimiters inside quotes never part values. Other columns of ``df`` are not
    read. ``windows``, as ``learned_windows`` gives them, are pairs of words that
    weak delimiters join; if none are given they are learned from the rows.
    Those of the entries of vocabulary(campo, canonico) are joined too.
    """
    fields = list(fields)
    found, listed = learned_windows(df, fields) if windows is None else windows, listed_windows(vocabulary, fields)
    joined = {f: _Joined(found.get(f, set()), listed[f]) for f in fields}
    packed = df.select(
        F.col(key).alias("k"), F.explode(F.array(*[F.struct(F.lit(f).alias("campo"), F.col(f).cast("string").alias("v")) for f in fields])).alias("f")
    ).select("k", "f.campo", "f.v")
    packed = packed.where(F.col("v").isNotNull() & (F.trim("v") != ""))
    kind = df.schema[key].dataType
    out = T.StructType([T.StructField("k", kind), T.StructField("campo", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("valor", T.StringType()), T.StructField("n", T.LongType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            campo = batch.column(batch.schema.get_field_index("campo"))
            for field in fields:
                part = batch.filter(pc.equal(campo, field))
                if not len(part):
                    continue
                values = lists(part.column(2), field, joined[field])
                parent = pc.list_parent_indices(values)
                begin = values.offsets.to_numpy()
                pos = np.arange(len(parent)) - begin[:-1][parent.to_numpy()] + 1
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(parent), pa.array([field] * len(parent), pa.string()), pa.array(pos, pa.int64()), values.flatten().cast(pa.string()), pa.array(np.diff(begin)[parent.to_numpy()], pa.int64())],
                    names=["k", "campo", "pos", "valor", "n"],
                )

    return packed.mapInArrow(scan, out).withColumnRenamed("k", key)


def found(notes: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """p7_found: the values of ``area`` and ``autoria`` fields that hold two or more.

    Notes delivered more than once count once: equal rows collapse before the
    scan, so that the costly step sees each text of a note once.
    """
    once = notes.select("note_id", "area", "autoria").distinct()
    rows = split_values(once, ("area", "autoria"), vocabulary=vocabulary).where("n >= 2 and note_id is not null")
    return rows.select("note_id", "campo", "pos", "valor").distinct()
