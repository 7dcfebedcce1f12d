"""Encoding of the whole corpus with a public byte-pair tokenizer, by forced boundaries.

A merge joins two pieces only if their concatenation is a vocabulary token. So
where two adjacent bytes never stand side by side inside any token, no merge
can reach across, and the text may be cut there: the ids of the pieces, one
after the other, are the ids of the whole. The cuts of a whole Arrow batch are
found at once by a 256 x 256 table over its byte buffer. Cuts are kept only
where the tokenizer's own pre-splitting can't notice them either:

* at the start of a UTF-8 character,
* not after white space (its runs are split by what follows them),
* not before an apostrophe (it may open a contraction).

The pieces are then encoded one by one, each distinct piece once per worker;
most are single words. The result equals encoding the whole text for every
input (tested against the library on whole texts).
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabularium.sources.tables import balanced

DEFAULT_VOCABULARY = os.environ.get("TABULARIUM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the pre-splitting pattern of the byte-level vocabulary of 50,257 entries.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
CACHE_PIECES = 400_000  # distinct pieces a worker remembers before it starts afresh; memory only, never the result
BYTES_PER_CHUNK = 1 << 20  # bytes of text laid out at once; memory only, never the result


class ForcedBoundaryEncoder:
    """Encodes byte strings by cutting at certain boundaries; ``vocabulary`` is a tiktoken file of ranks."""

    def __init__(self, vocabulary: str = DEFAULT_VOCABULARY):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(vocabulary).read_bytes().splitlines() if line.strip())}
        self._bpe = tiktoken.Encoding("forced", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.forced = self._table(ranks)
        self._fresh()

    @staticmethod
    def _table(ranks: dict[bytes, int]) -> np.ndarray:
        """forced[a, b]: a text may be cut between bytes a and b without changing its ids."""
        joined = np.zeros((256, 256), dtype=bool)
        for token in ranks:
            t = np.frombuffer(token, dtype=np.uint8)
            joined[t[:-1], t[1:]] = True
        forced = ~joined
        forced[:, 0x80:0xC0] = False  # inside a character
        forced[:, 0x27] = False  # before an apostrophe
        for space in (*range(0x09, 0x0E), *range(0x1C, 0x21)):
            forced[space, :] = False
        # Unicode white space ends in a continuation byte: U+0085, A0, 1680, 2000-200A, 2028, 2029, 202F, 205F, 3000
        for last in {c.encode()[-1] for c in "\x85\xa0                　"}:
            forced[last, :] = False
        return forced

    def _fresh(self) -> None:
        self._known: dict[bytes, int] = {}
        self._ids: list[list[int]] = []

    def encode(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts that lie one after the other in ``raw``; text i is raw[bounds[i]:bounds[i + 1]].

        Returns (ids, offsets): those of text i are ids[offsets[i]:offsets[i + 1]].
        """
        n = len(bounds) - 1
        if not len(raw):
            return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
        cut = np.zeros(len(raw) + 1, dtype=bool)
        cut[1:-1] = self.forced[raw[:-1], raw[1:]]
        cut[bounds] = True
        at = np.flatnonzero(cut)
        data = raw.tobytes()
        marks = at.tolist()
        pieces = [data[a:b] for a, b in zip(marks, marks[1:])]
        if len(self._known) > CACHE_PIECES:
            self._fresh()
        known, ids = self._known, self._ids
        for piece in set(pieces).difference(known):
            known[piece] = len(ids)
            ids.append(self._bpe.encode_ordinary(piece.decode()))
        code = np.fromiter(map(known.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        used, code = np.unique(code, return_inverse=True)
        size = np.array([len(ids[u]) for u in used], dtype=np.int64)
        flat = np.array([x for u in used for x in ids[u]], dtype=np.int64)
        begin = np.concatenate(([0], np.cumsum(size)))[:-1]
        each = size[code]
        ends = np.cumsum(each)
        out = flat[np.repeat(begin[code] - (ends - each), each) + np.arange(ends[-1])]
        run = np.concatenate(([0], ends))
        return out, run[np.searchsorted(at, bounds)]


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> ForcedBoundaryEncoder:
    """One encoder a worker and vocabulary."""
    return ForcedBoundaryEncoder(vocabulary)


def _texts(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a string column with the bytes and bounds of their texts; a null text is an empty one."""
    n = len(col)
    if not n:
        return
    col = pc.fill_null(col.cast(pa.large_string()), "")
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64, count=n + 1 + col.offset)[col.offset :]
    body = col.buffers()[2]
    raw = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + BYTES_PER_CHUNK, side="right")) - 1)
        j = min(j, n)
        yield i, j, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def encode(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the ids of every text without special tokens; empty and null texts give an empty list.

    Every row gives one row, repeated and null keys too. Blank texts are encoded
    like any other. Strings of special tokens are ordinary text. Other columns
    aren't read.
    """
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for i, j, raw, bounds in _texts(batch.column(1)):
                ids, offs = enc.encode(raw, bounds)
                lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], names=[key, "ids"])

    return balanced(docs.select(key, F.col(text).cast("string").alias("t"))).mapInArrow(run, schema)


def count(docs: DataFrame, keep: tuple[str, ...], vocabulary: str = DEFAULT_VOCABULARY, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """The columns ``keep`` and the number of ids of each text, by the same encoding; ids don't leave the workers."""
    kept = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = T.StructType([*[kept.schema[c] for c in keep], T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            sizes = [np.diff(enc.encode(raw, bounds)[1]) for _, _, raw, bounds in _texts(batch.column(len(keep)))]
            total = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(total.astype(np.int64))], names=[*keep, name])

    return balanced(kept).mapInArrow(run, schema)


def facts(vocabulary: str = DEFAULT_VOCABULARY) -> str:
    """What the table of boundaries looks like, for reports."""
    t = encoder(vocabulary).forced
    return json.dumps({"pairs": int(t.size), "forced": int(t.sum()), "share": round(float(t.mean()), 4)})
