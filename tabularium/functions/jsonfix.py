"""JSON answers written by hand or machine: found in surrounding text, and mended where quotes or breaks are loose.

Whether a text is JSON is for the JVM to say (``try_parse_json``); only texts
that aren't go to Python, where one pattern finds the strings. A string ends at
the first quote behind which the JSON can go on: after a value of an object
another name with a colon, after an item of a list another value, or brackets
that close. Quotes before that are part of the text.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_CLOSE = r"[}\]]\s*(?:[,}\]]|$)"
_STRING = re.compile(
    r'([{,]\s*)"([^"\n]*)"(?=\s*:)'  # a name: no loose quotes in it
    rf'|(:\s*)"((?:\\.|[^\\])*?)"(?=\s*(?:{_CLOSE}|,\s*"[^"\n]*"\s*:|$))'
    rf'|([\[,]\s*)"((?:\\.|[^\\])*?)"(?=\s*(?:{_CLOSE}|,\s*(?:["\[{{\d-]|true\b|false\b|null\b)|$))',
    re.S,
)
_LOOSE = re.compile(r'\\.|["\n\r\t]', re.S)
_SIGNS = {'"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def mend(text: str) -> str:
    """``text`` with the quotes and line breaks inside its strings escaped."""

    def string(m: re.Match) -> str:
        before, body = next((m[i], m[i + 1]) for i in (1, 3, 5) if m[i] is not None)
        return f'{before}"{_LOOSE.sub(lambda x: _SIGNS.get(x[0], x[0]), body)}"'

    return _STRING.sub(string, text)


def _plain(c: Column) -> Column:
    """An object or list as plain JSON; null for other texts."""
    return F.when(c.rlike(r"^\s*[\[{]"), F.to_json(F.try_parse_json(c)))


def recover_json(c: Column) -> Column:
    """The JSON object or list in a text, as plain JSON with sorted names; null where there is none.

    Tried in this order: the whole text, the text without code fences, and from
    the first brace to the last; then the same mended. Null texts give null.
    """
    bare = F.regexp_replace(c, r"^\s*```\w*\s*|\s*```\s*$", "")
    braces = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    plain = F.coalesce(_plain(c), _plain(bare), _plain(braces))
    mended = F.pandas_udf(lambda s: s.map(mend, na_action="ignore"), "string")
    spoilt = lambda x: mended(F.when(plain.isNull(), x))
    return F.coalesce(plain, _plain(spoilt(c)), _plain(spoilt(bare)), _plain(spoilt(braces)))
