"""Plain-Python string helpers shared by operators that compare typed text."""

from __future__ import annotations

import unicodedata
from functools import lru_cache


@lru_cache(maxsize=100_000)
def fold(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def within(a: str, b: str, most: int) -> bool:
    """Is the optimal-alignment distance of a and b at most ``most``?"""
    return osa(a, b, most) <= most


def osa(a: str, b: str, most: int = 1 << 30) -> int:
    """Optimal string alignment distance (adjacent swaps count one); more than ``most`` may come out as most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    old: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, old, row = old, row, [i]
        for j, y in enumerate(b, 1):
            d = min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return row[-1]
