"""Simple case folding as one `translate` call, at least as coarse as the matcher's.

A character goes to its upper case and then to its lower case, each only where that is
one character.  The table is made from this rule.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold_char(c: str) -> str:
    up = c.upper()
    up = up if len(up) == 1 else c
    low = up.lower()
    return low if len(low) == 1 else up


@cache
def tables() -> tuple[str, str]:
    pairs = [(chr(k), fold_char(chr(k))) for k in (*range(0x20, 0xD800), *range(0xE000, 0x1F000))]
    changed = [(a, b) for a, b in pairs if a != b]
    return "".join(a for a, _ in changed), "".join(b for _, b in changed)


def fold_text(text: str) -> str:
    return "".join(map(fold_char, text))


def fold(column: Column) -> Column:
    return F.translate(column, *tables())
