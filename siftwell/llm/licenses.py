"""License scans: Aho-Corasick finds identifier tags and notice phrases, and a
shunting-yard parser evaluates the and/or/with expressions that tags carry.

Words are runs of ASCII letters and digits and of non-ASCII characters, after A-Z is
lower-cased.  One automaton holds every notice phrase as consecutive words and the tag
words; it runs once over a text's words joined by single spaces, so a phrase's places
are the places where its words stand consecutively.

A tag (`SPDX-License-Identifier: MIT OR Apache-2.0 WITH LLVM-exception`, or
`License: ...`) is read from the raw text at the place that the automaton found, and its
expression is turned into postfix order.  A slash between identifiers counts as `or`.  `or` offers the freer side, `and` binds to the stricter one, `with` keeps its
left side and frees it somewhat; an identifier of no known family is its own label.

Of notice phrases that lie in one another the longest is what the text states (`lesser
general public license` is lgpl); base phrases always keep their labels.

score is how freely the licences found let the text be used: the least over all
statements of the freedom of each (1 permissive to 0.1 non-commercial), 0 where nothing
was found.

Defined results: null and empty texts have no words, no labels and score 0; a malformed
expression gives the labels of the identifiers that can be read, taken as joined by and.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .columns import append_columns, text_bytes

# Phrases and labels of the base contract.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Further notice phrases and their labels.
NOTICES = {
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "creative commons": "cc",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "all rights reserved": "proprietary",
}

# The label family of an identifier by its first letters, longest first.
FAMILIES = {
    "apache": "apache", "agpl": "agpl", "lgpl": "lgpl", "gpl": "gpl", "mit": "mit", "bsd": "bsd", "isc": "isc", "mpl": "mpl", "epl": "epl",
    "cc0": "cc0", "cc-by-nc": "cc-by-nc", "cc-by-nd": "cc-by-nd", "cc-by-sa": "cc-by-sa", "cc-by": "cc-by", "unlicense": "public-domain",
}

# How freely text under a label may be used.
FREEDOM = {
    "mit": 1.0, "bsd": 1.0, "isc": 1.0, "cc0": 1.0, "public-domain": 1.0, "apache": 0.9, "cc-by": 0.9, "mpl": 0.6, "epl": 0.6, "lgpl": 0.5,
    "cc-by-sa": 0.5, "gpl": 0.4, "cc": 0.4, "agpl": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.1, "proprietary": 0.1,
}
UNKNOWN_FREEDOM = 0.3

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Words that open a tag; they only lead to the raw text, where _HEAD decides.
_TAG_WORDS = ("spdx license identifier", "license", "licence")
_HEAD = re.compile(rb"(?i)(?:spdx-license-identifier|licen[sc]e)[ \t]*[:=][ \t]*[\"']?")
_WORD = re.compile(rb"[^ ]+")
#: A slash between identifiers offers both, as an `or`.
_TOKEN = re.compile(r"\(|\)|/|[A-Za-z0-9][A-Za-z0-9.+-]*")
#: A token, or what ends a tag's expression whatever comes before it.
_NEXT = re.compile(_TOKEN.pattern + r"|[\"'\n\r]")
_NEXT_BYTES = re.compile(_NEXT.pattern.encode())
_ORDER = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> str:
    """The label of a licence identifier; one of no known family is its own label."""
    name = identifier.lower().rstrip("+")
    return next((FAMILIES[k] for k in sorted(FAMILIES, key=len, reverse=True) if name == k or name.startswith((k + "-", k + "."))), name)


def postfix(expression: str) -> list[str] | None:
    """The expression in postfix order by shunting-yard, or None if it is malformed."""
    out: list[str] = []
    stack: list[str] = []
    operand = True  # whether one must come next
    for token in _TOKEN.findall(expression):
        low = "or" if token == "/" else token.lower()
        if token == "(":
            if not operand:
                return None
            stack.append(token)
        elif token == ")":
            if operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif low in _ORDER:
            if operand:
                return None
            while stack and stack[-1] != "(" and _ORDER[stack[-1]] >= _ORDER[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        else:
            if not operand:
                return None
            out.append(token)
            operand = False
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(expression: str) -> tuple[set[str], float]:
    """Labels that the expression names, and its freedom."""
    order = postfix(expression)
    if order is None:
        names = {family(t) for t in _TOKEN.findall(expression) if t not in "()/" and t.lower() not in _ORDER}
        return names, min((FREEDOM.get(x, UNKNOWN_FREEDOM) for x in names), default=0.0)
    stack: list[tuple[set[str], float]] = []
    for token in order:
        if token not in _ORDER:
            name = family(token)
            stack.append(({name}, FREEDOM.get(name, UNKNOWN_FREEDOM)))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            stack.append((left[0], min(1.0, left[1] + 0.1)))
        else:
            few, many = sorted((left[0], right[0]), key=len)
            many |= few  # in place, so that long expressions take no quadratic time
            stack.append((many, (max if token == "or" else min)(left[1], right[1])))
    return stack[0]


def is_operator(token: str) -> bool:
    return token == "/" or token.lower() in _ORDER


def tag_expressions(text: bytes, places: list[int]) -> list[str]:
    """What stands after the identifier tag at each place (bytes; where tag words begin), up to
    a word that can't go on an expression, a quote, the line's end or the next tag."""
    heads = [m for p in places if (m := _HEAD.match(text, p))]
    ends = [h.start() for h in heads[1:]] + [len(text)] * bool(heads)
    found = []
    for head, end in zip(heads, ends, strict=True):
        kept: list[str] = []
        for m in _NEXT_BYTES.finditer(text, head.end(), end):
            token = m[0].decode()
            if token in "\"'\n\r":
                break
            if token in "()" or is_operator(token) or not kept or kept[-1] == "(" or is_operator(kept[-1]):
                kept.append(token)
            else:
                break
        if kept:
            found.append(" ".join(kept).rstrip("."))
    return found


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for phrase, label in {**NOTICES, **BASE}.items():
        out.add_word(f" {phrase} ", (len(phrase) + 2, label, phrase in BASE))
    for phrase in _TAG_WORDS:
        out.add_word(f" {phrase} ", (len(phrase) + 2, "", False))
    out.make_automaton()
    return out


def longest(hits: list[tuple[int, int, str]]) -> set[str]:
    """Labels of the hits (start, end, label) that lie in no longer one."""
    out, reach = set(), -1
    for start, end, label in sorted(hits, key=lambda h: (h[0], -h[1])):
        if end > reach:
            out.add(label)
        reach = max(reach, end)
    return out


def scan(text: bytes, finder: ahocorasick.Automaton) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of one text."""
    plain = text.translate(_PLAIN)  # byte for byte, so that places are those of the text
    words = plain.split()
    joined = f" {b' '.join(words).decode('latin-1')} "
    starts, base, notices, tags = [], set(), [], []
    for end, (size, label, is_base) in finder.iter(joined):
        start = end + 1 - size
        if not label:
            tags.append(start)
            continue
        notices.append((start, end, label))
        if is_base:
            base.add(label)
            starts.append(start)
    stated = longest(notices)
    labels, freedom = base | stated, [FREEDOM[x] for x in stated]
    if tags:
        where = [m.start() for m in _WORD.finditer(plain)]  # the words' places in the text
        nth, at, places = 0, 0, []
        for t in sorted(tags):
            nth, at = nth + joined.count(" ", at, t), t
            places.append(where[nth])
        for expression in tag_expressions(text, places):
            names, free = evaluate(expression)
            if names:
                labels |= names
                freedom.append(free)
    at = [joined.count(" ", 0, p) for p in (min(starts), max(starts))] if starts else [None, None]
    return len(words), len(starts), *at, ",".join(sorted(base)), ",".join(sorted(labels)), min(freedom, default=0.0)


def scan_licenses(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` (default: all columns) with n_words, n_base, first_word, last_word,
    base_labels, labels and score."""

    def kernel():
        finder = automaton()
        return lambda column: list(zip(*[scan(t, finder) for t in text_bytes(column)], strict=True))

    kinds = {"n_words": T.LongType(), "n_base": T.LongType(), "first_word": T.LongType(), "last_word": T.LongType(), "base_labels": T.StringType(), "labels": T.StringType(), "score": T.DoubleType()}
    return append_columns(docs, text_col, T.StructType([T.StructField(k, v) for k, v in kinds.items()]), kernel, keep)
