"""Rows of text as search tools print them."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .search import Pattern

FORMATS = ("grep", "heading", "compact")
SEPARATOR = "--"
# The colours of paths, line numbers and matches.
RESET, PATH, NUMBER, MATCH = "\x1b[0m", "\x1b[1m\x1b[35m", "\x1b[32m", "\x1b[1;31m"


def resolve_format(named: str | None = None, heading: bool | None = None, env: Mapping[str, str] | None = None, terminal: bool = False, variable: str = "SIFTWELL_FORMAT") -> str:
    """A named format goes over heading on or off, that over the environment, that over
    what the output is."""
    if named is not None:
        if named not in FORMATS:
            raise ValueError(f"format {named!r} is none of {FORMATS}")
        return named
    if heading is not None:
        return "heading" if heading else "grep"
    asked = (os.environ if env is None else env).get(variable, "").strip().lower()
    if asked in FORMATS:
        return asked
    return "heading" if terminal else "grep"


def trimmed(line: Column) -> Column:
    """Without spaces and tabs in front."""
    return F.regexp_replace(line, r"\A[ \t]+", "")


def highlighted(line: Column, pattern: Pattern) -> Column:
    """The line with its matches coloured."""

    def colour(p, text: str) -> str:
        out, at = [], 0
        for a, b in p.spans(text):
            out += [text[at:a], MATCH, text[a:b], RESET]
            at = b
        return "".join(out) + text[at:]

    return pattern.split(line, F.regexp_replace(line, F.lit(f"({pattern.java})"), F.lit(f"{MATCH}$1{RESET}")), "string", colour)[0]


def render(found: DataFrame, form: str = "grep", trim: bool = False, pattern: Pattern | None = None, root: str = "") -> DataFrame:
    """path, line_number, part, output: ordered by these, the output is the text.

    found has path, line_number and line, and may have kind and chunk (context).  grep:
    `path:number:line`, with `-` for context; heading: the path once, then `number:line`;
    compact: as heading, with paths relative to `root`.  Where chunks are given, a row
    `--` stands between those of a file.  With a pattern, paths, numbers and matches are
    coloured.
    """
    context = (F.col("kind") == "context") if "kind" in found.columns else F.lit(False)
    paint = lambda c, colour: F.concat(F.lit(colour), c, F.lit(RESET)) if pattern is not None else c
    line = trimmed(F.col("line")) if trim else F.col("line")
    if pattern is not None:
        line = F.when(context, line).otherwise(highlighted(line, pattern))
    mark = F.when(context, "-").otherwise(":")
    path = F.col("path")
    if form == "compact" and root:
        path = F.when(path.startswith(root.rstrip("/") + "/"), path.substr(F.lit(len(root.rstrip("/")) + 2), F.length(path))).otherwise(path)
    body = F.concat(*([paint(path, PATH), mark] if form == "grep" else []), paint(F.col("line_number").cast("string"), NUMBER), mark, line)
    order = Window.partitionBy("path").orderBy("line_number")
    none, before = F.array().cast("array<string>"), []
    if form != "grep":
        before.append(F.when(F.row_number().over(order) == 1, F.array(paint(path, PATH))).otherwise(none))
    if "chunk" in found.columns:
        split = F.coalesce(F.lag("chunk").over(order) != F.col("chunk"), F.lit(False))
        before.append(F.when(split, F.array(F.lit(SEPARATOR))).otherwise(none))
    made = found.select("path", "line_number", F.concat(*before, F.array(body)).alias("parts"))  # windows can't stand in an explode
    rows = made.select("path", "line_number", F.posexplode("parts").alias("part", "output"))
    return rows.select("path", "line_number", F.col("part").cast("long").alias("part"), "output")


def summary(counts: DataFrame) -> DataFrame:
    """path:n rows of a count per file, ordered by path."""
    return counts.select("path", F.concat("path", F.lit(":"), F.col("n").cast("string")).alias("output")).orderBy("path")


def sorted_output(rendered: DataFrame) -> DataFrame:
    return rendered.orderBy("path", "line_number", "part").select("output")


def write_text(rendered: DataFrame, path: str) -> None:
    """The ordered output as text files."""
    sorted_output(rendered).write.text(path)


def format_number(n: int) -> str:
    return f"{n:,}"


def format_duration(ms: float) -> str:
    if ms < 1:
        return f"{ms * 1000:.0f}µs"
    return f"{ms:.1f}ms" if ms < 1000 else f"{ms / 1000:.2f}s"
