"""Searching lines: full scans and their modes.

A pattern is planned once, on the driver, into JVM predicates: `contains` where the
pattern is plain text, an OR of them for an alternation of texts, and otherwise a
required text (if there is one) before the regular expression.  All matching is by line.

The JVM's regular expressions backtrack, and enter repeated groups recursively: long texts
would take very long or exhaust a task's stack.  So patterns are graded by risk, and texts
above what is SAFE for a grade go to a matcher in linear time, in Arrow batches; others
stay null there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import regex_ast
from ..functions.arrays import let, running
from ..functions.linear import can_be_empty, program, risk
from ..functions.predicates import below, is_hidden, passes_globs, passes_types
from ..functions.translate import simplified, to_java
from ..functions.trigrams import required_literal, trigram_query
from ..sources.corpus import lines, shown


#: Characters up to which a text is matched in the JVM, by the pattern's risk; None: all.
SAFE = {0: None, 1: 16_384, 2: 512, 3: 0}


@dataclass(frozen=True)
class Pattern:
    """A pattern of the search dialect with its switches."""

    text: str
    fixed: bool = False
    ignore_case: bool = False
    unicode: bool = True
    multiline: bool = False

    @property
    def tree(self):
        if self.fixed:
            return regex_ast.Concat(tuple(regex_ast.Lit(c, self.ignore_case) for c in self.text))
        return regex_ast.parse(self.text, self.ignore_case, self.unicode)

    @property
    def folded(self) -> bool:
        return regex_ast.ignores_case(self.tree)

    @property
    def java(self) -> str:
        return to_java(self.tree)

    def trigrams(self) -> list[list[str]]:
        return trigram_query(self.tree, self.folded)

    def matches(self, line: Column) -> Column:
        tree = self.tree
        if (text := regex_ast.literal_text(tree)) is not None:
            return F.contains(line, F.lit(text))
        if (texts := regex_ast.literal_alternatives(tree)) is not None:
            out = F.contains(line, F.lit(texts[0]))
            for t in texts[1:]:
                out = out | F.contains(line, F.lit(t))
            return out
        in_jvm = line.rlike(to_java(tree))
        found, long = self.split(line, in_jvm, "boolean", lambda p, t: p.matches(t))
        if long is not None:  # stated first, so that what the JVM rules out isn't sent to Python
            found = (long | in_jvm) & found
        needed = None if self.folded else required_literal(tree)
        return F.contains(line, F.lit(needed)) & found if needed else found


    def split(self, text: Column, in_jvm: Column | None, kind: str, run: Callable, flags: str = "") -> tuple[Column, Column | None]:
        """in_jvm where the JVM matches the pattern safely, and run(program, text) elsewhere:
        (in_jvm, None) if that is nowhere, else both together and whether a text is for
        the program.  Without in_jvm all texts are; flags hold in the program."""
        tree = simplified(regex_ast.parse(f"(?{flags}){self.text}", self.ignore_case, self.unicode) if flags else self.tree)
        most = SAFE[3 if in_jvm is None else risk(tree)]
        if most is None:
            return in_jvm, None

        def compute(texts: pa.Array) -> pa.Array:
            p = program(tree)
            return pa.array([None if t is None else run(p, t) for t in texts.to_pylist()], arrow)

        arrow = {"boolean": pa.bool_(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}[kind]
        compute.__annotations__ = {"texts": pa.Array, "return": pa.Array}
        linear = F.arrow_udf(compute, kind)
        if not most:
            return linear(text), F.lit(True)
        long = F.length(text) > most
        return F.when(long, linear(F.when(long, text))).otherwise(in_jvm), long


@dataclass(frozen=True)
class PathFilter:
    """Which documents are searched, by their paths."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    hidden: bool = True
    subtree: str | None = None

    def apply(self, docs: DataFrame) -> DataFrame:
        path = F.col("path")
        if self.include or self.exclude:
            docs = docs.where(passes_globs(path, list(self.include), list(self.exclude)))
        if self.types:
            docs = docs.where(passes_types(F.col("ext"), list(self.types)))
        if not self.hidden:
            docs = docs.where(~is_hidden(path))
        if self.subtree:
            docs = docs.where(below(path, self.subtree))
        return docs


@dataclass(frozen=True)
class Search:
    """A search: the pattern, the documents, and whether non-matching lines are wanted."""

    pattern: Pattern
    paths: PathFilter = field(default_factory=PathFilter)
    invert: bool = False

    def keeps(self, line: Column) -> Column:
        found = self.pattern.matches(line)
        return ~found if self.invert else found

    def matching(self, docs: DataFrame) -> DataFrame:
        """doc_id, path, line_number, line (as it is) of the lines that are wanted.

        Before its lines are made, a document must hold a required text; with multiline,
        whole texts are matched and the lines in which a match starts are given.
        """
        docs = self.paths.apply(docs)
        if self.pattern.multiline:
            return match_starts(docs, self.pattern)
        tree = self.pattern.tree
        needed = None if self.invert or self.pattern.folded else regex_ast.literal_text(tree) or required_literal(tree)
        if needed:
            docs = docs.where(F.contains("text", F.lit(needed)))
        return lines(docs).where(self.keeps(F.col("line")))

    def run(self, docs: DataFrame) -> DataFrame:
        """doc_id, path, line_number, line (as shown)."""
        return display(self.matching(docs))


def display(found: DataFrame) -> DataFrame:
    return found.withColumn("line", shown(F.col("line")))


def match_starts(docs: DataFrame, pattern: Pattern) -> DataFrame:
    """Lines in which a match over the whole text begins, each once: texts are split at
    the matches, and line feeds are counted before each."""
    if can_be_empty(pattern.tree):
        raise regex_ast.PatternError("a multiline pattern must not match the empty text")
    java = "(?m)" + pattern.java
    whole = docs.where("text is not null").select("doc_id", "path", "text")
    if risk(simplified(pattern.tree)):
        starts = whole.select("*", pattern.split(F.col("text"), None, "array<int>", _start_lines, "m")[0].alias("starts"))
    else:
        feeds = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))
        gaps, hits = F.split("text", java, -1), F.regexp_extract_all("text", F.lit(java), F.lit(0))
        pairs = whole.where(F.col("text").rlike(java)).select("*", F.transform(gaps, feeds).alias("gaps"), F.transform(hits, feeds).alias("hits"))
        steps = pairs.select("doc_id", "path", "text", "gaps", F.zip_with(F.slice("gaps", F.lit(1), F.size("hits")), "hits", lambda g, h: g + h).alias("steps"))
        ends = steps.select("doc_id", "path", "text", "steps", "gaps", running(F.col("steps")).alias("ends"))  # feeds up to the end of each match
        before = F.zip_with(F.zip_with("ends", "steps", lambda e, s: e - s), F.slice("gaps", F.lit(1), F.size("steps")), lambda b, g: b + g + 1)
        starts = ends.select("doc_id", "path", "text", before.alias("starts"))
    of = lambda parts: F.transform(F.array_distinct("starts"), lambda n: F.struct(n.alias("n"), F.get(parts, n - 1).alias("line")))
    numbers = starts.where(F.size("starts") > 0).select("doc_id", "path", F.explode(let(F.split("text", "\n", -1), of)).alias("r"))
    return numbers.select("doc_id", "path", F.col("r.n").cast("long").alias("line_number"), "r.line")


def _start_lines(p, text: str) -> list[int]:
    out, at, line = [], 0, 1
    for start, _ in p.spans(text):
        line += text.count("\n", at, start)
        at = start
        out.append(line)
    return out


def only_matching(found: DataFrame, pattern: Pattern) -> DataFrame:
    """A row per match in the lines found: doc_id, path, line_number, nth, match.

    An empty match right at the end of the match before it doesn't count.
    """
    java = f"((?>{pattern.java}))"
    if can_be_empty(pattern.tree):
        java += r"(?!(?<=[\s\S])\G)"  # not empty where the last match ended
    hits = pattern.split(F.col("line"), F.regexp_extract_all("line", F.lit(java), F.lit(1)), "array<string>", lambda p, t: [t[a:b] for a, b in p.spans(t)])[0]
    out = found.select("doc_id", "path", "line_number", F.posexplode(hits).alias("at", "match"))
    return out.select("doc_id", "path", "line_number", (F.col("at") + 1).cast("long").alias("nth"), "match")


def count_per_file(found: DataFrame) -> DataFrame:
    return found.groupBy("path").agg(F.count("*").alias("n"))


def count_total(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("n"))


def files_with_matches(found: DataFrame) -> DataFrame:
    return found.select("path").distinct()


def exists(found: DataFrame) -> DataFrame:
    """One row: whether anything was found; the scan stops at the first line."""
    return found.limit(1).agg((F.count("*") > 0).alias("found"))


def count_occurrences(found: DataFrame, pattern: Pattern) -> DataFrame:
    """Matches (not lines) per path."""
    n = pattern.split(F.col("line"), F.regexp_count("line", F.lit(pattern.java)), "int", lambda p, t: len(p.spans(t)))[0]
    return found.select("path", n.alias("n")).groupBy("path").agg(F.sum("n").cast("long").alias("n"))
