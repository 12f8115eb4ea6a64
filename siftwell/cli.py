"""Command line: search, index, update, stats, compact, watch.

    python -m siftwell PATTERN [PATH] [flags]
    python -m siftwell --do index PATH --index DIR [-i]

Results go to standard output. Exit codes: 0; 1 on an error, or with -q if nothing was
found; 2 without a pattern.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .operators import search as ops
from .operators.context import resolve, with_context
from .operators.render import FORMATS, format_number, render, resolve_format, sorted_output, summary
from .operators.search import PathFilter, Pattern, Search
from .plans import index as ix
from .plans import indexed, maintain
from .sources.corpus import from_directory, listing, read_files
from .streaming.watch import watch

ACTIONS = ("search", "index", "update", "stats", "compact", "watch")


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siftwell", description=__doc__.splitlines()[0])
    p.add_argument("words", nargs="*", metavar="PATTERN PATH", help="the pattern (only for search) and the folder")
    p.add_argument("--do", choices=ACTIONS, default="search")
    p.add_argument("--index", help="folder of the index")
    for flags, text in (
        (("-c", "--count"), "matching lines per file (with an index: in all)"), (("-l", "--files-with-matches"), "paths only"), (("-i", "--ignore-case"), "fold case"),
        (("-v", "--invert-match"), "lines that don't match"), (("-o", "--only-matching"), "matches instead of lines"), (("-q", "--quiet"), "exit code only"),
        (("-F", "--fixed-strings"), "the pattern is plain text"), (("-U", "--no-unicode"), "ASCII classes and folding"), (("--multiline",), "match over line ends"),
        (("--no-ignore",), "don't honour ignore files"), (("--hidden",), "search hidden files"), (("--heading",), "paths as headings"), (("-N", "--no-heading"), "a path on each line"),
        (("--trim",), "no white space before lines"), (("--color",), "colour paths, numbers and matches"), (("-r", "--recursive"), "always so"), (("-n", "--line-number"), "always so"), (("-E", "--extended-regexp"), "always so"),
    ):
        p.add_argument(*flags, action="store_true", help=text)
    for flags in (("-A", "--after-context"), ("-B", "--before-context"), ("-C", "--context")):
        p.add_argument(*flags, type=int)
    p.add_argument("--include", action="append", default=[], metavar="GLOB")
    p.add_argument("--exclude", action="append", default=[], metavar="GLOB")
    p.add_argument("--type", action="append", default=[], metavar="EXT")
    p.add_argument("--format", choices=FORMATS)
    return p


def show(df) -> int:
    """Prints the first column in order; rows come one partition at a time."""
    n = 0
    for row in df.toLocalIterator():
        print(row[0])
        n += 1
    return n


def run_search(spark: SparkSession, a: argparse.Namespace, pattern: str, path: str) -> int:
    p = Pattern(pattern, fixed=a.fixed_strings, ignore_case=a.ignore_case, unicode=not a.no_unicode, multiline=a.multiline)
    before, after = resolve(a.context, a.before_context, a.after_context)
    search = Search(p, PathFilter(tuple(a.include), tuple(a.exclude), tuple(a.type), a.hidden), a.invert_match)
    index = None
    if a.index:
        index = ix.Index(spark, a.index) if ix.is_current(spark, a.index) else ix.build(from_directory(spark, path, a.no_ignore, (a.index,), True), a.index, a.ignore_case, path)
    docs = None if index else from_directory(spark, path, a.no_ignore)
    found = indexed.matching(index, search) if index else search.matching(docs)
    if a.quiet:
        return 0 if ops.exists(found).first()[0] else 1
    if a.count:
        show(ops.count_total(found).select("n") if index else summary(ops.count_per_file(found)).select("output"))
    elif a.files_with_matches:
        show(ops.files_with_matches(found).orderBy("path"))
    elif a.only_matching and not a.invert_match:
        hits = ops.only_matching(found, p).withColumnRenamed("match", "line").orderBy("path", "line_number", "nth")
        show(hits.selectExpr("concat(path, ':', line_number, ':', line)"))
    else:
        if not (before or after) or a.invert_match or a.multiline:
            rows = ops.display(found)
        else:
            rows = indexed.search_index(index, search, before, after) if index else with_context(docs, search, before, after)
        form = resolve_format(a.format, True if a.heading else False if a.no_heading else None, terminal=sys.stdout.isatty())
        show(sorted_output(render(rows, form, a.trim, p if a.color and not a.invert_match else None)))
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments().parse_intermixed_args(argv)
    if a.do == "search" and not a.words:
        print("siftwell: a pattern is needed", file=sys.stderr)
        return 2
    words = a.words if a.do == "search" else ["", *a.words]
    path = os.path.abspath(words[1] if len(words) > 1 else ".")
    spark = spark or SparkSession.builder.appName("siftwell").getOrCreate()
    try:
        if a.do == "search":
            return run_search(spark, a, words[0], path)
        if not a.index:
            raise ValueError("--index is needed")
        corpus = lambda: from_directory(spark, path, a.no_ignore, (a.index,), True)
        listed, read = lambda: listing(spark, path, a.no_ignore, (a.index,)), lambda names: read_files(names, path)
        if a.do == "index":
            made = ix.build(corpus(), a.index, a.ignore_case, path, {"no_ignore": a.no_ignore})
            print(f"{format_number(made.table('docs').count())} documents")
        elif a.do == "update":
            _, s = maintain.update_folder(listed(), a.index, read)
            print(f"{s.added} added, {s.modified} modified, {s.deleted} deleted, {format_number(s.docs)} documents")
        elif a.do == "compact":
            maintain.compact(ix.Index(spark, a.index))
        elif a.do == "watch":
            watch(spark, a.index, listed, f"{a.index}/.watch", read=read).awaitTermination()
        else:
            index = ix.Index(spark, a.index)
            r = index.stats().first()
            print(f"{format_number(r.docs)} documents, {format_number(r.trigrams)} trigrams, {r.per_trigram or 0:.1f} postings each")
            print(f"{format_number(index.folder.size())} bytes, {len(index.deltas)} deltas, {'stale' if maintain.is_stale(index, listed()) else 'current'}")
    except Exception as e:  # as any command: say why, and fail
        print(f"siftwell: {e}", file=sys.stderr)
        return 1
    return 0
