"""Indexed search: trigrams choose candidates, and the pattern decides.

A pattern's trigrams are an OR of ANDs.  The small table of trigram frequencies says first
how many documents can be candidates at most (the rarest trigram of each branch).  Where
that is most of them, the index can't help and all are scanned.  Otherwise candidates are
a relational division by chunks: postings whose trigram is asked for, grouped by branch and
chunk, kept where all of the branch's trigrams are there, and their places intersected, by
line or by document.  The trigrams go to the scan as an IN list, so the sorted table's
statistics skip all else.

Few candidates (their bound is known before) are fetched, and only the ranges of ids that
they lie in are read; more are joined, broadcast only below a bound of their own.
Candidates may hold false positives, never miss a match; without trigrams, or without a
folded twin for a case-insensitive pattern, all documents are scanned.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.context import with_context
from ..operators.search import Pattern, Search, display
from .index import Index

#: Candidates that are fetched at most, and those that are broadcast at most.
FETCHED, BROADCAST = 10_000, 1_000_000
#: Ranges of ids that are asked for at most.
RANGES = 16
#: Above this share of all documents the index isn't used.
USEFUL = 0.3


def query_of(pattern: Pattern, ci: bool) -> list[list[str]]:
    """The pattern's trigrams, or [] where the index can't narrow it."""
    if pattern.multiline and "\n" in pattern.text or pattern.folded and not ci:
        return []
    return pattern.trigrams()


def divide(lists: DataFrame, query: list[list[str]], by_line: bool) -> DataFrame:
    """(chunk, at): places (without by_line, documents' numbers) that have all trigrams of
    some branch. lists: (tri, chunk, at)."""
    wanted = sorted({t for branch in query for t in branch})
    place = F.col("at") if by_line else F.array_distinct(F.transform("at", lambda x: F.shiftright(x, 32)))
    hits = lists.where(F.col("tri").isin(wanted)).select("tri", "chunk", place.alias("at"))
    if len(wanted) == 1:
        return hits.drop("tri")
    keys, size = ["chunk"], F.lit(len(wanted))
    if len(query) > 1:
        of = {t: [k for k, branch in enumerate(query) if t in branch] for t in wanted}
        branch = F.create_map(*[x for t in wanted for x in (F.lit(t), F.array(*map(F.lit, of[t])))])
        hits = hits.select("*", F.explode(branch[F.col("tri")]).alias("branch"))
        keys, size = ["branch", "chunk"], F.get(F.array(*[F.lit(len(b)) for b in query]), F.col("branch"))
    full = hits.groupBy(*keys).agg(F.collect_list("at").alias("all")).where(F.size("all") == size)
    full = full.withColumn("all", F.array_sort("all", lambda a, b: F.size(a) - F.size(b)))  # the rarest first
    common = F.aggregate(F.slice("all", F.lit(2), F.size("all")), F.col("all")[0], lambda a, x: F.array_intersect(a, x))
    full = full.select("chunk", common.alias("at")).where(F.size("at") > 0)
    return full.groupBy("chunk").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at")) if len(query) > 1 else full


def _documents(index: Index, found: DataFrame, by_line: bool) -> DataFrame:
    """(doc_id, at) of the places found."""
    pairs = found.join(index.chunks().select("chunk", "doc_ids"), "chunk").select("doc_ids", F.explode("at").alias("at"))
    return pairs.select(F.get("doc_ids", (F.shiftright("at", 32) if by_line else F.col("at")).cast("int")).alias("doc_id"), "at")


def candidate_docs(index: Index, pattern: Pattern) -> DataFrame | None:
    """(doc_id): documents that have a branch's trigrams on any lines; None for all."""
    query = query_of(pattern, index.ci)
    return index.live(_documents(index, divide(index.lists(pattern.folded), query, False), False).select("doc_id")) if query else None


def candidate_lines(index: Index, pattern: Pattern) -> DataFrame | None:
    """(doc_id, line_no), or None for all."""
    query = query_of(pattern, index.ci)
    if not query:
        return None
    found = _documents(index, divide(index.lists(pattern.folded), query, True), True)
    return index.live(found.select("doc_id", F.col("at").bitwiseAND(0xFFFFFFFF).alias("line_no")))


def strategy(index: Index, search: Search) -> str:
    if search.invert or not query_of(search.pattern, index.ci):
        return "full scan"
    return "documents" if search.pattern.multiline else "lines"


def most_candidates(index: Index, pattern: Pattern) -> int:
    """An upper bound of the candidate documents: of each branch its rarest trigram's."""
    query = query_of(pattern, index.ci)
    docs = index.frequency({t for branch in query for t in branch}, pattern.folded)
    return sum(min(docs[t][0] for t in branch) for branch in query)


def id_ranges(ids: list[int]) -> list[tuple[int, int]]:
    """At most RANGES ranges that hold the sorted ids, cut at the widest gaps."""
    gaps = sorted(range(1, len(ids)), key=lambda k: ids[k - 1] - ids[k])[: RANGES - 1]
    edges = [0, *sorted(gaps), len(ids)]
    return [(ids[a], ids[b - 1]) for a, b in zip(edges, edges[1:])]


def chosen_docs(index: Index, search: Search) -> DataFrame:
    """The index's documents, without those that can't match."""
    docs, plan = search.paths.apply(index.table("docs")), strategy(index, search)
    if plan == "full scan":
        return docs
    most = most_candidates(index, search.pattern)
    if not most:
        return docs.where("false")
    if most > USEFUL * index.meta.docs:
        return docs
    by_line = plan == "lines"
    places = divide(index.lists(search.pattern.folded), query_of(search.pattern, index.ci), by_line)
    if by_line:
        places = places.withColumn("at", F.array_distinct(F.transform("at", lambda x: F.shiftright(x, 32))))
    found = _documents(index, places, False).select("doc_id")
    if most > FETCHED:
        return docs.join(F.broadcast(found) if most <= BROADCAST else found, "doc_id", "left_semi")
    ids = sorted(r[0] for r in found.collect())
    if not ids:
        return docs.where("false")
    near = reduce(lambda a, b: a | b, [F.col("doc_id").between(a, b) for a, b in id_ranges(ids)])
    return docs.where(near & F.expr(f"doc_id in ({','.join(map(str, ids))})"))


def matching(index: Index, search: Search) -> DataFrame:
    """As Search.matching over the index's documents."""
    return replace(search, paths=type(search.paths)()).matching(chosen_docs(index, search))


def search_index(index: Index, search: Search, before: int = 0, after: int = 0) -> DataFrame:
    """As Search.run, or as with_context where lines around matches are wanted."""
    if not before and not after:
        return display(matching(index, search))
    return with_context(chosen_docs(index, search), search, before, after)


def search_stats(index: Index, search: Search) -> DataFrame:
    """strategy, candidate lines and documents, matching lines, lines per document: one row."""
    plan = strategy(index, search)
    found = matching(index, search).agg(F.count("*").alias("matches"))
    asked = candidate_lines(index, search.pattern) if plan == "lines" else None
    if asked is None:
        n = index.table("docs").agg(F.count("*").alias("candidate_docs"), F.lit(None).cast("long").alias("candidate_lines"))
    else:
        n = asked.agg(F.countDistinct("doc_id").alias("candidate_docs"), F.count("*").alias("candidate_lines"))
    density = F.col("candidate_lines") / F.nullif(F.col("candidate_docs"), F.lit(0))
    return n.select(F.lit(plan).alias("strategy"), "candidate_docs", "candidate_lines", found.scalar().alias("matches"), density.alias("density"))
