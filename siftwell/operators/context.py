"""Lines around matches, and the chunks that they form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.corpus import lines, shown
from .search import Search


def resolve(context: int | None, before: int | None, after: int | None) -> tuple[int, int]:
    """Lines before and after; each side's own number goes over the common one."""
    return tuple(next((n for n in (own, context) if n is not None), 0) for own in (before, after))


def with_context(docs: DataFrame, search: Search, before: int = 0, after: int = 0) -> DataFrame:
    """doc_id, path, line_number, line, kind ('match' or 'context') and chunk: the number of
    the run of adjoining lines, from 1 in each document.

    A line is after-context of a match up to `after` rows above it, so the frame reaches
    `after` rows back and `before` rows on.  Only documents with a match are windowed, and
    partitions are documents, so frames end at their edges.
    """
    kept = search.paths.apply(docs)
    hits = search.matching(docs).select("doc_id", "line_number", F.lit(True).alias("hit"))
    every = lines(kept.join(hits.select("doc_id").distinct(), "doc_id", "left_semi"))
    marked = every.withColumn("hit", search.keeps(F.col("line")))
    order = Window.partitionBy("doc_id").orderBy("line_number")
    near = F.max("hit").over(order.rowsBetween(-after, before))
    wanted = marked.withColumn("near", near).where("near")
    gap = F.coalesce(F.col("line_number") - F.lag("line_number").over(order) > 1, F.lit(True)) if before or after else F.lit(True)
    chunk = F.sum(gap.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) if before or after else F.lit(0).cast("long")
    return wanted.select("doc_id", "path", "line_number", shown(F.col("line")).alias("line"), F.when(F.col("hit"), "match").otherwise("context").alias("kind"), chunk.alias("chunk"))
