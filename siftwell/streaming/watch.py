"""Keeping an index up to date from a stream.

Structured Streaming's file source sees new files only.  So a tick (a rate stream) asks
the corpus for its present state in each micro-batch, and the update finds what was
added, changed and deleted.  The trigger's interval stands for the quiet period.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.index import ConcurrentUpdate
from ..plans.maintain import compact, update_folder

DEBOUNCE_SECONDS = 3
COMPACT_EVERY = 20


class Updater:
    """Applies the corpus's state to the index in a folder, and compacts it now and then.

    With `read`, the corpus may be a listing (path, mtime): only what changed is read.
    """

    def __init__(self, spark: SparkSession, path: str, corpus: Callable[[], DataFrame], compact_every: int = COMPACT_EVERY, read: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.path, self.corpus, self.compact_every, self.read = spark, path, corpus, compact_every, read

    def apply(self, _batch: DataFrame | None = None, _number: int = 0) -> None:
        try:
            index, stats = update_folder(self.corpus(), self.path, self.read)
            if stats.added + stats.modified + stats.deleted and index.meta.updates >= self.compact_every:
                compact(index)
        except ConcurrentUpdate:
            pass  # somebody else's commit came first: the next tick starts from it


def watch(spark: SparkSession, path: str, corpus: Callable[[], DataFrame], checkpoint: str, seconds: float = DEBOUNCE_SECONDS, compact_every: int = COMPACT_EVERY, read: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Starts the updater. The query's status and stop are what a daemon's would be, and
    `flush` is its flush (ticks never end, so processAllAvailable may not return); changes
    made while it was down are found by its first batch."""
    updater = Updater(spark, path, corpus, compact_every, read)
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(updater.apply).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def flush(updater: Updater) -> None:
    """Read-your-writes: applies the corpus's state now."""
    updater.apply()


def watch_files(spark: SparkSession, pattern_schema: str, folder: str, form: str, on_batch: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """For corpora that only grow: new files of `folder` as micro-batches, each file once."""
    source = spark.readStream.format(form).schema(pattern_schema).load(folder)
    return source.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
