"""Runs a text kernel over Arrow batches and appends the columns it computes.

Every map-only operator of this package goes through `append_columns`: rows stay
where the scan put them (no shuffle), whole texts reach the kernel in slices of
bounded size, and the output columns replace input columns of the same name.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows of an Arrow batch at most: batches of whole texts are held several times over.
BATCH_ROWS = 2000
#: Bytes of text that a kernel sees at once; a single longer text comes alone.
SLICE_BYTES = 4 << 20


def column(name: str) -> Column:
    """The column of that very name, whatever is in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def text_bytes(column: pa.Array) -> list[bytes]:
    """The texts of a string column as UTF-8; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes in one array, and where each row starts and ends."""
    column = column.cast(pa.binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def sliced(batch: pa.RecordBatch, text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch between rows so that a slice holds about `most` bytes of text."""
    if not batch.num_rows:
        return
    _, at = flat(batch.column(text))
    group = at[1:] // most
    edges = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows per Arrow batch to BATCH_ROWS, unless the application was
    started with a number of its own (see README)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not spark.sparkContext.getConf().contains(name) and not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def release() -> None:
    """Gives memory that a task's arrays held back to the system: idle workers keep little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries do without
        ctypes.CDLL(None).malloc_trim(0)


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run`, a generator over batches, that releases memory once its last arrays are gone."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def append_columns(docs: DataFrame, text_col: str, added: T.StructType, kernel: Callable[[], Callable], keep: Sequence[str] | None = None, where: Callable | None = None, only_filter: bool = False) -> DataFrame:
    """`keep` (default: all columns) plus `added`, computed from `text_col`.

    `kernel()` runs once in each task and returns a function from a pyarrow string
    array to one array (or list) for each added field.  `where`, given the same
    arrays, may return a mask of the rows to keep; with only_filter that is all, and no
    column is added.  A kept column with the name of an added one, in any case, gives way
    to it; names may hold dots and anything else.
    """
    taken = set() if only_filter else {n.lower() for n in added.names}
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in taken]
    kept = [column(c).alias(f"c{i}") for i, c in enumerate(names)]  # places stand for names until the end
    if text_col in names and docs.schema[text_col].dataType == T.StringType():  # one copy of the texts is enough
        at, source = names.index(text_col), docs.select(kept)
    else:
        at, source = len(names), docs.select(*kept, column(text_col).cast("string").alias(f"c{len(names)}"))
    fields = [] if only_filter else [T.StructField(f"a{i}", f.dataType) for i, f in enumerate(added.fields)]
    out = T.StructType([*source.schema.fields[: len(names)], *fields])
    small_batches(docs.sparkSession)
    kinds = [to_arrow_type(f.dataType) for f in added.fields]

    def run(batches):
        compute = kernel()
        for batch in batches:
            for part in sliced(batch, at):
                made = [pa.array(x, kind) for x, kind in zip(compute(part.column(at)), kinds, strict=True)]
                rows = pa.RecordBatch.from_arrays([*part.columns[: len(names)], *([] if only_filter else made)], names=out.names)
                yield rows if where is None else rows.filter(pa.array(where(made)))

    return source.mapInArrow(releasing(run), out).toDF(*names, *([] if only_filter else added.names))
