"""Corpora: documents with a path and a text, and their lines.

Only a line feed ends a line; a text that ends in one has no empty last line, and an
empty text has none at all.  One trailing carriage return is left out of what is shown.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import extension, is_text
from .ignore import walk

#: doc_id long, path string, ext string, text string, mtime long
COLUMNS = ("doc_id", "path", "ext", "text", "mtime")


def from_table(df: DataFrame, id_col: str, text_col: str, path: Column | None = None, ext: Column | None = None, mtime: Column | None = None) -> DataFrame:
    """Each row is a document; the path defaults to the id as text."""
    path = F.col(f"`{id_col}`").cast("string") if path is None else path
    return df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        path.alias("path"),
        (extension(path) if ext is None else ext).alias("ext"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
        (F.lit(0) if mtime is None else mtime).cast("long").alias("mtime"),
    )


def listing(spark: SparkSession, root: str, no_ignore: bool = False, skip: tuple[str, ...] = ()) -> DataFrame:
    """path and mtime of the files below root, found by tasks, a folder of the top each;
    contents aren't opened."""
    return walk(spark, root, no_ignore, skip).select("path", "mtime")


def read_files(names: DataFrame, root: str) -> DataFrame:
    """The documents of the files that `names` (path, mtime) lists, relative to root; binary
    files and ones that can't be read have a null text, so that they aren't tried again
    until they change.  Malformed UTF-8 becomes U+FFFD.  root must be mounted at every
    executor; tables that Spark reads itself come by `from_table`."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, p in enumerate(batch.column(0).to_pylist()):  # one file at a time: memory is that of the largest
                try:
                    with open(f"{root}/{p}", "rb") as f:
                        content = f.read()
                except OSError:
                    content = None
                yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns, pa.array([content], pa.binary())], names=["path", "mtime", "content"])

    files = names.select("path", "mtime").mapInArrow(read, "path string, mtime long, content binary")
    ext = extension(F.col("path"))
    text = F.when(is_text(F.col("content"), ext), F.expr("make_valid_utf8(cast(content as string))"))
    return files.select("path", ext.alias("ext"), text.alias("text"), "mtime")


def from_directory(spark: SparkSession, root: str, no_ignore: bool = False, skip: tuple[str, ...] = (), with_binary: bool = False) -> DataFrame:
    """The text files below root as documents; with_binary also the others, without text.
    Ids are hashes of the paths, so they need no order."""
    found = read_files(listing(spark, root, no_ignore, skip), root)
    docs = found.select(F.shiftrightunsigned(F.xxhash64("path"), 1).alias("doc_id"), *COLUMNS[1:])
    return docs if with_binary else docs.where("text is not null")


def lines(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id, path, line_number (from 1), line, and `extra` columns of docs."""
    parts = F.split("text", "\n", -1)
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    exploded = docs.where("text is not null").select("doc_id", "path", *extra, F.posexplode(kept).alias("at", "line"))
    return exploded.select("doc_id", "path", *extra, (F.col("at") + 1).cast("long").alias("line_number"), "line")


def shown(line: Column) -> Column:
    """The line without one trailing carriage return."""
    return F.when(line.endswith("\r"), line.substr(F.lit(1), F.length(line) - 1)).otherwise(line)
