"""The trigram index: Parquet tables sorted by trigram.

postings      (tri, chunk, at): the places of a trigram in a chunk of documents, in order;
              a place is the document's number in the chunk << 32 | the line's number
chunks        (chunk, doc_ids, offsets): a chunk's documents, and where their lines start
grams         (tri, docs, lines): how many documents and lines hold each trigram
followers     (tri, next): what ever follows a trigram, over whole texts
docs          (doc_id, path, ext, mtime, gen, text), sorted by id inside each file

with `_ci` twins of postings and grams over folded lines, if asked for.  Trigrams are of code
points.  Places serve both tiers: without their lower half they are documents.

An index folder holds versions and a state file for each commit; the one of the highest
number names what is live.  A version is written whole before a state names it, and a
number can be taken only once, so of two writers that began from one state the second
fails and nothing is lost.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .grams import DOCS, FOLDED, NEXT, PLAIN, SCHEMA, gram_rows, with_offsets

__all__ = ["Index", "build", "open_or_build", "with_offsets"]

VERSION = 2
#: Rows of a file of the posting tables, and the bytes of a row group of the documents.
FILE_ROWS = 1_000_000
ROW_GROUP = 1 << 20


class ConcurrentUpdate(RuntimeError):
    """Another writer committed since this one read the index."""


class OtherVersion(ValueError):
    """The index was written by another version of the format."""


def exploded(lists: DataFrame, chunks: DataFrame) -> DataFrame:
    """(tri, doc_id, line_no, byte_offset) of postings."""
    place = lists.join(chunks, "chunk").select("tri", "doc_ids", "offsets", F.explode("at").alias("at"))
    doc, line = F.shiftright("at", 32).cast("int"), F.col("at").bitwiseAND(0xFFFFFFFF)
    return place.select("tri", F.get("doc_ids", doc).alias("doc_id"), line.alias("line_no"), F.get(F.get("offsets", doc), (line - 1).cast("int")).alias("byte_offset"))


def may_follow(found: DataFrame, tri: str, allowed: list[str]) -> bool:
    """True if the trigram is unknown or some allowed character ever follows it."""
    seen = found.where(F.col("tri") == tri)
    return seen.isEmpty() or not seen.where(F.col("next").isin(allowed)).isEmpty()


def stats(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """docs, trigrams, postings and mean postings per trigram, in one row. grams: (tri, lines)."""
    n = docs.agg(F.count("*").alias("docs"))
    p = grams.groupBy("tri").agg(F.sum("lines").alias("n")).agg(F.count("*").alias("trigrams"), F.coalesce(F.sum("n"), F.lit(0)).alias("postings"))
    return p.select(n.scalar().alias("docs"), "trigrams", "postings", (F.col("postings") / F.col("trigrams")).alias("per_trigram"))


@dataclass(frozen=True)
class Meta:
    version: int = VERSION
    ci: bool = False
    built_at: int = 0
    root: str = ""
    options: dict = field(default_factory=dict)
    updates: int = 0
    docs: int = 0  # that are live
    ids: int = 0  # the largest id ever given


class Folder:
    """Small files of an index folder, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.jvm = spark, path.rstrip("/"), spark._jvm

    def _fs(self, name: str):
        p = self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def read(self, name: str) -> str:
        p, fs = self._fs(name)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a whole file under a name that nobody has; False if somebody has it."""
        temp, fs = self._fs(f".{name}-{uuid.uuid4().hex}")
        target, _ = self._fs(name)
        out = fs.create(temp, True)
        out.write(bytearray(text.encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri() if temp.isAbsolute() and temp.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(temp), fs.makeQualified(target), options)
        except Py4JJavaError as e:
            fs.delete(temp, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def names(self) -> list[str]:
        p, fs = self._fs("")
        return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []

    def size(self, name: str = "") -> int:
        """Bytes below the folder."""
        p, fs = self._fs(name)
        return fs.getContentSummary(p).getLength()

    def drop(self, name: str) -> None:
        p, fs = self._fs(name)
        fs.delete(p, True)

    def state(self) -> tuple[int, dict | None]:
        """The number and the content of the live state; (0, None) without one."""
        numbers = [int(n[6:-5]) for n in self.names() if n.startswith("state-") and n.endswith(".json")]
        last = max(numbers, default=0)
        return last, json.loads(self.read(f"state-{last:010d}.json")) if last else None


def save(df: DataFrame, path: str, *order: str) -> None:
    """Sorted over files by ranges of (trigram, chunk), so that statistics find the pages
    of a trigram, and one that very many chunks hold is split among tasks."""
    df.repartitionByRange(*order[:2]).sortWithinPartitions(*order).write.option("maxRecordsPerFile", FILE_ROWS).parquet(path)


class Index:
    """A loaded index: tables of the live version, with its overlay applied."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)
        self.number, state = self.folder.state()
        if state is None:
            raise (OtherVersion if "CURRENT" in self.folder.names() else FileNotFoundError)(f"no index of version {VERSION} in {path}")
        if state["meta"]["version"] != VERSION:
            raise OtherVersion(f"the index in {path} is of version {state['meta']['version']}; build it again")
        self.main: str = state["main"]
        self.deltas: list[str] = state["deltas"]
        self.meta = Meta(**state["meta"])

    @property
    def ci(self) -> bool:
        return self.meta.ci

    def _read(self, part: str, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder.path}/{part}/{table}")

    def _union(self, table: str) -> DataFrame:
        """Main and deltas; each has chunk numbers of its own."""
        out = None
        for k, part in enumerate((self.main, *self.deltas)):
            rows = self._read(part, table)
            rows = rows.withColumn("chunk", F.col("chunk") + F.lit(k << 52)) if "chunk" in rows.columns else rows
            out = rows if out is None else out.unionByName(rows)
        return out

    def live(self, rows: DataFrame) -> DataFrame:
        """rows (doc_id, ...) without deleted documents; one that changed has a new id."""
        gone = self.tombstones()
        return rows if gone is None else rows.join(gone, "doc_id", "left_anti")

    def lists(self, folded: bool = False) -> DataFrame:
        """(tri, chunk, at) of all documents, deleted ones too."""
        return self._union("postings_ci" if folded else "postings")

    def chunks(self) -> DataFrame:
        """(chunk, doc_ids, offsets)"""
        return self._union("chunks")

    def table(self, name: str) -> DataFrame:
        """docs, followers, grams, postings or doc_postings (or their _ci twins) of live
        documents; postings come a line a row, doc_postings (tri, doc_id) a document a row."""
        if name == "followers":
            return self._union(name)
        if "postings" not in name:
            return self.live(self._union(name)) if name == "docs" else self._union(name)
        lists = self.lists(name.endswith("_ci"))
        if not name.startswith("doc_"):
            return self.live(exploded(lists, self.chunks()))
        numbers = F.array_distinct(F.transform("at", lambda x: F.shiftright(x, 32).cast("int")))
        pairs = lists.select("tri", "chunk", F.explode(numbers).alias("n")).join(self.chunks().select("chunk", "doc_ids"), "chunk")
        return self.live(pairs.select("tri", F.get("doc_ids", F.col("n")).alias("doc_id")))

    def frequency(self, trigrams: Iterable[str], folded: bool) -> dict[str, tuple[int, int]]:
        """At most how many documents and lines hold each trigram (deleted ones count)."""
        name, out = "grams_ci" if folded else "grams", dict.fromkeys(trigrams, (0, 0))
        for part in (self.main, *self.deltas):
            for t, d, n in self._read(part, name).where(F.col("tri").isin(list(out))).collect():
                out[t] = out[t][0] + d, out[t][1] + n
        return out

    def tombstones(self) -> DataFrame | None:
        out = None
        for part in self.deltas:
            gone = self._read(part, "tombstones")
            out = gone if out is None else out.unionByName(gone)
        return out

    def stats(self) -> DataFrame:
        if not self.deltas:
            return stats(self.table("docs"), self.table("grams"))
        lines = self.table("postings").groupBy("tri").agg(F.count("*").alias("lines"))  # without deleted documents
        return stats(self.table("docs"), lines)


def write_tables(docs: DataFrame, path: str, ci: bool, gen: int) -> int:
    """Writes the tables of docs; returns how many documents they hold.

    The trigrams are computed once, into a table that lives only here; each posting table
    is then a range partitioning and a sort of its part of it.
    """
    spark = docs.sparkSession
    stored = docs.select("doc_id", "path", "ext", "mtime", F.lit(gen).alias("gen"), "text")
    stored.sortWithinPartitions("doc_id").write.option("parquet.block.size", ROW_GROUP).parquet(f"{path}/docs")
    stored = spark.read.schema(stored.schema).parquet(f"{path}/docs")
    gram_rows(stored, ci).write.partitionBy("kind").parquet(f"{path}/.made")
    made = spark.read.schema(SCHEMA).parquet(f"{path}/.made")
    made.where(F.col("kind") == DOCS).select("chunk", "doc_ids", "offsets").write.parquet(f"{path}/chunks")
    for suffix, kind in (("", PLAIN), *([("_ci", FOLDED)] if ci else [])):
        rows = made.where(F.col("kind") == kind)
        save(rows.select("tri", "chunk", "at"), f"{path}/postings{suffix}", "tri", "chunk")
        counts = rows.groupBy("tri").agg(F.sum("docs").alias("docs"), F.sum(F.size("at")).alias("lines"))
        counts.sort("tri").write.parquet(f"{path}/grams{suffix}")
    followers = made.where(F.col("kind") == NEXT).select("tri", F.explode("next").alias("next")).distinct()
    followers.sort("tri", "next").write.parquet(f"{path}/followers")
    Folder(spark, path).drop(".made")
    return stored.count()


def is_current(spark: SparkSession, path: str) -> bool:
    state = Folder(spark, path).state()[1]
    return state is not None and state["meta"]["version"] == VERSION


def commit(folder: Folder, number: int, main: str, deltas: list[str], meta: Meta) -> None:
    """Makes (main, deltas) live as the state after `number`, the one that was read."""
    if not folder.create(f"state-{number + 1:010d}.json", json.dumps({"main": main, "deltas": deltas, "meta": asdict(meta)})):
        for part in {main, *deltas} - _named(folder):
            folder.drop(part)
        raise ConcurrentUpdate(f"{folder.path} was changed by another writer; read it and update again")


def _named(folder: Folder) -> set[str]:
    state = folder.state()[1]
    return {state["main"], *state["deltas"]} if state else set()


def drop_old(folder: Folder, number: int, state: dict | None) -> None:
    """Removes what an older state named and the live one doesn't, and the older state files."""
    live = _named(folder)
    for part in ({state["main"], *state["deltas"]} if state else set()) - live:
        folder.drop(part)
    for name in folder.names():
        if name.startswith("state-") and int(name[6:-5]) < number + 1:
            folder.drop(name)


def build(docs: DataFrame, path: str, ci: bool = False, root: str = "", options: dict | None = None) -> Index:
    """Builds an index of docs (doc_id, path, ext, text, mtime) as the folder's live version."""
    spark = docs.sparkSession
    folder, name = Folder(spark, path), f"v-{uuid.uuid4().hex}"
    number, old = folder.state()
    written = write_tables(docs, f"{folder.path}/{name}", ci, 0)
    largest = spark.read.parquet(f"{folder.path}/{name}/docs").agg(F.max("doc_id")).first()[0]
    now = spark.sql("select unix_timestamp()").first()[0]
    commit(folder, number, name, [], Meta(ci=ci, built_at=now, root=root, options=options or {}, docs=written, ids=largest or 0))
    drop_old(folder, number, old)
    return Index(spark, path)


def open_or_build(docs: DataFrame, path: str, ci: bool = False) -> Index:
    """The live index, or a new one where there is none or one of another version."""
    spark = docs.sparkSession
    return Index(spark, path) if is_current(spark, path) else build(docs, path, ci)
