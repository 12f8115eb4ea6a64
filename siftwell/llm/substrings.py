"""Substring dedup by compacting a De Bruijn graph of token k-mers.

The edges are k-mers that are least in some window of WINDOW words (so each window holds
exactly one chosen edge, and equal windows choose it at the same place); an edge's
context is all the words of the windows that chose it, as 128 bits.  An edge is repeated
if documents of different ids hold it, and it branches if its occurrences have different
contexts: then more than one path leads through it.  Through joins on the edges:

1. a repeated edge that doesn't branch is wholly repeated: all of its windows lie on one
   path, whose source is its occurrence in the smallest document;
2. of a branching edge, occurrences with an equal context compact in the same way to the
   first document's, and only these first ones are expanded into single windows;
3. a join on the windows' hashes (128 bits) gives which of them start in a document with a
   smaller id.

Edges that follow one another in a document and in their source are one path: they are
joined into long spans, each with the source coordinates of its words.  The words at both
places are digested from the texts, and a span goes only if the digests are equal.

Spans of a document are then cut out of its text in one pass.  Counts are minimums with
map-side combination and joins that may be split, so a passage that a third of all
documents share is no task's burden.

Defined results: null and empty texts have no words; a document of fewer than WINDOW
words loses none; rows with a null doc_id lose none and cover none; rows that repeat a
doc_id cover nothing of each other, and lose what smaller ids cover.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import flat, release, sliced, small_batches, text_bytes
from .storage import Stages
from .wordhash import _RUN, _sums, chunks, mix, other_lane, run_hashes, word_hashes

WINDOW = 50
EDGE = 12

_OCCURRENCES = "doc_id long, text_key long, edge long, context long, other long, first int, n int"
_WINDOWS = "doc_id long, text_key long, window_hash long, other long, first int"


def _batch(columns: list, ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    names = [x.split() for x in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, names, strict=True)], names=[n for n, _ in names])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def edges_of(words: np.ndarray, counts: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, edge, context, its other lane) of each chosen edge of many texts,
    whose words' hashes lie end to end; windows are counted from the text's start."""
    width = window - k + 1
    sizes = np.maximum(counts - window + 1, 0)
    total = int(sizes.sum())
    if not total:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64))
    kmers = run_hashes(words, k)
    least = width - 1 - np.lib.stride_tricks.sliding_window_view(kmers, width)[:, ::-1].argmin(axis=1)  # the last of equals
    begin = np.cumsum(counts) - counts
    text = np.repeat(np.arange(len(counts)), sizes)
    at = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + begin[text]
    chosen = at + least[at]
    new = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
    n = np.diff(np.concatenate((new, [total])))
    first, place = at[new], chosen[new]
    with np.errstate(over="ignore"):
        sums, down = _sums(words, _RUN)
        whole = (sums[first + n + window - 1] - sums[first]) * down[first]
        context = mix(mix(whole + n.astype(np.uint64)) + (place - first).astype(np.uint64))
        sums, down = _sums(other_lane(words), _RUN)
        other = mix((sums[first + n + window - 1] - sums[first]) * down[first] + (place - first).astype(np.uint64))
    return text[new], first - begin[text[new]], n, kmers[place], context, other


def _occurrences(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in sliced(batch, 2):
                ids, keys = (np.asarray(part.column(i)) for i in (0, 1))
                body, at = flat(part.column(2))
                for a, b in chunks(at):
                    words, counts = word_hashes(body[at[a] : at[b]], at[a + 1 : b + 1] - at[a], False)
                    text, first, n, edge, context, other = edges_of(words, counts, window, k)
                    if len(text):
                        yield _batch([ids[a:b][text], keys[a:b][text], _signed(edge), _signed(context), _signed(other), first, n], _OCCURRENCES)
        release()

    return run


def _expand(window: int):
    """Single windows of the spans [(first, n)] of each text."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in sliced(batch, 3):
                ids, keys, spans = (part.column(i).to_pylist() for i in (0, 1, 2))
                body, at = flat(part.column(3))
                for a, b in chunks(at):
                    words, counts = word_hashes(body[at[a] : at[b]], at[a + 1 : b + 1] - at[a], False)
                    hashed, other, begin = run_hashes(words, window), run_hashes(other_lane(words), window), np.cumsum(counts) - counts
                    first = [np.concatenate([np.arange(s["first"], s["first"] + s["n"]) for s in spans[i]]) for i in range(a, b)]
                    sizes, every = [len(f) for f in first], np.concatenate(first)
                    at_word = every + np.repeat(begin, sizes)
                    yield _batch([np.repeat(ids[a:b], sizes), np.repeat(keys[a:b], sizes), _signed(hashed[at_word]), _signed(other[at_word]), every], _WINDOWS)

    return run


def _merged(spans: Column) -> Column:
    """Sorted spans <first, n> of one diagonal, with those that adjoin or overlap as one."""
    none = F.array().cast("array<struct<first:int,n:int>>")
    start = F.struct(F.lit(None).cast("int").alias("first"), F.lit(0).alias("end"), none.alias("out"))
    last = lambda a: F.when(a["first"].isNull(), none).otherwise(F.array(F.struct(a["first"].alias("first"), (a["end"] - a["first"]).alias("n"))))

    def step(a: Column, s: Column) -> Column:
        end = s["first"] + s["n"]
        joins = a["first"].isNotNull() & (s["first"] <= a["end"])
        first = F.when(joins, a["first"]).otherwise(s["first"])
        return F.struct(first.alias("first"), F.when(joins, F.greatest(a["end"], end)).otherwise(end).alias("end"), F.when(joins, a["out"]).otherwise(F.concat(a["out"], last(a))).alias("out"))

    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], last(a)))


def _digests(places: DataFrame, known: DataFrame, window: int, key: str) -> DataFrame:
    """(key, digest): of the words that each span covers. places: (doc_id, text_key, first, n, key)."""
    of_text = places.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first", "n", key)).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in sliced(batch, 1):
                names, digests = [], []
                for text, spans in zip(text_bytes(part.column(1)), part.column(0).to_pylist(), strict=True):
                    words = text.split()
                    for s in spans:
                        names.append(s[key])
                        digests.append(hashlib.blake2b(b" ".join(words[s["first"] : s["first"] + s["n"] + window - 1]), digest_size=16).digest())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(digests, pa.binary())], names=[key, "digest"])

    texts = known.select("doc_id", "text_key", "text").dropDuplicates(["doc_id", "text_key"])
    return of_text.join(texts, ["doc_id", "text_key"]).select("spans", "text").mapInArrow(run, f"{key} long, digest binary")


def repeated_spans(docs: DataFrame, stages: Stages, window: int, k: int) -> DataFrame:
    """(doc_id, text_key, spans: array<struct<first, n, digest>>) of all windows to remove;
    digest is that of the words at the source."""
    known = docs.where("doc_id is not null and text is not null")
    occurrences = stages.write(known.select("doc_id", "text_key", "text").mapInArrow(_occurrences(window, k), _OCCURRENCES))
    whole = F.struct("context", "other")
    source = F.min(F.struct("doc_id", "text_key", "first"))
    seen = occurrences.groupBy("edge").agg(source.alias("src"), F.max("doc_id").alias("d1"), F.min(whole).alias("c0"), F.max(whole).alias("c1")).where("src.doc_id < d1")
    seen = stages.write(seen.select("edge", "src", (F.col("c0") != F.col("c1")).alias("branches")))  # so that the join may split a hot edge
    repeated = stages.write(occurrences.join(seen, "edge").where("branches or doc_id > src.doc_id"))
    stages.drop(occurrences)
    from_source = ["doc_id", "text_key", "first", "n", F.col("src.doc_id").alias("src_id"), F.col("src.text_key").alias("src_key"), F.col("src.first").alias("src_first")]
    paths = repeated.where("not branches").select(from_source)

    branching = repeated.where("branches").drop("src")
    earliest = stages.write(branching.groupBy("edge", "context", "other").agg(source.alias("src")))
    compact = stages.write(branching.join(earliest, ["edge", "context", "other"]).select("doc_id", "text_key", "first", "n", "src"))
    later = compact.where("doc_id > src.doc_id").select(from_source)
    to_expand = compact.where("doc_id = src.doc_id").groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("first", "n")).alias("spans"))
    windows = stages.write(to_expand.join(known, ["doc_id", "text_key"]).select("doc_id", "text_key", "spans", "text").mapInArrow(_expand(window), _WINDOWS))
    least = windows.groupBy("window_hash", "other").agg(source.alias("src"), F.max("doc_id").alias("w1")).where("src.doc_id < w1")
    least = stages.write(least.select("window_hash", "other", "src"))
    single = windows.join(least, ["window_hash", "other"]).where("doc_id > src.doc_id").withColumn("n", F.lit(1)).select(from_source)

    # edges that follow one another in a document and in its source are one path
    diagonal = paths.union(later).union(single).withColumn("shift", F.col("src_first") - F.col("first"))
    joined = diagonal.groupBy("doc_id", "text_key", "src_id", "src_key", "shift").agg(F.array_sort(F.collect_set(F.struct("first", "n"))).alias("s"))
    spans = joined.select("doc_id", "text_key", "src_id", "src_key", "shift", F.explode(_merged(F.col("s"))).alias("x"))
    spans = stages.write(spans.select("doc_id", "text_key", F.col("x.first").alias("first"), F.col("x.n").alias("n"), "src_id", "src_key", (F.col("x.first") + F.col("shift")).alias("src_first")))
    at_source = spans.select(F.col("src_id").alias("doc_id"), F.col("src_key").alias("text_key"), F.col("src_first").alias("first"), "n").distinct()
    at_source = stages.write(at_source.withColumn("place", F.monotonically_increasing_id()))
    digests = stages.write(at_source.join(_digests(at_source, known, window, "place"), "place").select(F.col("doc_id").alias("src_id"), F.col("text_key").alias("src_key"), F.col("first").alias("src_first"), "n", "digest"))
    proved = spans.join(digests, ["src_id", "src_key", "src_first", "n"])
    return proved.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("first", "n", "digest")).alias("spans"))


def keep_words(text: bytes, spans: list[dict] | None, window: int) -> tuple[int, list[bytes]]:
    """The text's number of words, and those that no window of the spans covers; a span whose
    words aren't those at its source covers nothing."""
    words = text.split()
    spans = [s for s in spans or () if hashlib.blake2b(b" ".join(words[s["first"] : s["first"] + s["n"] + window - 1]), digest_size=16).digest() == s["digest"]]
    if not spans:
        return len(words), words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, [s["first"] for s in spans], 1)
    np.add.at(edge, [s["first"] + s["n"] + window - 1 for s in spans], -1)
    return len(words), [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def remove_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = EDGE, with_text: bool = False) -> DataFrame:
    """A row per row of docs: doc_id, n_words, n_removed, kept_sha256; with_text adds
    kept_text, the kept words joined by single spaces."""
    stages = Stages(docs.sparkSession)
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    spans = repeated_spans(docs, stages, window, k)
    joined = docs.join(spans, ["doc_id", "text_key"], "left").select("doc_id", "spans", "text")
    ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    names = [x.split()[0] for x in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in sliced(batch, 2):
                rows = []
                for text, cut in zip(text_bytes(part.column(2)), part.column(1).to_pylist(), strict=True):
                    n, words = keep_words(text, cut, window)
                    kept = b" ".join(words)
                    rows.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), *[kept.decode()] * with_text))
                made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], names=names)

    return joined.mapInArrow(run, ddl)
