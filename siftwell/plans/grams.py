"""Trigram postings of documents, computed in numpy for many documents at once.

Documents are taken in chunks of about CHUNK characters.  A chunk gives one row for each
trigram in it, with the places (document's number in the chunk << 32 | line number) in
order, for the texts as they are and, if asked for, folded; one row for each trigram with
the characters that follow it; and one row that tells the chunk's documents and where
their lines start.  Nothing is shuffled here.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fold import tables

#: Characters handled at once; one longer text comes alone.
CHUNK = 1 << 20
PLAIN, FOLDED, NEXT, DOCS = 0, 1, 2, 3
SCHEMA = "kind int, chunk long, tri string, at array<long>, docs int, next array<string>, doc_ids array<long>, offsets array<array<long>>"
_KINDS = {"kind": pa.int32(), "chunk": pa.int64(), "tri": pa.string(), "at": pa.list_(pa.int64()), "docs": pa.int32(), "next": pa.list_(pa.string()), "doc_ids": pa.list_(pa.int64()), "offsets": pa.list_(pa.list_(pa.int64()))}


@cache
def _fold_table() -> np.ndarray:
    out = np.arange(0x110000, dtype=np.uint32)
    for a, b in zip(*tables(), strict=True):
        out[ord(a)] = ord(b)
    return out


def _strings(codes: np.ndarray) -> list[str]:
    """Each row of code points as a string."""
    n, text = codes.shape[1], codes.astype("<u4").tobytes().decode("utf-32-le")
    return [text[i : i + n] for i in range(0, len(text), n)]


def _distinct(x: np.ndarray) -> np.ndarray:
    """The sorted different values."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def _rows(n: int, kind: int, chunk: int, **columns) -> pa.RecordBatch:
    """n rows of SCHEMA; columns not given are null."""
    columns |= {"kind": pa.array(np.full(n, kind, np.int32)), "chunk": pa.array(np.full(n, chunk))}
    return pa.RecordBatch.from_arrays([columns[k] if k in columns else pa.nulls(n, t) for k, t in _KINDS.items()], names=list(_KINDS))


def _groups(sorted_keys: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Where each run of equal keys starts, and these places with the end, as list offsets."""
    first = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
    return first, pa.array(np.concatenate((first, [len(sorted_keys)])).astype(np.int32))


class Chunk:
    """Some documents' characters end to end, each followed by a line feed."""

    def __init__(self, number: int, ids: list[int], texts: list[str]):
        self.number = number
        self.codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "replace"), "<u4")
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.ids = np.array(ids, np.int64)
        self.first = np.cumsum(sizes) - sizes
        feed = self.codes == 10
        width = 1 + (self.codes >= 0x80) + (self.codes >= 0x800) + (self.codes >= 0x10000)
        byte = np.cumsum(width) - width
        self.line = np.cumsum(feed) - feed  # of each character
        starts = np.concatenate(([0], np.flatnonzero(feed[:-1]) + 1))
        doc = np.searchsorted(self.first, starts, side="right") - 1  # of each line
        self.doc_of_line = doc
        line_no = np.arange(len(starts)) - self.line[self.first][doc] + 1
        self.place = (doc << 32) | line_no  # of each line
        self.offset = byte[starts] - byte[self.first][doc]
        self.inside = ~(feed[:-2] | feed[1:-1] | feed[2:]) if len(feed) > 2 else np.zeros(0, bool)

    def _triples(self, codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
        """A number for the three characters from each place, how many numbers there may be,
        and the characters' codes; the numbers count the chunk's own characters, so that
        they stay small."""
        seen = np.zeros(0x110000, bool)
        seen[codes] = True
        alphabet = np.flatnonzero(seen)
        small = np.zeros(0x110000, np.int32)
        small[alphabet] = np.arange(len(alphabet))
        x, n = small[codes].astype(np.int64), len(alphabet)
        return (x[at] * n + x[at + 1]) * n + x[at + 2], n**3, alphabet

    @staticmethod
    def _names(triples: np.ndarray, alphabet: np.ndarray) -> pa.Array:
        """The trigram of each number."""
        n, different = len(alphabet), _distinct(triples)
        names = pa.array(_strings(np.stack([alphabet[different // n // n], alphabet[different // n % n], alphabet[different % n]], axis=1)))
        return names.take(pa.array(np.searchsorted(different, triples)))

    def postings(self, kind: int) -> pa.RecordBatch | None:
        at = np.flatnonzero(self.inside)
        if not len(at):
            return None
        tri, most, alphabet = self._triples(_fold_table()[self.codes] if kind == FOLDED else self.codes, at)
        lines, known = len(self.place), None
        if most * lines >= 1 << 62:
            known = _distinct(tri)
            tri = np.searchsorted(known, tri)
        key = _distinct(tri * lines + self.line[at])
        line, tri = key % lines, key // lines
        first, ends = _groups(tri)
        new = np.concatenate(([True], (tri[1:] != tri[:-1]) | (self.doc_of_line[line[1:]] != self.doc_of_line[line[:-1]])))
        docs = np.add.reduceat(new, first, dtype=np.int32)
        tri = tri[first]
        return _rows(len(tri), kind, self.number, tri=self._names(tri if known is None else known[tri], alphabet), at=pa.ListArray.from_arrays(ends, pa.array(self.place[line])), docs=pa.array(docs))

    def followers(self) -> pa.RecordBatch | None:
        """Four characters in a row of one text, over its line ends too."""
        at = np.arange(max(len(self.codes) - 3, 0))
        end = np.concatenate((self.first[1:], [len(self.codes)])) - 1  # the line feed after each text
        at = at[at + 3 < np.repeat(end, np.diff(np.concatenate((self.first, [len(self.codes)]))))[: len(at)]]
        if not len(at):
            return None
        tri, most, alphabet = self._triples(self.codes, at)
        small = np.searchsorted(alphabet, self.codes[at + 3])
        n = len(alphabet)
        if most * n >= 1 << 62:
            known = _distinct(tri)
            key = _distinct(np.searchsorted(known, tri) * n + small)
            tri = known[key // n]
        else:
            key = _distinct(tri * n + small)
            tri = key // n
        first, ends = _groups(tri)
        letters = pa.array(_strings(alphabet[:, None])).take(pa.array(key % n))
        return _rows(len(first), NEXT, self.number, tri=self._names(tri[first], alphabet), next=pa.ListArray.from_arrays(ends, letters))

    def documents(self) -> pa.RecordBatch:
        n = len(self.ids)
        ends = np.searchsorted(self.doc_of_line, np.arange(n + 1)).astype(np.int32)
        offsets = pa.ListArray.from_arrays(pa.array(ends), pa.array(self.offset.astype(np.int64)))
        whole = pa.array(np.array([0, n], np.int32))
        return _rows(1, DOCS, self.number, doc_ids=pa.ListArray.from_arrays(whole, pa.array(self.ids)), offsets=pa.ListArray.from_arrays(whole, offsets))


def chunks(batches: Iterator[pa.RecordBatch], number: int) -> Iterator[Chunk]:
    """The chunks of a task's (doc_id, text) batches, numbered from `number` on."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            text = text.decode(errors="replace")
            if texts and size + len(text) > CHUNK:
                yield Chunk(number, ids, texts)
                ids, texts, size, number = [], [], 0, number + 1
            ids.append(doc)
            texts.append(text)
            size += len(text) + 1
    if texts:
        yield Chunk(number, ids, texts)


def gram_rows(docs: DataFrame, ci: bool) -> DataFrame:
    """Rows of SCHEMA: postings of kind PLAIN (and FOLDED), followers and chunks.  Chunks are
    numbered by their task, so a task that runs again numbers them alike."""

    def run(batches: Iterator[pa.RecordBatch]):
        for chunk in chunks(batches, TaskContext.get().partitionId() << 24):
            for made in (chunk.documents(), chunk.postings(PLAIN), chunk.postings(FOLDED) if ci else None, chunk.followers()):
                if made is not None:
                    yield made

    return docs.where("text is not null").select("doc_id", "text").mapInArrow(run, SCHEMA)


def with_offsets(docs: DataFrame) -> DataFrame:
    """doc_id, path, line_number, line and byte_offset, the byte at which the line starts in
    its text: a running sum inside each document's row, so nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for doc, path, text in zip(*[c.to_pylist() for c in (batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()))], strict=True):
                parts = text.split(b"\n")
                if not parts[-1]:
                    parts.pop()
                if parts:
                    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
                    n = len(parts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc] * n, pa.int64()), pa.array([path] * n, pa.string()), pa.array(np.arange(1, n + 1)), pa.array(parts, pa.binary()).cast(pa.string()), pa.array(np.cumsum(sizes) - sizes)],
                        names=["doc_id", "path", "line_number", "line", "byte_offset"],
                    )

    return docs.where("text is not null").select("doc_id", "path", F.col("text")).mapInArrow(run, "doc_id long, path string, line_number long, line string, byte_offset long")
