"""Benchmark decontamination by Wu-Manber search over words.

Each item gives its windows of ten consecutive words, or one window of all its words if
it has fewer.  Windows of one length form a searcher: a shift table, keyed by the hash
of a block of two words, tells how far the scan may skip; where it may not, the suffix
block's hash bucket selects windows, and comparing all their words confirms.  All
segments of a batch step through the tables in lockstep as numpy arrays.

Words are runs of ASCII letters and digits and of non-ASCII characters, after A-Z is
lower-cased.  Words of no item share one id that no window holds, so comparing ids is
comparing words.

The benchmark is the query set: it is read in blocks of at most `block_bytes` of text,
each block is broadcast on its own, and each batch of documents is searched for every
block in turn, so that neither the driver's table nor a worker's grows with it.

Defined results: null and empty texts (of either side) have no words and no windows;
items with equal windows all count; a null item_id is left out; repeated documents each
get a row.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import append_columns, text_bytes

WINDOW = 10
BLOCK_BYTES = 4 << 20
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Words of a segment: long documents are cut into overlapping ones, so that no lane is long.
_SEGMENT = 1024


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


class Searcher:
    """Wu-Manber tables for windows of one length."""

    def __init__(self, windows: np.ndarray):
        """windows: a row of word ids (1 up) for each different window."""
        self.windows, self.m = windows, windows.shape[1]
        self.block = min(2, self.m)
        self.bits = min(22, max(12, int(8 * windows.size).bit_length()))
        self.most = self.m - self.block + 1
        self.shift = np.full(1 << self.bits, self.most, np.int8 if self.most < 128 else np.int64)
        for j in range(self.block, self.m + 1):
            np.minimum.at(self.shift, self._hash(windows[:, j - self.block : j]), self.m - j)
        suffix = self._hash(windows[:, self.m - self.block :])
        self.order = np.argsort(suffix, kind="stable")
        self.first = np.searchsorted(suffix[self.order], np.arange((1 << self.bits) + 1))

    def _hash(self, block: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = block[:, 0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            if self.block == 2:
                x = (x ^ (x >> np.uint64(29)) ^ block[:, 1].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            return (x >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, ids: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, window) of each occurrence in any of the segments [start, stop)."""
        places, found = [], []
        at, stop = start.copy(), stop - self.m  # where the window begins, and the last such place
        back = np.arange(self.m - self.block, self.m)
        live = at <= stop
        at, stop = at[live], stop[live]
        while len(at):
            key = self._hash(ids[at[:, None] + back])
            step = self.shift[key].astype(np.int64)
            halt = step == 0
            if halt.any():
                here, bucket = at[halt], key[halt]
                a, n = self.first[bucket], self.first[bucket + 1] - self.first[bucket]
                here = np.repeat(here, n)
                which = self.order[np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                for k in range(self.m):  # direct comparison, word by word
                    same = ids[here + k] == self.windows[which, k]
                    here, which = here[same], which[same]
                places.append(here)
                found.append(which)
                step[halt] = 1
            at = at + step
            live = at <= stop
            at, stop = at[live], stop[live]
        return (np.concatenate(places), np.concatenate(found)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Patterns:
    """A block of items: its words, its windows by length, and the items of each window."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.word: dict[bytes, int] = {}
        grams: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            ids = [self.word.setdefault(w, len(self.word) + 1) for w in words_of(text)]
            m = min(window, len(ids))
            for i in range(len(ids) - m + 1 if m else 0):
                grams[m][tuple(ids[i : i + m])].add(item)
        self.sets = [(Searcher(np.array(list(g), np.int64)), [sorted(s) for s in g.values()]) for g in grams.values()]

    def hits(self, words: list[bytes], sizes: np.ndarray) -> list[tuple[np.ndarray, int, np.ndarray, list]]:
        """For each window length: positions, the length, windows, and the windows' items."""
        ids = np.fromiter(map(self.word.get, words, _zeros()), np.int64, len(words))
        ends = np.cumsum(sizes)
        cuts = -(-sizes // _SEGMENT)
        first = np.repeat(ends - sizes, cuts) + _SEGMENT * (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts))
        last = np.repeat(ends, cuts)
        out = []
        for searcher, items in self.sets:
            # a segment holds the windows that begin in it
            at, which = searcher.search(ids, first, np.minimum(first + _SEGMENT + searcher.m - 1, last))
            if len(at):
                out.append((at, searcher.m, which, items))
        return out


def _zeros():
    while True:
        yield 0


def read_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list[list[tuple[str, bytes]]]:
    """The items in blocks of at most about `block_bytes` of text (a longer item is a block)."""
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text")).where("item is not null and text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total <= block_bytes:
        return [[(r[0], r[1].encode()) for r in items.collect()]]
    blocks = -(-2 * total // block_bytes)
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    sums = dealt.groupBy("block").agg(F.sum(F.octet_length("text")).alias("n")).orderBy("block").collect()
    return [[(r[0], r[1].encode()) for r in dealt.where(F.col("block") == b).select("item", "text").collect()] for b, _ in sums]


def mark_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, keep: list[str] | None = None, with_spans: bool = False, clean_only: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`keep` (default: all columns) with n_words, n_hit, n_items, items_sha256 and
    contaminated; with_spans adds hit_words, the positions of the words hit;
    clean_only leaves the contaminated rows out and adds no columns."""
    context = docs.sparkSession.sparkContext
    sent = [context.broadcast(b) for b in read_blocks(benchmark, item_col, item_text_col, block_bytes)]

    def kernel():
        kept: dict[int, Patterns] = {}

        def patterns(k: int) -> Patterns:
            if k not in kept:
                kept.clear()  # one block's tables at a time
                kept[k] = Patterns(sent[k].value, window)
            return kept[k]

        def run(column):
            split = [words_of(t) for t in text_bytes(column)]
            sizes = np.fromiter(map(len, split), np.int64, len(split))
            words = [w for s in split for w in s]
            ends = np.cumsum(sizes)
            hit, items = np.zeros(len(words) + 1, np.int64), [set() for _ in split]
            for k in range(len(sent)):
                for at, m, which, of in patterns(k).hits(words, sizes):
                    np.add.at(hit, at, 1)
                    np.add.at(hit, at + m, -1)
                    pairs = np.unique(np.searchsorted(ends, at, side="right") * len(of) + which)
                    for p in pairs.tolist():
                        items[p // len(of)].update(of[p % len(of)])
            covered = np.concatenate(([0], np.cumsum(np.cumsum(hit[:-1]) > 0)))
            n_hit = covered[ends] - covered[ends - sizes]
            sha = [hashlib.sha256(",".join(sorted(s)).encode()).hexdigest() for s in items]
            made = [sizes, n_hit, [len(s) for s in items], sha, n_hit > 0]
            if with_spans:
                made.append([np.flatnonzero(np.diff(covered[e - n : e + 1])) if h else np.zeros(0, np.int64) for e, n, h in zip(ends, sizes, n_hit, strict=True)])
            return made

        return run

    kinds = {"n_words": T.LongType(), "n_hit": T.LongType(), "n_items": T.LongType(), "items_sha256": T.StringType(), "contaminated": T.BooleanType()} | ({"hit_words": T.ArrayType(T.LongType())} if with_spans else {})
    where = (lambda made: ~np.asarray(made[4])) if clean_only else None
    return append_columns(docs, text_col, T.StructType([T.StructField(k, v) for k, v in kinds.items()]), kernel, keep, where, clean_only)
