"""Byte-pair merging of many short sequences at once.

Sequences live in one flat symbol array with row starts.  In each round every
sequence applies its own lowest-ranked pair, at all of its places unless a pair of lower
rank would come between them; all sequences step together, and those without a mergeable
pair leave the arrays.  So rounds are as many as a sequence's different merges, however
long it is.
"""

from __future__ import annotations

import numpy as np

_NONE = np.int64(1) << 62


class PairTable:
    """(left, right) -> rank and merged symbol, in an open-addressed numpy table."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        self.bits = max(8, int(len(key) * 4).bit_length())
        size = 1 << self.bits
        self.key = np.full(size, -1, np.int64)
        self.rank = np.full(size, _NONE, np.int64)
        self.merged = np.zeros(size, np.int64)
        slot, todo, self.probes = self._slot(key), np.arange(len(key)), 0
        while len(todo):
            at = slot[todo]
            free = self.key[at] == -1
            self.key[at[free]] = key[todo[free]]  # of several in one slot, the last one written stays
            won = self.key[at] == key[todo]
            self.rank[at[won]], self.merged[at[won]] = rank[todo[won]], merged[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & (size - 1)
            self.probes += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (_NONE without one) and merged symbol of each pair."""
        key = (left << 32) | right
        slot = self._slot(key)
        got = self.key[slot]
        rank, merged = np.where(got == key, self.rank[slot], _NONE), self.merged[slot]
        todo = np.flatnonzero((got != key) & (got != -1))
        for _ in range(self.probes - 1):
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) & (len(self.key) - 1)
            got = self.key[slot[todo]]
            hit = got == key[todo]
            rank[todo[hit]], merged[todo[hit]] = self.rank[slot[todo[hit]]], self.merged[slot[todo[hit]]]
            todo = todo[~hit & (got != -1)]
        return rank, merged


def _chosen(rank: np.ndarray, low: np.ndarray, size: np.ndarray, s: np.ndarray, made: np.ndarray, table: PairTable) -> np.ndarray:
    """Where pairs merge in this round: in each sequence all places of its lowest rank, every
    second one of those that adjoin, or only the leftmost one where a merged symbol would
    make a pair of a lower rank, which must come first."""
    hit = np.flatnonzero(rank == np.repeat(low, size))
    run = np.concatenate(([True], hit[1:] != hit[:-1] + 1))  # neighbouring places overlap
    first = np.flatnonzero(run)
    hit = hit[(np.arange(len(hit)) - np.repeat(first, np.diff(np.concatenate((first, [len(hit)]))))) % 2 == 0]
    row = np.repeat(np.arange(len(size)), size)
    of = row[hit]
    lead = np.concatenate(([True], of[1:] != of[:-1]))
    if lead.all():
        return hit
    # the pairs that a merged symbol makes with what is beside it, before the next place merges and after
    after = np.concatenate((hit[1:] == hit[:-1] + 2, [False])) & np.concatenate((of[1:] == of[:-1], [False]))
    begin = np.cumsum(size) - size
    last = begin[of] + size[of] - 1
    right = np.flatnonzero(hit + 2 <= last)
    both = np.flatnonzero(after)
    left = np.flatnonzero((hit > begin[of]) & ~np.concatenate(([False], after[:-1])))
    lower = np.zeros(len(size), bool)
    for a, b, seq in ((made[hit[right]], s[hit[right] + 2], of[right]), (made[hit[both]], made[hit[both] + 2], of[both]), (s[hit[left] - 1], made[hit[left]], of[left])):
        lower[seq[table.find(a, b)[0] < low[seq]]] = True
    return hit[lead | ~lower[of]]


def merge_all(symbols: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merged symbols, flat, in the sequences' order, and the length of each sequence."""
    rows = len(lengths)
    out_len = np.zeros(rows, np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []  # (row of each symbol, symbol)
    s, q = symbols.astype(np.int64), np.repeat(np.arange(rows), lengths)
    alive = np.flatnonzero(lengths > 0)
    size = lengths[alive].astype(np.int64)
    rank, made = np.full(len(s), _NONE), np.zeros(len(s), np.int64)
    inner = np.flatnonzero(q[:-1] == q[1:]) if len(s) else np.zeros(0, np.int64)
    rank[inner], made[inner] = table.find(s[inner], s[inner + 1])
    while len(alive):
        first = np.cumsum(size) - size
        low = np.minimum.reduceat(rank, first)
        going = low < _NONE
        if not going.all():
            stay = np.repeat(~going, size)
            out_len[alive[~going]] = size[~going]
            done.append((q[stay], s[stay]))
            s, q, rank, made = s[~stay], q[~stay], rank[~stay], made[~stay]
            alive, size, low = alive[going], size[going], low[going]
            if not len(alive):
                break
        hits = _chosen(rank, low, size, s, made, table)
        merged = np.bincount(np.repeat(np.arange(len(size)), size)[hits], minlength=len(size))
        s[hits] = made[hits]
        keep = np.ones(len(s), bool)
        keep[hits + 1] = False
        s, q, rank, made = s[keep], q[keep], rank[keep], made[keep]
        at = hits - np.arange(len(hits))
        size = size - merged
        rank[at] = _NONE
        changed = np.concatenate((at, at[at > 0] - 1))
        changed = changed[changed < len(s) - 1]
        beside = q[changed] == q[changed + 1]
        changed = changed[beside]
        rank[changed], made[changed] = table.find(s[changed], s[changed + 1])
    if not done:
        return np.zeros(0, np.int64), out_len
    rows_of, syms = np.concatenate([a for a, _ in done]), np.concatenate([b for _, b in done])
    return syms[np.argsort(rows_of, kind="stable")], out_len
