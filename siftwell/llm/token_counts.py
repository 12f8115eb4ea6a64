"""Token counts: what a sentencepiece BPE model would give, without encoding each text.

Texts are cut where no piece of the vocabulary can cross (before a space that follows
something else, around line feeds); each different pre-token is merged once per batch
by `bpe.merge_all`, and its count of surviving symbols is added up over the texts.

Defined results: null and empty texts have 0 bytes and 0 tokens; a text of white space
only has the tokens of its spaces; special strings such as `<s>` are ordinary text.
Repeated rows each get a row.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import PairTable, merge_all
from .columns import append_columns, text_bytes

SPACE = "▁"
#: Pre-tokens remembered in a worker process, over batches.
REMEMBERED = 300_000
_loaded: dict[str, PieceCounter] = {}


class PieceCounter:
    """Counts pieces of texts as the sentencepiece model at `path` does."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        piece = {sp.id_to_piece(i): i for i in ids}
        rank = {p: -round(sp.get_score(i)) for p, i in piece.items()}
        pairs = [(piece[p[:j]], piece[p[j:]], rank[p], i) for p, i in piece.items() for j in range(1, len(p)) if p[:j] in piece and p[j:] in piece]
        self.table = PairTable(*np.array(pairs, np.int64).T)
        inner = [p for p in piece if len(p) > 1]
        if any("\n" in p or re.search(f"[^{SPACE}]{SPACE}", p) for p in inner):
            raise ValueError("pieces of this model cross the places where texts are cut")
        self.symbol = np.full(0x110000, -1, np.int64)
        for p, i in piece.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.unknown = sp.vocab_size()
        self.memory: dict[str, int] = {}
        self.slow = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")

    def count_words(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token: surviving symbols, with an unknown character's bytes."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        known = self.symbol[code]
        symbols = np.where(known >= 0, known, self.unknown)
        _, counts = merge_all(symbols, lengths, self.table)
        extra = np.where(known >= 0, 0, (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF))
        total = np.concatenate(([0], np.cumsum(extra)))
        ends = np.cumsum(lengths)
        return counts + total[ends] - total[ends - lengths]

    def pretokens(self, text: str) -> list[str]:
        """Pre-tokens as keys: one that opens with a line feed is that and a bare word,
        one that opens with the space mark is itself, and any other stands for itself
        after a space mark."""
        if not text:
            return []
        if "  " not in text and " \n" not in text and SPACE not in text and text[0] != " " and text[-1] != " ":
            return text.replace("\n", " \n").split(" ")
        out: list[str] = []
        for x in self.slow.findall(SPACE + text.replace(" ", SPACE)):
            if x[0] in (SPACE, "\n"):
                out.append(x)
            else:  # only a line feed can stand before it
                out[-1] += x
        return out

    def counts(self, texts: list[str]) -> list[int]:
        memory = self.memory
        cut = [self.pretokens(t) for t in texts]
        new = list(set().union(*cut).difference(memory)) if cut else []
        fresh = memory
        if new:
            bare = [x[1:] if x[0:1] == "\n" else x if x[0:1] == SPACE else SPACE + x for x in new]
            got = self.count_words(bare) + np.fromiter((x[0:1] == "\n" for x in new), np.int64, len(new))
            pairs = dict(zip(new, got.tolist(), strict=True))
            if len(memory) + len(pairs) <= REMEMBERED:
                memory.update(pairs)
            else:
                fresh = memory | pairs
        return [sum(map(fresh.__getitem__, c)) for c in cut]


def counter(path: str) -> PieceCounter:
    if path not in _loaded:
        _loaded[path] = PieceCounter(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, model: str, text_col: str = "text", limit: int = 4096, keep: list[str] | None = None) -> DataFrame:
    """`keep` (default: all columns) with n_bytes, n_tokens and over_limit (n_tokens > limit)."""

    def kernel():
        pieces = counter(model)

        def run(column):
            texts = text_bytes(column)
            n = pieces.counts([t.decode() for t in texts])
            return [len(t) for t in texts], n, [x > m for x, m in zip(n, repeat(limit))]

        return run

    added = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return append_columns(docs, text_col, added, kernel, keep)
