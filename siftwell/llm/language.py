"""Language identification by string kernels.

The kernel of two texts counts the n-grams (1 to 4 characters, blended; A-Z as a-z) that
both hold, over the geometric mean of how many each holds, over their full sets.  Nystroem
landmarks stand for the training texts, and kernel ridge regression gives one score per
language against the rest.  A batch of texts is scored by its kernel values against all
landmarks (a matrix product for the n-grams that many landmarks hold, lists for the
others), times the coefficients.

The model is fitted on a bounded sample: `per_label` rows of each language, `most` in all,
none over `most_bytes`; LANDMARKS of them, the languages in turn, are the landmarks.
N-grams are known by 48 bits of a hash.

Defined results: a null text or one without a letter is `und` with score 0; without
training rows all texts are; repeated and null ids are rows like others; a very long text
is scored whole, alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import append_columns, flat
from .ngrams import _LOWER, CHUNK, ROW, training_rows
from .wordhash import chunks, mix

LONGEST = 4
LANDMARKS = 128
RIDGE = 1e-3
UNKNOWN = "und"
#: N-grams that are multiplied as a matrix, the commonest ones of the landmarks.
DENSE = 4096
_HASH = np.uint64((1 << 48) - 1)


def gram_sets(body: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash) of each different n-gram of each text, in order, and how many each has."""
    starts = np.concatenate(([0], ends[:-1]))
    heads = np.concatenate(([0], np.cumsum((body & 0xC0) != 0x80)))  # characters before each byte
    first, last = heads[starts], heads[ends]
    code = np.frombuffer(_LOWER[body].tobytes().decode(errors="replace").encode("utf-32-le"), "<u4").astype(np.uint64)
    text = np.repeat(np.arange(len(ends)), last - first)
    end = last[text] if len(text) else np.zeros(0, np.int64)
    keys, grams = [], np.zeros(len(code), np.uint64)
    at = np.arange(len(code))
    for n in range(1, LONGEST + 1):
        with np.errstate(over="ignore"):
            grams = mix(grams[: len(code) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :] + np.uint64(n << 32))
        inside = at[: len(grams)] + n <= end[: len(grams)]
        keys.append((text[: len(grams)][inside].astype(np.uint64) << np.uint64(48)) | (grams[inside] & _HASH))
        if len(code) <= n:
            break
    key = np.sort(np.concatenate(keys)) if len(code) else np.zeros(0, np.uint64)
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    of = (key >> np.uint64(48)).astype(np.int64)
    return of, key & _HASH, np.bincount(of, minlength=len(ends))


class LanguageModel:
    def __init__(self, rows: list[tuple[bytes, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.labels = sorted({label for _, label in rows})
        if not rows:
            return
        order = self._in_turn(rows)[:landmarks]
        of, gram, self.sizes = self._sets([rows[i][0] for i in order])
        self.grams, column, held = np.unique(gram, return_inverse=True, return_counts=True)
        self.count = len(order)
        rank = np.argsort(-held, kind="stable")
        self.dense_at = np.full(len(self.grams), -1, np.int32)
        self.dense_at[rank[:DENSE]] = np.arange(min(DENSE, len(rank)))
        by = np.argsort(column, kind="stable")  # the landmarks of each n-gram, as lists
        self.lists, self.held = of[by].astype(np.int32), held.astype(np.int32)
        y = np.array([[1.0 if label == of_ else -1.0 for of_ in self.labels] for _, label in rows])
        k_nm = np.concatenate([self.kernel(*self._flat([t])) for t, _ in rows])
        k_mm = k_nm[order]
        self.alpha = np.linalg.solve(k_nm.T @ k_nm + ridge * len(rows) * k_mm + 1e-6 * np.eye(self.count), k_nm.T @ y)

    @staticmethod
    def _flat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])

    def _sets(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got = [gram_sets(*self._flat([t])) for t in texts]
        return np.concatenate([np.full(len(g), i) for i, (_, g, _) in enumerate(got)]), np.concatenate([g for _, g, _ in got]), np.concatenate([n for _, _, n in got])

    @staticmethod
    def _in_turn(rows: list[tuple[bytes, str]]) -> list[int]:
        """Rows in the order in which the languages take turns."""
        seen: dict[str, int] = {}
        rank = []
        for i, (_, label) in enumerate(rows):
            seen[label] = seen.get(label, 0) + 1
            rank.append((seen[label], i))
        return [i for _, i in sorted(rank)]

    def ready(self) -> LanguageModel:
        """With the matrix of the commonest n-grams, which is made anew in each process."""
        first = np.cumsum(self.held) - self.held
        self.first = first
        self.matrix = np.zeros((min(DENSE, len(self.grams)), self.count), np.float32)
        dense = np.repeat(self.dense_at, self.held)
        self.matrix[dense[dense >= 0], self.lists[dense >= 0]] = 1
        return self

    def kernel(self, body: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The kernel of each text with each landmark."""
        if not hasattr(self, "matrix"):
            self.ready()
        of, gram, sizes = gram_sets(body, ends)
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        known = self.grams[at] == gram
        of, at = of[known], at[known]
        column = self.dense_at[at]
        x = np.zeros((len(ends), len(self.matrix)), np.float32)
        x[of[column >= 0], column[column >= 0]] = 1
        common = (x @ self.matrix).astype(np.float64)
        of, at = of[column < 0], at[column < 0]
        n = self.held[at].astype(np.int64)
        pick = np.repeat(self.first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        common += np.bincount(np.repeat(of, n) * self.count + self.lists[pick], minlength=common.size).reshape(common.shape)
        return common / np.sqrt(np.maximum(sizes, 1)[:, None] * np.maximum(self.sizes, 1))

    def score(self, body: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.kernel(body, ends) @ self.alpha


def fit(rows: DataFrame, per_label: int = 400, most: int = 1600, most_bytes: int = 50_000) -> LanguageModel:
    """rows: (id, text, label)."""
    return LanguageModel(training_rows(rows, per_label, most, most_bytes)[0])


def identify_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` (default: all columns) with lang_pred and score (0 to 1)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # the landmarks' n-grams: LANDMARKS texts of at most most_bytes

    def kernel():
        m = sent.value

        def run(column):
            names, scores = [], []
            body, at = flat(column.fill_null(""))
            if not m.labels:
                return [UNKNOWN] * len(column), [0.0] * len(column)
            for a, b in chunks(at, CHUNK, ROW):
                got = m.score(body[at[a] : at[b]], at[a + 1 : b + 1] - at[a])
                best = got.argmax(axis=1)
                names += [m.labels[k] for k in best]
                scores += np.clip((1 + got[np.arange(len(best)), best]) / 2, 0, 1).tolist()
            for i, text in enumerate(column.to_pylist()):
                if not text or not any(map(str.isalpha, text)):
                    names[i], scores[i] = UNKNOWN, 0.0
            return names, scores

        return run

    added = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return append_columns(docs, text_col, added, kernel, keep)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves `fold`; a null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))
