"""Toxicity by a linear classifier over character n-grams (3 to 8) scaled by naive Bayes
log-count ratios.

A feature is an n-gram's presence times log((p / |p|) / (q / |q|)), p and q being its
smoothed counts in toxic and other training texts.  Logistic regression with a ridge is
fitted on these; class weights restore the share that each class has in all labelled
rows, so a score is a probability.

The model is fitted on a bounded sample: `per_label` rows of either label, none over
`most_bytes`; near copies in it count once; the features are
the `WIDTH` n-grams whose counts speak most clearly.

Defined results: null and empty texts have no n-grams and get the score of the intercept;
without training rows of both labels every score is the share of toxic ones (0 without
any); repeated and null ids are rows like others.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import append_columns, flat
from .ngrams import CHUNK, ROW, SLOTS, distinct_slots, present, training_rows
from .wordhash import chunks

ORDERS = range(3, 9)
WIDTH = 4096
RIDGE = 1e-3
#: Features must be at least this share as clear as the clearest.
CLEAR = 0.2
THRESHOLD = 0.3
STEPS = 400


_MINHASH = np.random.default_rng(9).integers(1, 2**62, 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def copy_keys(slots: np.ndarray, label: int) -> set[tuple]:
    """Keys that near copies of one label share: minhashes of a text's n-grams in threes."""
    with np.errstate(over="ignore"):
        low = [int(((slots.astype(np.uint64) + np.uint64(1)) * m).min()) if len(slots) else 0 for m in _MINHASH]
    return {(label, k, *low[k : k + 3]) for k in range(0, len(low), 3)}


class ToxicityModel:
    """rows: (text, label); shares: how many rows of labels 0 and 1 the sample stands for."""

    def __init__(self, rows: list[tuple[bytes, int]], shares: tuple[float, float], width: int = WIDTH, ridge: float = RIDGE):
        total = sum(shares)
        prior = shares[1] / total if total else 0.0
        self.known, self.weights, self.bias = np.zeros(0, np.int32), np.zeros(0), -30.0 if prior <= 0 else float(np.log(prior / max(1 - prior, 1e-9)))
        y = np.array([label for _, label in rows], np.int64)
        if len(set(y.tolist())) < 2:
            return
        counts = np.zeros((2, SLOTS), np.int32)
        seen: set[tuple] = set()
        alone = []
        for i, (text, label) in enumerate(rows):  # what a text says counts once, however often it was copied
            slots = distinct_slots(text, ORDERS)
            keys = copy_keys(slots, label)
            if not keys & seen:
                alone.append(i)
                counts[label][slots] += 1
            seen |= keys
        y, rows = y[alone], [rows[i] for i in alone]
        n = np.bincount(y, minlength=2)
        p, q = counts[1] + 1.0, counts[0] + 1.0
        ratio = np.log((p / p.sum()) / (q / q.sum()))
        pooled = (counts[0] + counts[1]) / n.sum()
        spread = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-9) * (1 / n[0] + 1 / n[1]))
        clear = np.where((counts[0] + counts[1] >= 4) & (pooled < 1), np.abs(counts[1] / n[1] - counts[0] / n[0]) / spread, 0)
        known = np.argsort(-clear, kind="stable")[:width]
        self.known = np.sort(known[clear[known] > max(0, CLEAR * clear[known[0]])]).astype(np.int32)
        columns, scale = self.columns(), ratio[self.known]
        cols = [c[c >= 0] for c in (columns[distinct_slots(text, ORDERS)] for text, _ in rows)]  # made again: memory stays small
        sizes, flat_cols = np.array([len(c) for c in cols]), np.concatenate(cols).astype(np.int64)
        row = np.repeat(np.arange(len(rows)), sizes)
        value = scale[flat_cols]
        weight = np.where(y == 1, prior / n[1], (1 - prior) / n[0])

        def times(w):
            return np.bincount(row, value * w[flat_cols], len(rows))

        def back(g):
            return np.bincount(flat_cols, value * g[row], len(self.known))

        v = np.ones(len(self.known))
        for _ in range(20):  # the largest curvature, by power iteration
            v = back(weight * times(v))
            norm = np.linalg.norm(v)
            v /= max(norm, 1e-12)
        step = 1 / (0.25 * norm + 0.25 + ridge)
        w = ahead = np.zeros(len(self.known))
        b = b_ahead = self.bias
        for t in range(STEPS):  # accelerated gradient steps
            g = weight * (1 / (1 + np.exp(-np.clip(times(ahead) + b_ahead, -30, 30))) - y)
            w1, b1 = ahead - step * (back(g) + ridge * ahead), b_ahead - step * g.sum()
            ahead, b_ahead = w1 + t / (t + 3) * (w1 - w), b1 + t / (t + 3) * (b1 - b)
            w, b = w1, b1
        self.weights, self.bias = w * scale, float(b)

    def columns(self) -> np.ndarray:
        out = np.full(SLOTS, -1, np.int16)
        out[self.known] = np.arange(len(self.known))
        return out

    def score(self, body: np.ndarray, ends: np.ndarray, columns: np.ndarray) -> np.ndarray:
        total = np.full(len(ends), self.bias)
        if len(self.known):
            row, col = present(body, ends, ORDERS, columns)
            total += np.bincount(row, self.weights[col], len(ends))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(rows: DataFrame, per_label: int = 2000, most_bytes: int = 50_000) -> ToxicityModel:
    """rows: (id, text, label) with labels 0 and 1; other labels are left out."""
    rows = rows.where("label in (0, 1)")
    sample, count = training_rows(rows, per_label, 2 * per_label, most_bytes)
    return ToxicityModel(sample, (count.get(0, 0), count.get(1, 0)))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None, clean_only: bool = False) -> DataFrame:
    """`keep` (default: all columns) with score and predicted (1 if score >= threshold);
    clean_only leaves rows of predicted 1 out and adds no columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most WIDTH weights

    def kernel():
        m = sent.value
        columns = m.columns()

        def run(column):
            body, at = flat(column.fill_null(""))
            scores = np.concatenate([m.score(body[at[a] : at[b]], at[a + 1 : b + 1] - at[a], columns) for a, b in chunks(at, CHUNK, ROW)])
            return scores, (scores >= threshold).astype(np.int32)

        return run

    added = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    clean = (lambda made: np.asarray(made[1]) == 0) if clean_only else None
    return append_columns(docs, text_col, added, kernel, keep, clean, clean_only)


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, text, label) of the documents that have a label; the label table is joined as it is."""
    marks = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label")).where("id is not null and label is not null").dropDuplicates(["id"])
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(marks, "id")
