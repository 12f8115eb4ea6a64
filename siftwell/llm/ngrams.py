"""Hashed character n-grams of many texts at once (characters are UTF-8 bytes, A-Z lower).

An n-gram's slot is a hash of its bytes and its length in a table of SLOTS places; only
slots that a model knows are ever looked at further.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BITS = 21
SLOTS = 1 << BITS
#: How many times the wanted rows are ranked; the chance that fewer come is nil for hundreds.
OVERSAMPLE = 4
_HASHES = 1 << 40
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes handled at once, so that the arrays stay in cache (a longer text comes alone), and
#: what a text counts besides its bytes.
CHUNK, ROW = 1 << 18, 1 << 12


def slots(body: np.ndarray, ends: np.ndarray, orders: range) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n of `orders` (8 at most): the slot of each n-gram inside a text, and where it starts."""
    code = low = _LOWER[body].astype(np.uint64)
    for n in range(1, orders.stop):
        if n > 1:
            code = (code[:-1] << np.uint64(8)) | low[n - 1 :]
        if n not in orders or not len(code):
            continue
        with np.errstate(over="ignore"):
            slot = (((code ^ np.uint64((n * 0xA0761D6478BD642F) % (1 << 64))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32)
        inside = np.ones(len(body) + 1, bool)
        for back in range(1, n):
            inside[np.maximum(ends - back, 0)] = False  # an n-gram from here passes an end
        inside = inside[: len(code)]
        at = np.flatnonzero(inside)
        yield slot[at], at


def present(body: np.ndarray, ends: np.ndarray, orders: range, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, column) of each different known n-gram of each text; `columns` gives a
    slot's column, or -1."""
    rows, cols = [], []
    for slot, at in slots(body, ends, orders):
        col = columns[slot]
        hit = np.flatnonzero(col >= 0)
        rows.append(np.searchsorted(ends, at[hit], side="right"))
        cols.append(col[hit])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = int(columns.max()) + 1
    flags = np.zeros(len(ends) * max(width, 1), bool)
    flags[np.concatenate(rows) * width + np.concatenate(cols)] = True
    found = np.flatnonzero(flags)
    return found // width, found % width


def distinct_slots(text: bytes, orders: range) -> np.ndarray:
    body = np.frombuffer(text, np.uint8)
    got = [s for s, _ in slots(body, np.array([len(body)]), orders)]
    return np.unique(np.concatenate(got)) if got else np.zeros(0, np.int32)


def training_rows(rows: DataFrame, per_label: int, most: int, most_bytes: int) -> tuple[list[tuple[bytes, object]], dict]:
    """(text, label) of at most `most` rows, and how many rows each label has (with a text):
    of each label (the `most` commonest ones) the `per_label` ids with the least hash whose
    texts have at most `most_bytes`. rows: (id, text, label).

    One pass counts labels; another ranks ids below a bounded share of hashes, so what is
    ranked doesn't grow with the table; both leave the texts where they are.  Then the texts
    of the chosen ids, whose number is bounded, are fetched by a broadcast of these ids.  Of
    rows that repeat an id and a label only the one of the least text hash counts, so
    repeated ids can't push others out and any run takes the same rows.
    """
    fit = rows.where(F.col("text").isNotNull() & F.col("label").isNotNull())
    found = fit.groupBy("label").agg(F.count("*").alias("n"), F.approx_count_distinct("id").alias("ids")).orderBy(F.desc("n"), "label").limit(most).collect()
    if not found:
        return [], {}
    counts = {label: n for label, n, _ in found}
    below = F.create_map(*[F.lit(v) for label, _, ids in found for v in (label, min(_HASHES, OVERSAMPLE * per_label * _HASHES // max(ids, 1) + 1))])
    short = fit.where(F.octet_length("text") <= most_bytes)
    hashed = short.select("id", "label", F.pmod(F.xxhash64("id"), F.lit(_HASHES)).alias("at")).where(F.col("at") < below[F.col("label")]).distinct()
    order = Window.partitionBy("label").orderBy("at", "id")
    ranked = hashed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_label)
    chosen = {(r[0], r[1]) for r in ranked.orderBy("rank", "label").limit(most).select("id", "label").collect()}
    ids = rows.sparkSession.createDataFrame([(i,) for i in sorted({i for i, _ in chosen})], rows.select("id").schema)
    texts = short.join(F.broadcast(ids), "id", "left_semi").groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    got = [(r.id, r.text, r.label) for r in texts.collect() if (r.id, r.label) in chosen]
    return [(r[1].encode(), r[2]) for r in sorted(got, key=lambda r: (r[0], str(r[2])))], counts
