"""What workers keep between tasks of the pipeline, and what a task's kernels take."""

import gc
import struct
import tracemalloc
import weakref

import numpy as np
import pyarrow as pa

from siftwell.llm import columns, near_dups, packing, word_ids, wordhash
from siftwell.llm import queries as Q


def test_packing_leaves_no_words_in_workers(spark):
    rows = [(i, " ".join(f"word{i}x{j}" for j in range(50))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert packing.pack(docs, Q.vocabulary(Q.WORDS)).select("doc_id").distinct().count() == 400

    def remembered(batches):
        from siftwell.llm import word_ids

        for _ in batches:
            pass
        yield pa.RecordBatch.from_pydict({"loaded": [len(word_ids._loaded)], "words": [sum(len(e.memory) for e in word_ids._loaded.values())]})

    got = spark.range(0, 8, 1, 4).mapInArrow(remembered, "loaded long, words long").collect()
    assert sum(r.loaded for r in got) > 0  # workers that packed are asked
    assert sum(r.words for r in got) == 0


def test_encoder_with_a_full_memory(monkeypatch):
    monkeypatch.setattr(word_ids, "REMEMBERED", 3)
    texts = [b"one two three", b"two four  five six", b"", b"seven two one eight four", "nine don't é two".encode()]
    with word_ids.encoder(Q.vocabulary(Q.WORDS)) as enc:
        enc.memory.clear()
        want = [struct.pack(f"<{len(i)}I", *i) for i in (e.ids for e in enc.library.encode_batch([t.decode() for t in texts], add_special_tokens=False))]
        assert [enc.encode([t])[0] for t in texts] == want == enc.encode(texts)
        assert len(enc.memory) == 3
    assert not enc.memory


def test_memory_is_released_after_the_last_arrays(monkeypatch):
    class Rows:
        pass

    alive, seen = [], []

    def run(batches):
        for _ in batches:
            rows = Rows()
            alive.append(weakref.ref(rows))
            yield 1

    monkeypatch.setattr(columns, "release", lambda: seen.append([r() for r in alive]))
    assert list(columns.releasing(run)([0, 0])) == [1, 1] and seen == [[None, None]]
    some = columns.releasing(run)([0, 0])
    next(some)
    some.close()
    assert seen[1:] == [[None] * 3]


def test_fingerprints_take_bounded_memory():
    rng = np.random.default_rng(4)
    texts = pa.array([" ".join(map(str, rng.integers(0, 10**6, 3000))) for _ in range(180)])  # 3.7 MB, a slice of them
    run = near_dups._fingerprint_kernel(10)
    wordhash._tables.clear()
    gc.collect()
    tracemalloc.start()
    try:
        names, sizes, _ = run(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(names) == 180 and min(sizes) > 2900
    assert peak < 40e6
