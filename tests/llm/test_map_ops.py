"""op1, op2, op7, op8 and op9 against brute force on small tables."""

import hashlib
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import bpe, decontam, licenses, media, packing
from siftwell.llm import queries as Q
from siftwell.llm.token_counts import count_tokens, counter
from siftwell.llm.word_ids import encoder

ODD = [None, "", " ", "  a  b ", "\n\n", "a" * 700, " " * 500, "word\n word", "▁x ▁", "é① 한국어 😀", "<s>x</s> <|endoftext|>", "İstanbul ΣΑΣ don't it's", "x" * 3 + "\t\x0b\x0c\r" + "y", "é   a\u0085b", "MIT License mit license", "the quick brown fox " * 800]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "clash") for i, t in enumerate(ODD)] + [(3, ODD[3], "again"), (None, "no id", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string").repartition(3).cache()


@pytest.fixture(scope="module")
def texts(spark, data):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}


def test_op1_equals_sentencepiece(spark, data, texts, odd):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=Q.vocabulary(Q.PIECES))
    for r in Q.op1_token_counts(spark, data).collect():
        t = texts[r.doc_id]
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(sp.encode(t)))
        assert r.over_limit == (r.n_tokens > 4096)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_words) for r in count_tokens(odd, Q.vocabulary(Q.PIECES)).collect())
    want = sorted((r.doc_id is None, r.doc_id or 0, len(sp.encode(r.text or "")), r.n_words) for r in odd.collect())
    assert got == want


def one_by_one(symbols, pairs):
    """Always the lowest-ranked pair, the leftmost one of equals. pairs: (a, b) -> (rank, merged)."""
    s = list(symbols)
    while known := [(pairs[x][0], i) for i, x in enumerate(zip(s, s[1:])) if x in pairs]:
        _, i = min(known)
        s[i : i + 2] = [pairs[s[i], s[i + 1]][1]]
    return s


def test_op1_merges_at_all_places_as_one_by_one():
    rng = np.random.default_rng(6)
    for _ in range(60):
        n, pairs = 4, {}
        for rank in rng.permutation(25).tolist():
            a, b = (int(x) for x in rng.integers(0, n, 2))
            if (a, b) not in pairs:
                pairs[a, b], n = (rank, n), n + 1
        table = bpe.PairTable(*np.array([(a, b, r, m) for (a, b), (r, m) in pairs.items()]).T)
        many = [rng.integers(0, rng.integers(1, 5), rng.integers(0, 60)).tolist() for _ in range(20)]
        got, sizes = bpe.merge_all(np.array([x for s in many for x in s], np.int64), np.array([len(s) for s in many]), table)
        want = [one_by_one(s, pairs) for s in many]
        assert sizes.tolist() == [len(w) for w in want] and got.tolist() == [x for w in want for x in w]


def test_op1_long_words():
    import sentencepiece

    path = Q.vocabulary(Q.PIECES)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    long = ["ab" * 192, "thethe" * 100, "a" * 5000, "▁" * 400 + "x", "a" * 200_000, "xyzzy" * 20_000, "ab" * 3 + "q" * 70_001]
    assert counter(path).counts(long) == [len(sp.encode(t)) for t in long]


def plain_words(text, pattern=r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_op2_base_against_brute_force(spark, data, texts, odd):
    def brute(text):
        words, hits = plain_words(text), []
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            hits += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        at = [i for i, _ in hits]
        return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({b for _, b in hits}))

    for rows, of in ((Q.op2_license_scan(spark, data), lambda r: texts[r.doc_id]), (licenses.scan_licenses(odd), lambda r: r.text)):
        for r in rows.collect():
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(of(r))
            assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
            assert 0 <= r.score <= 1


def test_op2_expressions():
    assert licenses.postfix("MIT or Apache-2.0 and GPL-2.0 with Classpath-exception-2.0") == ["MIT", "Apache-2.0", "GPL-2.0", "Classpath-exception-2.0", "with", "and", "or"]
    assert licenses.postfix("(MIT OR GPL-3.0) AND BSD-3-Clause") == ["MIT", "GPL-3.0", "or", "BSD-3-Clause", "and"]
    assert licenses.postfix("MIT OR") is None and licenses.postfix("(MIT") is None and licenses.postfix("") is None
    assert licenses.evaluate("GPL-3.0 OR MIT") == ({"gpl", "mit"}, 1.0)
    assert licenses.evaluate("GPL-3.0 AND MIT") == ({"gpl", "mit"}, 0.4)
    assert licenses.evaluate("GPL-2.0+ WITH Classpath-exception-2.0")[1] == pytest.approx(0.5)
    n = licenses.scan(b"# SPDX-License-Identifier: (LGPL-2.1 OR Apache-2.0)\nx", licenses.automaton())
    assert n[4:] == ("", "apache,lgpl", 0.9)


def test_op2_reads_every_tag_whole():
    def found(text):
        return licenses.scan(text.encode(), licenses.automaton())[5:]

    assert found("SPDX-License-Identifier: MIT for the code. SPDX-License-Identifier: GPL-3.0-only for the docs.") == ("gpl,mit", 0.4)
    assert found("a.c License: MIT b.c License: CC-BY-NC-4.0") == ("cc-by-nc,mit", 0.1)
    assert found('x = {license: "MIT", y: 1, licence="GPL-2.0"}') == ("gpl,mit", 0.4)
    assert found("SPDX-License-Identifier: Zlib") == ("zlib", licenses.UNKNOWN_FREEDOM) and found("License: MIT/Apache-2.0") == ("apache,mit", 1.0)
    assert found("License: MIT OR License: ISC\nMPL-2.0") == ("isc,mit", 1.0)
    assert found("License: " + "MIT AND " * 200 + "GPL-2.0") == ("gpl,mit", 0.4)
    assert found("License: " + " AND ".join(f"X{i}" for i in range(50000)) + " AND MIT")[1] == licenses.UNKNOWN_FREEDOM


def brute_labels(text):
    """Labels and score from phrases found word by word and tags found in the raw text."""
    words, hits = plain_words(text), []
    for phrase, label in {**licenses.NOTICES, **licenses.BASE}.items():
        p = phrase.split()
        hits += [(i, i + len(p), label, phrase in licenses.BASE) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    base = {h[2] for h in hits if h[3]}
    stated = {h[2] for h in hits if not any(a <= h[0] and h[1] <= b and b - a > h[1] - h[0] for a, b, _, _ in hits)}
    labels, scores = base | stated, [licenses.FREEDOM[x] for x in stated]
    heads = list(re.finditer(r"(?i)(?:spdx-license-identifier|(?<![a-z0-9\x80-\U0010ffff])licen[sc]e)[ \t]*[:=][ \t]*[\"']?", text or ""))
    for m, stop in zip(heads, [h.start() for h in heads[1:]] + [len(text or "")]):
        kept = []
        for t in re.findall(r"[()/\"'\n\r]|[A-Za-z0-9][A-Za-z0-9.+-]*", text[m.end() : stop]):
            joins = t == "/" or t.lower() in ("and", "or", "with")
            if t in "\"'\n\r" or not (t in "()" or joins or not kept or kept[-1] in "(/" or kept[-1].lower() in ("and", "or", "with")):
                break
            kept.append(t)
        names, free = licenses.evaluate(" ".join(kept).rstrip(".")) if kept else (set(), 0)
        labels |= names
        scores += [free] * bool(names)
    return ",".join(sorted(labels)), min(scores, default=0.0)


def test_op2_labels_and_score_against_brute_force(spark, data, texts):
    for r in Q.op2_license_scan(spark, data).collect():
        assert (r.labels, r.score) == brute_labels(texts[r.doc_id]), texts[r.doc_id]
    for text in ("lesser general public license", "my_license: MIT", "under CC-BY-NC license=isc, mit license", "general public license lesser general public license"):
        assert licenses.scan(text.encode(), licenses.automaton())[5:] == brute_labels(text)
    assert licenses.scan(b"the lesser general public license", licenses.automaton())[4:] == ("gpl", "gpl,lgpl", 0.5)


def test_op7_against_brute_force(spark, data, texts, odd):
    def brute(text, items):
        words, hit, of = plain_words(text), set(), set()
        for item, item_text in items:
            w = plain_words(item_text)
            m = min(10, len(w))
            windows = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()
            for i in range(len(words) - m + 1 if m else 0):
                if tuple(words[i : i + m]) in windows:
                    hit |= set(range(i, i + m))
                    of.add(str(item))
        return len(words), len(hit), len(of), hashlib.sha256(",".join(sorted(of)).encode()).hexdigest(), bool(hit)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    got = Q.op7_decontamination(spark, data).collect()
    assert sum(r.contaminated for r in got) > 0
    for r in got:
        assert tuple(r)[1:] == brute(texts[r.doc_id], items)
    items = [(1, "the quick brown"), (2, None), (3, ""), (10, "fox THE quick brown fox the quick brown fox the quick brown"), (9, "word"), (9, "word"), (None, "a"), (4, "LICENSE mit")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 8):
        for r in decontam.mark_contamination(odd, bench, with_spans=True, block_bytes=block).collect():
            want = brute(r.text, [x for x in items if x[0] is not None])
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want
            assert len(r.hit_words) == r.n_hit
    empty = decontam.mark_contamination(odd, bench.limit(0)).collect()
    assert len(empty) == odd.count() and not any(r.contaminated for r in empty)


def test_op8_pieces_rebuild_the_ids(spark, data, texts, odd):
    from tokenizers import Tokenizer

    path = Q.vocabulary(Q.WORDS)
    library = Tokenizer.from_file(path)
    for rows, docs in ((Q.op8_packing(spark, data).collect(), [(k, t) for k, t in texts.items()]), (packing.pack(odd.where("text <> 'again'").dropDuplicates(["doc_id"]), path).collect(), None)):
        if docs is None:
            docs = [(r.doc_id, r.text) for r in odd.where("text <> 'again'").dropDuplicates(["doc_id"]).collect()]
        pieces, sequences = defaultdict(list), defaultdict(list)
        for r in rows:
            pieces[r.doc_id].append(r)
            sequences[r.sequence_id].append(r)
        for doc, text in docs:
            ids, at = [*library.encode(text or "", add_special_tokens=False).ids, 1], 0
            for r in sorted(pieces.pop(doc), key=lambda r: r.start):
                assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
                assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length]))
                at += r.length
            assert at == len(ids)
        assert not pieces
        for rows_of in sequences.values():
            at = 0
            for r in sorted(rows_of, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= 2048 and (at & (at - 1) == 0)


def test_op8_encoder_equals_the_library(texts):
    enc = encoder(Q.vocabulary(Q.WORDS))
    many = [t for t in ODD if t] + list(texts.values())[:60]
    want = [struct.pack(f"<{len(i)}I", *i) for i in (e.ids for e in enc.library.encode_batch(many, add_special_tokens=False))]
    assert enc.encode([t.encode() for t in many]) == want


def test_op8_sum_of_squares_rule():
    import random

    rng, packer, counts = random.Random(5), packing.Packer(0, 16, levels=16, cut=None), defaultdict(int)
    for i in range(300):
        r = rng.randint(1, 15)
        fills = [h for h, n in counts.items() if n and h + r <= 16] + [0]

        def after(h):
            c = dict(counts)
            if h:
                c[h] -= 1
            if h + r < 16:
                c[h + r] = c.get(h + r, 0) + 1
            return sum(v * v for v in c.values())

        best = min(after(h) for h in fills)
        before = {h: len(w) for h, w in enumerate(packer.levels) if w}
        packer.add(i, b"\0\0\0\0" * r)
        now = {h: len(w) for h, w in enumerate(packer.levels) if w}
        assert sum(v * v for v in now.values()) == best, (before, now)
        counts = defaultdict(int, now)


def test_op8_cuts_by_the_rule():
    import random

    rng, packer = random.Random(5), packing.Packer(0)
    for i in range(3000):
        packer.add(i, bytes(4 * min(5000, int(rng.lognormvariate(6, 1)) + 1)))
        assert packer.open <= 2 * packing.LEVELS
        if i == 299:
            given = sum(r[2] for r in packer.rows)
            held = sum(w[0] for level in packer.levels for w in level)
            assert given >= 0.9 * (given + held)
    packer.flush()
    sizes = defaultdict(int)
    for r in packer.rows:
        sizes[r[5]] += r[2]
    assert sum(n < 2048 for n in sizes.values()) <= 11 and max(sizes.values()) == 2048


def test_op9_round_trip(spark, data, texts, odd):
    for rows, of in ((Q.op9_media_columns(spark, data), lambda r: texts[r.doc_id]), (media.store_texts(odd), lambda r: r.text)):
        for r in rows.collect():
            raw = (of(r) or "").encode()
            padded = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
            assert r.media_bytes == len(media.store(raw)) and r.media_sha256 == hashlib.sha256(media.store(raw)).hexdigest()


def test_op9_sniffs_and_carves(spark):
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", zlib.compress(b"x")) + chunk(b"IEND", b"")
    bmp = b"BM" + struct.pack("<IIIIiiHHIIIIII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + bytes(4)
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + bytes(8) + b"\0\x02\x02\x4c\x01\0\x3b"
    rows = [(1, png, "image/jpeg"), (2, media.store(b"hello " + gif + b" RIFF GIF8 BM "), "text/plain"), (3, b"RIFF1234WAVE", "audio/mpeg"), (4, None, "x/y"), (5, b"", None), (6, b"zz" + png + gif, "a/b"), (7, bmp, "a/b"), (8, png[:-1], "a/b")]
    got = {r.k: (r.media_type, [(m.kind, m.start, m.length) for m in r.embedded]) for r in media.sniff_media(spark.createDataFrame(rows, "k long, b binary, d string"), "b", "d").collect()}
    assert got == {
        1: ("image/png", []), 2: ("audio/wav", [("image/gif", 50, len(gif))]), 3: ("audio/mpeg", []), 4: ("x/y", []), 5: (None, []),
        6: ("a/b", [("image/png", 2, len(png)), ("image/gif", 2 + len(png), len(gif))]), 7: ("image/bmp", []), 8: ("a/b", []),
    }


def test_names_that_clash(spark):
    """Columns that clash by case with added ones give way; dots and our own helpers' names don't matter."""
    docs = spark.createDataFrame([(1, "mit license", "x", 2, 3, 4)], "`doc_id` long, text string, N_Words string, `a.b` int, `__text` int, c0 int")
    for out in (licenses.scan_licenses(docs), media.store_texts(docs), count_tokens(docs, Q.vocabulary(Q.PIECES)), decontam.mark_contamination(docs, spark.createDataFrame([(1, "mit")], "item_id long, text string"))):
        row = out.first().asDict()
        assert (row["a.b"], row["__text"], row["c0"]) == (2, 3, 4) and len({c.lower() for c in out.columns}) == len(out.columns)


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    path = Q.vocabulary(Q.PIECES)
    for out in (count_tokens(none, path), licenses.scan_licenses(none), media.store_texts(none), packing.pack(none, Q.vocabulary(Q.WORDS))):
        assert out.count() == 0
    assert odd.agg(F.count("*")).first()[0] == len(ODD) + 2
