"""op3, op4, op5, op6, op10 and the pipeline against brute force on small tables."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import language, near_dups, ngrams, pii, substrings, toxicity
from siftwell.llm import queries as Q

SPACE = r"[^\x20\x09-\x0D]+"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_groups(rows, percent=85):
    """rows: (doc_id, text) -> sorted (doc_id, n_shingles, component_id, kept)."""
    def shingles(text):
        w = re.findall(SPACE, low(text))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    known = [k for k, (d, _) in enumerate(rows) if d is not None and sets[k]]
    for x, i in enumerate(known):
        for j in known[:x]:
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k in known:
        least[find(k)] = min(least.get(find(k), rows[k][0]), rows[k][0])
    out = []
    for k, (d, _) in enumerate(rows):
        comp = least[find(k)] if k in known else d
        out.append((d, len(sets[k]), comp, True if d is None else d == comp))
    return sorted(out, key=str)


def edited(rng, words, n, pool):
    w = list(words)
    for _ in range(n):
        k = rng.randrange(len(w))
        w[k : k + 1] = [] if rng.random() < 0.3 else [rng.choice(pool)]
    return " ".join(w)


def groups_of(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(map(tuple, near_dups.group_near_duplicates(docs, **how).collect()), key=str)


def test_op3_odd_rows(spark):
    rows = [(1, "a b c d e f"), (2, "A  b\nc d e f"), (3, None), (4, ""), (5, " \t"), (6, "a b"), (7, "a b"), (8, "b a"), (None, "a b c d e f"), (9, "x"), (9, "x"), (10, "é y z"), (11, "É y z")]
    assert groups_of(spark, rows) == brute_groups(rows)
    assert near_dups.group_near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_op3_large_group_of_near_copies(spark, monkeypatch):
    rng = random.Random(3)
    pool = [f"w{i}" for i in range(30)]
    base = [rng.choice(pool) + str(i) for i in range(120)]
    rows = [(i + 1, edited(rng, base, rng.choice([0, 1, 1, 2, 3, 4, 8]), pool)) for i in range(90)] + [(500 + i, " ".join(rng.choice(pool) for _ in range(40))) for i in range(20)]
    rows += [(700 + i, rows[i][1]) for i in range(10)]
    want = brute_groups(rows)
    assert len({r[2] for r in want}) < len(rows) - 30
    assert groups_of(spark, rows) == want
    monkeypatch.setattr(near_dups, "BLOCK_SHINGLES", 1500)  # several blocks
    assert groups_of(spark, rows) == want


def test_op3_drops_all_but_one(spark):
    rows = [(1, "a b c d e f", 0), (2, "a b c d e f", 1), (2, "a b c d e f", 1), (3, "z", 2), (3, "z", 2), (None, "z", 3), (4, None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class int")
    assert sorted(map(tuple, near_dups.drop_near_duplicates(docs).collect()), key=str) == sorted([rows[0], rows[3], rows[5], rows[6]], key=str)


def test_op3_drops_near_copies_under_one_id(spark):
    words = [f"w{i}" for i in range(100)]
    one, near, other = " ".join(words), " ".join([*words[:-1], "z"]), "quite another text under the same id"
    rows = [(5, one), (5, near), (5, one.upper()), (5, other), (5, ""), (6, near), (7, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in near_dups.drop_near_duplicates(docs).collect()]
    assert sum(r[1].lower() in (one, near) for r in got) == 1 and len(got) == 4
    assert {(5, other), (5, ""), (7, "a b c d e f")} < set(got)


def test_op3_misses_little():
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(300):
        a = rng.integers(0, 2**63, 200, dtype=np.uint64)
        b = np.concatenate((a[:184], rng.integers(0, 2**63, 16, dtype=np.uint64)))  # similarity 0.852
        x, y = near_dups.half_keys([np.sort(a), np.sort(b)])
        same = x == y
        missed += not (same[: near_dups.HALF_KEYS].any() and same[near_dups.HALF_KEYS :].any())
    assert missed == 0


def test_pipeline_links_from_80_percent(spark):
    import corpus_pipeline as P

    rng, rows = random.Random(8), []
    for k in range(60):
        words = [f"{rng.choice('abcdef')}{rng.randrange(10**6)}" for _ in range(94)]  # 90 shingles
        other = words[:-9] + [f"z{k}_{i}" for i in range(9)]  # 81 in common of 99: 0.818
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in P.near_dedup(spark, docs, "").collect()) == [2 * k for k in range(60)]
    assert near_dups.group_near_duplicates(docs).where("kept").count() == 120
    assert near_dups.half_key_count(85) == 8 and near_dups.half_key_count(80) == 10


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_its_sql(spark, data, name, tmp_path):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    Q.queries()[name](spark, data).write.parquet(f"{tmp_path}/out")
    db.execute(f"create table ours as select * from '{tmp_path}/out/*.parquet'")
    db.execute(f"create table theirs as {Q.oracle_sql()[name]}")
    cols = ", ".join(sorted(r[0] for r in db.execute("describe ours").fetchall()))
    for a, b in (("ours", "theirs"), ("theirs", "ours")):
        assert db.execute(f"select count(*) from (select {cols} from {a} except all select {cols} from {b})").fetchall() == [(0,)]


def brute_cut(rows, window=50):
    first = {}
    words = [re.findall(SPACE, t or "") for _, t in rows]
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - window + 1 if d is not None else 0):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, d), d)
    out = []
    for (d, _), w in zip(rows, words):
        gone = {k for i in range(len(w) - window + 1 if d is not None else 0) if first[tuple(w[i : i + window])] < d for k in range(i, i + window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_op10_against_brute_force(spark):
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(130)]
    long = [f"q{rng.randrange(5)}" for _ in range(300)]  # repeats in itself
    rows = []
    for i in range(60):
        w = [f"r{rng.randrange(400)}" for _ in range(rng.randrange(0, 160))]
        if i % 2:
            a = rng.randrange(0, 60)
            w[len(w) // 2 : len(w) // 2] = passage[a : a + rng.randrange(40, 71)]
        if i % 7 == 0:
            w += long[rng.randrange(0, 100) :]
        rows.append((i, " ".join(w)))
    rows += [(100 + i, rows[i][1]) for i in range(8)] + [(3, rows[3][1]), (200, None), (201, ""), (None, rows[1][1]), (202, "  " + "\n".join(passage)), (5, " ".join(passage))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r)[:4] for r in substrings.remove_repeated_spans(docs, with_text=True).collect()), key=str)
    assert got == brute_cut(rows)
    assert substrings.remove_repeated_spans(docs.limit(0)).count() == 0


def test_op4_held_out_accuracy(spark, data):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = Q.op4_language_id(spark, data).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.97 * len(held)


def test_op4_odd_rows(spark):
    train = [(i, f"the and of with {i}", "en") for i in range(5)] + [(9 + i, f"der die und mit {i}", "de") for i in range(5)] + [(20, "x", None), (21, None, "en")]
    model = language.fit(spark.createDataFrame(train, "id long, text string, label string"))
    docs = spark.createDataFrame([(1, "of the and", 7), (2, None, 7), (3, "12 !?", 7), (4, "", 7), (None, "und der", 7), (1, "of the and", 7), (5, "the " * 200_000, 7)], "doc_id long, text string, score int")
    got = sorted(((r.doc_id or 0, r.lang_pred) for r in language.identify_languages(docs, model).collect()))
    assert got == [(0, "de"), (1, "en"), (1, "en"), (2, "und"), (3, "und"), (4, "und"), (5, "en")]
    none = language.fit(spark.createDataFrame([], "id long, text string, label string"))
    assert {(r.lang_pred, r.score) for r in language.identify_languages(docs, none).collect()} == {("und", 0.0)}


def test_op4_kernel_against_brute_force():
    rng = random.Random(4)
    texts = ["", "a", "Zoë 😀 abc", "Привет мир", "你好世界 abc"] + ["".join(rng.choice("abcdé 語Q") for _ in range(rng.randrange(1, 90))) for _ in range(40)]

    def grams(t):
        t = low(t)
        return {t[i : i + n] for n in range(1, 5) for i in range(len(t) - n + 1)}

    model = language.LanguageModel([(t.encode(), "xy"[i % 2]) for i, t in enumerate(texts)], landmarks=12)
    marks = [texts[i] for i in model._in_turn([(t.encode(), "xy"[i % 2]) for i, t in enumerate(texts)])[:12]]
    want = [[len(grams(t) & grams(m)) / max(1, len(grams(t))) ** 0.5 / max(1, len(grams(m))) ** 0.5 for m in marks] for t in texts]
    for dense in (language.DENSE, 5):
        language.DENSE, before = dense, language.DENSE
        model = language.LanguageModel([(t.encode(), "xy"[i % 2]) for i, t in enumerate(texts)], landmarks=12)
        got = model.kernel(*model._flat([t.encode() for t in texts]))
        language.DENSE = before
        assert np.allclose(got, want, atol=1e-6)


def test_ngrams_against_brute_force():
    texts = [b"Abcab", b"", b"x", b"hello world, hello"]
    body, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    got = sorted((n, int(at)) for n in range(1, 9) for s, p in ngrams.slots(body, ends, range(n, n + 1)) for at in p)
    starts = ends - [len(t) for t in texts]
    assert got == sorted((n, int(a) + i) for n in range(1, 9) for a, t in zip(starts, texts) for i in range(len(t) - n + 1))
    assert set(ngrams.distinct_slots(b"ABC", range(1, 4))) == set(ngrams.distinct_slots(b"abc", range(1, 4)))


def test_op5_learns_the_labels(spark):
    rng = random.Random(2)
    words = [f"{a}{b}" for a in ("lo", "ra", "mi", "te", "su") for b in ("na", "ke", "vo", "di", "pa", "ru")]
    rows = []
    for i in range(600):
        w = [rng.choice(words) for _ in range(rng.randrange(20, 80))]
        bad = i % 5 == 0
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["grobbel", "zwakkt"])
        rows.append((i, " ".join(w), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(toxicity.labelled(df.where("doc_id < 450").select("doc_id", "text"), df.select("doc_id", "toxic")))
    got = toxicity.score_toxicity(df.where("doc_id >= 450"), model).collect()
    assert sum((r.score >= 0.3) != r.toxic for r in got) <= 2 and all(r.predicted == (r.score >= 0.3) for r in got)
    odd = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "grobbel", 5)], "doc_id long, text string, predicted int")
    by = {r.doc_id: r.predicted for r in toxicity.score_toxicity(odd, model).collect()}
    assert by == {1: 0, 2: 0, None: 1}
    assert [tuple(r) for r in toxicity.score_toxicity(odd, model, clean_only=True).orderBy("doc_id").collect()] == [(1, None, 5), (2, "", 5)]
    nothing = toxicity.fit(toxicity.labelled(df.limit(0), df))
    assert {r.predicted for r in toxicity.score_toxicity(odd, nothing).collect()} == {0}


def test_op5_registered_query_catches_held_out_labels(spark, data):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = Q.op5_toxicity(spark, "/root/testdata/sf0.1").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.1/documents.parquet").count()
    held = [r for r in rows if r.held_out and r.doc_id in toxic]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    bad = [r for r in held if toxic[r.doc_id] == 1]
    assert sum(r.predicted for r in bad) >= 0.9 * len(bad) and sum(r.predicted for r in held if toxic[r.doc_id] == 0) <= 0.05 * len(held)


def test_training_rows_with_a_hot_id(spark):
    rows = [(7, f"t{i}", "a") for i in range(500)] + [(i + 10, f"u{i}", "a" if i % 2 else "b") for i in range(40)] + [(1, None, "a"), (2, "x", None)]
    df = spark.createDataFrame(rows, "id long, text string, label string")
    got, counts = ngrams.training_rows(df.repartition(5), 10, 20, 1000)
    again, _ = ngrams.training_rows(df.repartition(2), 10, 20, 1000)
    assert got == again and len(got) == 20 and counts == {"a": 520, "b": 20} and sum(t.startswith(b"t") for t, _ in got) <= 1


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v // 10 + v % 10
    return total % 10 == 0


def brute_spans(text):
    out, n = [], dict.fromkeys(pii.BASE, 0)
    for kind, pattern in pii.BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            n[kind] += 1
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return (*n.values(), hashlib.sha256(",".join(out).encode()).hexdigest()), out


PERSONAL = [
    "mail a.b+c@x-y.co.uk, a@b.c_x@d.e and .@.com x@y. @z.com a@b..c", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0004 1.2.3 00000.0.0.255", "4111 1111-1111 1111 and 4111111111111112 5",
    "+1 (017) 555-7713 +12 +1234567 ( +99999999999999999 +1-2-3-4-5-6-7-8", "é😀 a@b.cd 😀 4111111111111111 é", None, "", "@" * 300, "9" * 3000, "a" * 3000, "1.2.3." * 200, "x@" + "a-" * 500 + ".b", "1 " * 2000,
    "+4111 1111 1111 1111 a1@1.2.3.4",
]


def test_op6_base_spans(spark):
    rows = [(i, t) for i, t in enumerate(PERSONAL)] + [(None, PERSONAL[0]), (0, PERSONAL[0]), (0, PERSONAL[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted((tuple(r)[:6] for r in pii.span_digest(docs).collect()), key=str)
    assert got == sorted(((i, *brute_spans(t)[0]) for i, t in rows), key=str)
    assert pii.span_digest(docs.limit(0)).count() == 0


def test_op6_bootstrap_finds_unseen(spark):
    rows = [(i, f"some text {i} write me at u{i}@mail.org now please") for i in range(30)]
    rows += [(100, "do write me at user-77-home now please"), (101, "we saw user-77-home there today")]
    got = {r.doc_id: r.spans for r in pii.span_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == "ctx_email:15:27" and got[101] == "" and got[3].startswith("email:")


def test_op6_promoted_instances_are_seeds(spark):
    """Emails teach one context; what it finds recurs in a second one, which finds a thirteenth."""
    rows = [(i, f"text {i} write me at u{i}@mail.org now please") for i in range(40)]
    rows += [(100 + i, f"do write me at user-{i}x now please") for i in range(12)]
    rows += [(200 + i, f"the badge holder user-{i}x opened doors") for i in range(12)]
    far = "w" * 300
    rows += [(300, "the badge holder user-77q opened doors"), (301, "a user-88z of none"), (302, f"{far} write me at user-99k now please")]
    got = {r.doc_id: r.spans for r in pii.span_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == "ctx_email:15:22" and got[200] == "ctx_email:17:24" and got[300] == "ctx_email:17:25" and got[301] == "" and got[302] == "ctx_email:313:321"


def test_op6_base_spans_of_the_whole_table(spark, data):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in Q.op6_pii(spark, data).collect():
        want, spans = brute_spans(texts[r.doc_id])
        assert tuple(r)[1:6] == want and r.spans.split(",")[: len(spans)] == (spans or [""])[: len(spans)]


def test_op6_bootstrap_learns_numbers_of_many_tokens_and_labels(spark):
    rows = [(i, f"in 20{i} call me at +1 (0{i}) 555-77{i} today please") for i in range(10, 30)]
    rows += [(i, f"Card: 4111 {luhn_tail(i)} ok{i}") for i in range(30, 50)]
    rows += [(i, f"user{i} host={i}.1.2.3;") for i in range(50, 70)]
    rows += [(100, "in 2099 call me at (099) 555 7799 today please"), (101, "Card: 77 88 99 end"), (102, "user9 host=box-7;"), (103, "page 12 34 of the book")]
    got = {r.doc_id: r.spans for r in pii.span_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[10] == "phone:19:36" and got[30].startswith("card:6:25") and got[50].startswith("ip:12:20")
    assert got[100] == "ctx_phone:19:33" and got[101] == "ctx_card:6:14" and got[102] == "ctx_ip:11:17" and got[103] == ""


def luhn_tail(i):
    return next(f"1111 {i:04d} {k:04d}" for k in range(10) if luhn(f"41111111{i:04d}{k:04d}"))


def test_op6_redacts(spark):
    rows = [(1, "to a@b.cd or +1 (017) 555-7713!", "k"), (2, None, "k"), (3, "clean", "k"), (3, "clean", "k"), (None, "ip 1.2.3.4", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string")
    got = sorted(map(tuple, pii.redact(docs).collect()), key=str)
    assert got == sorted([(1, "to [EMAIL] or [PHONE]!", "k"), (2, None, "k"), (3, "clean", "k"), (3, "clean", "k"), (None, "ip [IP]", "k")], key=str)


def test_names_that_clash_with_helpers(spark):
    names = "`doc_id` long, text string, __rows int, __AT int, __kept_id int, __kept_key int, __pii_id int, __pii_key int, __pii_spans int, `a.b` int"
    docs = spark.createDataFrame([(1, "mail a@b.cd or so now", 1, 2, 3, 4, 5, 6, 7, 8), (2, "mail a@b.cd or so now", 1, 2, 3, 4, 5, 6, 7, 8)], names)
    assert [tuple(r) for r in near_dups.drop_near_duplicates(docs).collect()] == [(1, "mail a@b.cd or so now", 1, 2, 3, 4, 5, 6, 7, 8)]
    assert sorted(tuple(r)[:2] for r in pii.redact(docs).collect()) == [(1, "mail [EMAIL] or so now"), (2, "mail [EMAIL] or so now")]
    none = docs.limit(0)
    assert pii.redact(none).count() == near_dups.drop_near_duplicates(none).count() == 0


def test_op6_stays_in_the_jvm(spark, data):
    plan = Q.op6_pii(spark, data)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pipeline(spark, data, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in P.STAGES:
        stage(spark, docs, data).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert out.columns == columns and out.count() <= before
        if name == "near_dedup":
            kept = [(r.doc_id, r.text) for r in out.collect()]
            want = [r[0] for r in brute_groups([(r.doc_id, r.text) for r in docs.collect()], 80) if r[3]]
            assert sorted(k for k, _ in kept) == sorted(want)
        if name == "pii":
            assert all(not brute_spans(r.text)[0][0] and r.n_chars == len(r.text) for r in out.collect())
        docs, before = out, out.count()
    assert docs.agg(F.countDistinct("doc_id")).first()[0] == spark.read.parquet(f"{tmp_path}/pii").count()
    assert P.queries().keys() == {"pipeline"} and P.ORACLE_SQL is None
