"""The search engine: dialect, planning, modes, index and upkeep."""

import os
import random
import re
import shutil
import subprocess
import sys
import time
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from siftwell import catalog
from siftwell.functions import fold as folding
from siftwell.functions.linear import program
from siftwell.functions.predicates import KNOWN_TEXT, below, extension, glob_regex, is_binary, is_hidden, passes_globs
from siftwell.functions.regex_ast import PatternError, parse
from siftwell.functions.translate import to_java
from siftwell.functions.trigrams import literal_runs, required_literal, trigram_query
from siftwell.operators import search as ops
from siftwell.operators.context import resolve, with_context
from siftwell.operators.render import render, resolve_format, sorted_output
from siftwell.operators.search import PathFilter, Pattern, Search
from siftwell.plans import index as ix
from siftwell.plans import indexed, maintain
from siftwell.sources.corpus import from_directory, from_table, lines, listing, read_files
from siftwell.sources.ignore import walk, walk_files
from siftwell.streaming.watch import Updater, watch


def corpus(spark, texts):
    rows = [(i, p, t) for i, (p, t) in enumerate(texts.items())]
    df = spark.createDataFrame(rows, "id long, path string, text string")
    return from_table(df, "id", "text", F.col("path"), mtime=F.lit(1)).cache()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, data, name, tmp_path):
    db = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        db.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    catalog.queries()[name](spark, data).write.parquet(f"{tmp_path}/out")
    db.execute(f"create table ours as select * from '{tmp_path}/out/*.parquet'")
    db.execute(f"create table theirs as {catalog.oracle_sql()[name]}")
    assert sorted(r[:2] for r in db.execute("describe ours").fetchall()) == sorted(r[:2] for r in db.execute("describe theirs").fetchall())
    cols = ", ".join(f'"{r[0]}"' for r in db.execute("describe ours").fetchall())
    for a, b in (("ours", "theirs"), ("theirs", "ours")):
        assert db.execute(f"select count(*) from (select {cols} from {a} except all select {cols} from {b})").fetchall() == [(0,)]


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(entry_module.queries())


# (pattern, text, matches)
DIALECT = [
    ("a.c", "a\rc", True), ("a.c", "a c", True), (r"^b", "ab", False), (r"b$", "ab", True), (r"\w+é", "caféé", True), (r"^\w$", "é", True),
    (r"(?-u)^\w$", "é", False), (r"[[:space:]]b", "a b", True), (r"[[:space:]]b", "asb", False), (r"[^[:alpha:]]", "abc", False), (r"(?P<n>x)y", "xy", True),
    (r"\p{Greek}", "σ", True), (r"\p{Greek}", "s", False), (r"\pL\d", "é1", True), (r"[\p{Lu}&&[^A]]", "A", False), (r"[a-z--b]", "b", False),
    (r"[a-z--b]", "c", True), (r"[a-c~~b-d]", "b", False), (r"[a-c~~b-d]", "d", True), (r"\bfoo\b", "a foo.", True), (r"\bfoo\b", "éfoo", False),
    (r"\<foo", "xfoo", False), (r"\b{end}x", "ax", False), (r"(?i)straße", "STRAßE", True), ("(?i)k", "K", True), (r"a{2,3}b", "aab", True),
    (r"a{2}", "a a", False), (r"(?x) a b # c", "ab", True), (r"\x{3c3}\u{3c3}", "σσ", True), (r"a\.b", "axb", False), (r"(a|b)+?c", "abac", True),
    (r"[]a]", "]", True), (r"[a\]]", "]", True), (r"x*", "", True), (r"\Aab\z", "ab", True), (r"(?s)a.b", "a\nb", True), (r"\x41", "A", True), (r"\S\D\W", "a- ", True),
    (r"[\d-]x", "-x", True), (r"(?i:A)b", "ab", True), (r"(?i:A)b", "aB", False), (r"a(?i)B", "ab", True),
]


def test_dialect_in_java(spark):
    for pattern, text, want in DIALECT:
        got = spark.range(1).select(F.lit(text).rlike(to_java(parse(pattern)))).first()[0]
        assert got == want, (pattern, text, to_java(parse(pattern)))


@pytest.mark.parametrize("bad", [r"(?=a)", r"(?<!a)b", r"(a)\1", "(", ")", "[a", "*a", r"a{,2}", r"\q", "(?R)a", "[[:nope:]]", "a{3,2}", r"\p{", "(?P<>a)"])
def test_refused(bad):
    with pytest.raises(PatternError):
        parse(bad)


def test_trigrams_are_sound():
    assert trigram_query(parse("hello")) == [["ell", "hel", "llo"]]
    assert literal_runs(parse("ab+c")) == ["ab", "bc"]
    assert literal_runs(parse("colou?r")) == ["colo", "r"]
    assert literal_runs(parse("(ab){2}c")) == ["ababc"]
    assert literal_runs(parse("(ab){2,}c")) == ["abab", "ababc"]
    assert trigram_query(parse("foo|ba")) == [] and trigram_query(parse("foo|bar")) == [["foo"], ["bar"]]
    assert trigram_query(parse("foo\nbar")) == [["bar", "foo"]]
    assert required_literal(parse("foo\\d|bar")) is None and required_literal(parse("xx.*abcd")) == "abcd"
    assert trigram_query(parse("(?i)ABC"), True) == [["abc"]]


def test_fold_is_as_coarse_as_the_matcher(spark):
    src, dst = folding.tables()
    assert len(src) == len(dst) and all(folding.fold_char(c) == c for c in dst)
    pairs = [(a, b) for a in map(chr, range(0x41, 0x600)) for b in {a.upper(), a.lower(), a.title()} if len(b) == 1 and a != b]
    df = spark.createDataFrame(pairs, "a string, b string").where("a rlike concat('^(?iu:', b, ')$')")
    assert df.where(folding.fold(F.col("a")) != folding.fold(F.col("b"))).count() == 0
    assert folding.fold_text("KelvinK") == "kelvink"


def test_lines(spark):
    got = [(r.path, r.line_number, r.line) for r in lines(corpus(spark, {"a": "x\ny\n", "b": "", "c": "\n", "d": "p\r\n\nq", "e": None})).orderBy("path", "line_number").collect()]
    assert got == [("a", 1, "x"), ("a", 2, "y"), ("c", 1, ""), ("d", 1, "p\r"), ("d", 2, ""), ("d", 3, "q")]
    assert [r.line for r in Search(Pattern("p")).run(corpus(spark, {"d": "p\r\nq"})).collect()] == ["p"]


def test_only_matching_and_empty_matches(spark):
    docs = corpus(spark, {"f": "baac"})
    for text, want in (("a*", ["", "aa", ""]), ("a", ["a", "a"]), ("b|", ["b", "", "", ""])):
        found = Search(Pattern(text)).matching(docs)
        got = [r.match for r in ops.only_matching(found, Pattern(text)).orderBy("nth").collect()]
        mine, at = [], -1  # leftmost first, an empty match at the end of the last one left out
        for m in re.finditer(text, "baac"):
            if m.end() > m.start() or m.start() != at:
                mine.append(m[0])
            at = m.end()
        assert got == mine, (text, got, want)


def test_globs_and_paths(spark):
    rows = [("a.rs",), ("src/a.rs",), ("src/deep/b.txt",), (".hidden/c",), ("Makefile",), ("src2/x.tar.gz",), (".env",)]
    df = spark.createDataFrame(rows, "path string")
    names = lambda c: {r[0] for r in df.where(c).collect()}
    p = F.col("path")
    assert names(passes_globs(p, ["*.rs"], [])) == {"a.rs", "src/a.rs"}
    assert names(passes_globs(p, ["/a.rs"], [])) == {"a.rs"}
    assert names(passes_globs(p, ["src/**"], ["*.txt"])) == {"src/a.rs"}
    assert names(passes_globs(p, ["*.{rs,txt}"], [])) == {"a.rs", "src/a.rs", "src/deep/b.txt"}
    assert names(below(p, "src")) == {"src/a.rs", "src/deep/b.txt"} and names(below(p, ".")) == {r[0] for r in rows}
    assert names(is_hidden(p)) == {".hidden/c", ".env"}
    assert {r[0]: r[1] for r in df.select("path", extension(p)).collect()} == {"a.rs": "rs", "src/a.rs": "rs", "src/deep/b.txt": "txt", ".hidden/c": None, "Makefile": None, "src2/x.tar.gz": "gz", ".env": None}
    assert re.match(glob_regex("a[!b]c"), "axc") and not re.match(glob_regex("a[!b]c"), "abc")
    assert len(KNOWN_TEXT) == len(set(KNOWN_TEXT))


def test_binary(spark):
    cases = [(b"hello", False), (b"a\0b", True), (b"x" * 600 + b"\0", False), (b"\x01" * 31 + b"a" * 69, True), (b"\x01" * 30 + b"a" * 70, False), (b"", False), ("é".encode() * 50, False)]
    df = spark.createDataFrame([(bytearray(b), w) for b, w in cases], "b binary, want boolean")
    assert df.where(is_binary(F.col("b")) != F.col("want")).count() == 0


def test_context_against_brute_force(spark):
    text = "\n".join("hit" if i in (0, 4, 5, 9, 14) else f"l{i}" for i in range(15))
    docs = corpus(spark, {"f": text, "g": "no"})
    for b, a in ((0, 0), (1, 0), (0, 2), (2, 1), (20, 20)):
        got = [(r.line_number, r.kind, r.chunk) for r in with_context(docs, Search(Pattern("hit")), b, a).orderBy("line_number").collect()]
        hits = [i + 1 for i, line in enumerate(text.split("\n")) if line == "hit"]
        want, chunk, last = [], 0, -9
        for n in range(1, 16):
            if any(n - a <= h <= n + b for h in hits):
                chunk += bool(n - last > 1 and (a or b))
                want.append((n, "match" if n in hits else "context", chunk))
                last = n
        assert got == want
    assert resolve(3, None, 1) == (3, 1) and resolve(None, None, None) == (0, 0)


def test_render(spark):
    docs = corpus(spark, {"a": "x\n  hit\ny\nz\nw\nhit", "b": "hit"})
    found = with_context(docs, Search(Pattern("hit")), 1, 0)
    out = [r.output for r in sorted_output(render(found)).collect()]
    assert out == ["a-1-x", "a:2:  hit", "--", "a-5-w", "a:6:hit", "b:1:hit"]
    flat = Search(Pattern("hit")).run(docs)
    assert [r.output for r in sorted_output(render(flat, "heading", trim=True)).collect()] == ["a", "2:hit", "6:hit", "b", "1:hit"]
    assert "\x1b[1;31mhit\x1b[0m" in sorted_output(render(flat, pattern=Pattern("hit"))).first().output
    assert resolve_format("compact", True) == "compact" and resolve_format(heading=False, terminal=True) == "grep"
    assert resolve_format(env={"SIFTWELL_FORMAT": "heading"}) == "heading" and resolve_format(env={}) == "grep" and resolve_format(env={}, terminal=True) == "heading"


PATTERNS = ["hello", "ab+c", "colou?r", r"foo\d|bar", "(?i)KELVIN", "h.llo", "(an)+d", "x{2,}y", "ö", "^The", r"\bfoo\b", "a|b", "foo|hello", "zzzq", "[[:digit:]]{3}"]


def test_indexed_equals_full_scan_through_upkeep(spark, tmp_path):
    texts = {"a": "hello world\nabbc abc\ncolor colour", "b": "foo1 bar\nKelvin kelvin", "c": "xxy xxxy\nandandand\n123", "d": "höllo\nThe foo", "e": "", "f": "ab"}
    docs = corpus(spark, texts)
    index = ix.build(docs, str(tmp_path / "index"), ci=True)

    def check(index, docs):
        for p in PATTERNS:
            for invert in (False, True):
                s = Search(Pattern(p), invert=invert)
                rows = lambda df: sorted((r.path, r.line_number, r.line) for r in df.collect())
                assert rows(indexed.search_index(index, s)) == rows(s.run(docs)), p

    check(index, docs)
    assert ix.may_follow(index.table("followers"), "hel", ["l"]) and not ix.may_follow(index.table("followers"), "hel", ["z"]) and ix.may_follow(index.table("followers"), "qqq", ["z"])
    changed = corpus(spark, {**texts, "a": "hello again", "new": "foo7 abbbc"} | {"f": "ab"})
    changed = changed.where("path <> 'c'").withColumn("mtime", F.when(F.col("path") == "a", 5).otherwise(1).cast("long"))
    assert maintain.is_stale(index, changed) and maintain.is_stale_sample(index, changed) and not maintain.is_stale(index, docs)
    index, stats = maintain.update(index, changed)
    assert (stats.added, stats.modified, stats.deleted, stats.docs) == (1, 1, 1, 6)
    check(index, changed)
    assert index.table("docs").groupBy("path").count().where("count > 1").isEmpty()
    index = maintain.compact(index)
    assert index.deltas == []
    check(index, changed)
    again, stats = maintain.update(index, changed)
    assert stats.added + stats.modified + stats.deleted == 0 and again.main == index.main


def test_index_without_folded_twin_scans(spark, tmp_path):
    docs = corpus(spark, {"a": "Hello", "b": "x"})
    index = ix.open_or_build(docs, str(tmp_path / "i"))
    s = Search(Pattern("HELLO", ignore_case=True))
    assert indexed.strategy(index, s) == "full scan" and indexed.search_index(index, s).count() == 1
    assert ix.open_or_build(docs, str(tmp_path / "i")).main == index.main


def test_directory_corpus(spark, tmp_path):
    files = {".gitignore": "*.log\n!keep.log\nbuild/\n", "a.py": "hello\nx", "sub/b.txt": "hello", "c.log": "hello", "keep.log": "hello", "build/z.txt": "hello", ".h/i.txt": "hello", "_u.txt": "hello"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "bin").write_bytes(b"\0hello")
    (tmp_path / "bad.txt").write_bytes(b"hello \xff")
    docs = from_directory(spark, str(tmp_path))
    found = lambda **k: {r.path for r in Search(Pattern("hello"), PathFilter(**k)).run(docs).collect()}
    assert found() == {"a.py", "sub/b.txt", "keep.log", ".h/i.txt", "_u.txt", "bad.txt"}
    assert found(hidden=False) == {"a.py", "sub/b.txt", "keep.log", "_u.txt", "bad.txt"}
    assert found(types=("py",)) == {"a.py"}
    assert "c.log" in {p for p, _, _ in walk_files(str(tmp_path), no_ignore=True)}
    assert {r.path for r in walk(spark, str(tmp_path), spread=1).collect()} == {p for p, _, _ in walk_files(str(tmp_path))}


def test_ignore_rules_from_above_and_outside(tmp_path, monkeypatch):
    home = tmp_path / "home"
    (home / "git").mkdir(parents=True)
    (home / "git" / "ignore").write_text("*.tmp\n")
    monkeypatch.setenv("XDG_CONFIG_HOME", str(home))
    monkeypatch.setenv("HOME", str(home))
    for name, text in {".git/info/exclude": "private\n", ".gitignore": "*.log\n/sub/deep/x.txt\n", "sub/a.txt": "", "sub/b.log": "", "sub/c.tmp": "", "sub/private/d.txt": "", "sub/deep/x.txt": "", "sub/deep/y.txt": ""}.items():
        (tmp_path / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / name).write_text(text)
    assert {p for p, _, _ in walk_files(str(tmp_path / "r" / "sub"))} == {"a.txt", "deep/y.txt"}
    assert {p for p, _, _ in walk_files(str(tmp_path / "r"))} == {".gitignore", "sub/a.txt", "sub/deep/y.txt"}
    assert len(list(walk_files(str(tmp_path / "r" / "sub"), no_ignore=True))) == 6


def test_update_reads_only_what_changed(spark, tmp_path):
    root, path, opened = tmp_path / "files", str(tmp_path / "i"), []
    root.mkdir()
    for k in range(20):
        (root / f"{k}.txt").write_text(f"hello {k}")
    (root / "bin").write_bytes(b"\0\0")

    def read(names):
        opened.append(sorted(r.path for r in names.collect()))
        return read_files(names, str(root))

    ix.build(from_directory(spark, str(root), with_binary=True), path)
    (root / "3.txt").write_text("goodbye")
    os.utime(root / "3.txt", (1, 1000))
    (root / "4.txt").unlink()
    (root / "new.txt").write_text("hello new")
    index, stats = maintain.update_folder(listing(spark, str(root)), path, read)
    assert (stats.added, stats.modified, stats.deleted) == (1, 1, 1) and opened == [["3.txt", "new.txt"]]
    assert indexed.search_index(index, Search(Pattern("hello"))).count() == 19
    again, stats = maintain.update_folder(listing(spark, str(root)), path, read)
    assert stats.added + stats.modified + stats.deleted == 0 and len(opened) == 1


def test_update_loses_nothing(spark, tmp_path):
    rows = spark.range(5000, numPartitions=3).select("id", F.concat(F.lit("p"), "id").alias("path"), F.concat(F.lit("some text "), "id").alias("text"))
    docs = from_table(rows, "id", "text", F.col("path"), mtime=F.lit(1))
    index = ix.build(docs.where("doc_id < 20"), str(tmp_path / "i"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4k")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        index, stats = maintain.update(index, docs.repartition(16, "path"))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    live = index.table("docs")
    assert stats.added == 4980 and stats.docs == live.count() == live.select("doc_id").distinct().count() == live.select("path").distinct().count() == 5000
    assert live.agg(F.max("doc_id")).first()[0] == 4999 == index.meta.ids
    assert indexed.search_index(index, Search(Pattern("text 4321$"))).count() == 1


def test_of_two_writers_one_fails(spark, tmp_path):
    docs = corpus(spark, {"a": "hello", "b": "x"})
    first = ix.build(docs, str(tmp_path / "i"))
    maintain.update(first, corpus(spark, {"a": "hello", "b": "x", "c": "hello"}))
    for late in (lambda: maintain.update(first, corpus(spark, {"d": "hello"})), lambda: maintain.compact(first)):
        with pytest.raises(ix.ConcurrentUpdate):
            late()
    index = ix.Index(spark, str(tmp_path / "i"))
    assert {r.path for r in index.table("docs").collect()} == {"a", "b", "c"} and len([n for n in index.folder.names() if n.startswith(("v-", "d-"))]) == 2


LOOPS = ["(a|b)*c", "(foo|ba)+x", r"(\w+\s?)+$", "(ab|a)*?b", "((a|aa)+b?)+$", r"(é|ab)*\bx", "(?i)(FO|ba)+X", "^(?:ab|cd)*$", "(a+b)*c"]


@pytest.mark.parametrize("text", LOOPS)
def test_repeated_groups_end_in_time(spark, monkeypatch, text):
    """Long lines in bounded time, and the linear matcher's answers equal the JVM's."""
    long = {"a" * 1_000_000: "a", "ab" * 400_000 + "c": "b", "foo" * 300_000 + "x": "c", "word " * 200_000: "d", "cd" * 5000 + "!": "e"}
    docs = corpus(spark, {p: t for t, p in long.items()})
    got = {r.path for r in Search(Pattern(text)).matching(docs).collect()}
    assert got == {p for t, p in long.items() if program(parse(text)).matches(t)}
    rng, tree = random.Random(text), parse(text)
    lines_ = ["".join(rng.choice("abcdfoxé AB1") for _ in range(rng.randrange(0, 14))) for _ in range(300)]
    small = spark.createDataFrame([(t,) for t in lines_], "line string")
    rows = small.select("line", F.col("line").rlike(to_java(tree)).alias("hit"), F.regexp_extract_all("line", F.lit(f"({to_java(tree)})"), F.lit(1)).alias("all")).collect()
    for r in rows:
        assert program(tree).matches(r.line) == r.hit, r.line
        assert [x for x in (r.line[a:b] for a, b in program(tree).spans(r.line)) if x] == [x for x in r.all if x], r.line


def generated(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice(["a", "b", "ab", "c", ".", "[ab]", "[^a]", r"\d", "1", r"\w", r"\b", "é"])
    kind = rng.randrange(4)
    x, y = generated(rng, depth - 1), generated(rng, depth - 1)
    if kind == 0:
        return x + y
    if kind == 1:
        return f"({x}|{y})"
    if kind == 2:
        return f"({x}){rng.choice(['*', '+', '?', '{2}', '{1,3}', '*?'])}{y}"
    return f"(?:{x}{y})"


def test_generated_patterns_against_another_engine(spark):
    """Some 500 patterns: ours, in the JVM and in linear time, against DuckDB's RE2."""
    rng, db = random.Random(5), duckdb.connect()
    texts = ["".join(rng.choice("aabbc1B ") for _ in range(rng.randrange(0, 12))) for _ in range(60)] + ["", "ab", "aB1", "bbb", "abab"]
    patterns = sorted({generated(rng, rng.randrange(1, 4)) for _ in range(900)})[:500]
    df = spark.createDataFrame([(t,) for t in texts], "line string").coalesce(1)
    db.execute("create table t(line varchar)")
    db.executemany("insert into t values (?)", [(t,) for t in texts])
    for k in range(0, len(patterns), 50):
        part = patterns[k : k + 50]
        ours = df.select("line", *[Pattern(p).matches(F.col("line")).alias(f"c{i}") for i, p in enumerate(part)]).collect()
        theirs = {r[0]: r[1:] for r in db.execute("select line, " + ", ".join(f"regexp_matches(line, '{p}')" for p in part) + " from t").fetchall()}
        for r in ours:
            assert tuple(r)[1:] == theirs[r.line], [(p, a, b) for p, a, b in zip(part, tuple(r)[1:], theirs[r.line]) if a != b]
        for p in part:
            machine = program(parse(p))
            assert [machine.matches(t) for t in texts] == [theirs[t][part.index(p)] for t in texts], p
    sample = patterns[::25]
    docs = corpus(spark, {str(k): t for k, t in enumerate(texts)})
    return sample, docs


def test_indexed_never_misses(spark, tmp_path):
    sample, docs = test_generated_patterns_against_another_engine(spark)
    index = ix.build(docs, str(tmp_path / "i"), ci=True)
    for p in sample:
        rows = lambda df: sorted((r.path, r.line_number) for r in df.collect())
        assert rows(indexed.search_index(index, Search(Pattern(p)))) == rows(Search(Pattern(p)).run(docs)), p


def test_works_without_the_llm_subpackage(tmp_path):
    """On a copy without the llm folders, all else imports and runs."""
    root = Path(__file__).resolve().parent.parent
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'indexed_regex' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)


def test_streaming_updates(spark, tmp_path):
    state = {"a": "hello", "b": "x"}
    docs = lambda: corpus(spark, state).withColumn("mtime", F.crc32(F.col("text").cast("binary")))
    path = str(tmp_path / "i")
    ix.build(docs(), path)
    state["b"] = "hello too"
    query = watch(spark, path, docs, str(tmp_path / "ckpt"), seconds=1, compact_every=1)
    try:
        end = time.time() + 90
        while time.time() < end and not (query.lastProgress and ix.Index(spark, path).number > 2):
            time.sleep(0.5)
    finally:
        query.stop()
    assert query.exception() is None
    index = ix.Index(spark, path)
    assert index.deltas == [] and indexed.search_index(index, Search(Pattern("hello"))).count() == 2
    del state["a"]
    Updater(spark, path, docs).apply()
    assert indexed.search_index(ix.Index(spark, path), Search(Pattern("hello"))).count() == 1


def test_multiline(spark):
    docs = corpus(spark, {"a": "x foo\nbar y\nfoo\nbar", "b": "foo bar"})
    got = [(r.path, r.line_number, r.line) for r in Search(Pattern("foo\nbar", multiline=True)).run(docs).orderBy("line_number").collect()]
    assert got == [("a", 1, "x foo"), ("a", 3, "foo")]
    with pytest.raises(PatternError):
        Search(Pattern("a*", multiline=True)).run(docs)
