"""The registered queries of the search engine, each over whole tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.predicates import extension, is_binary, is_hidden
from .operators import search as ops
from .operators.context import with_context
from .operators.render import render, summary, trimmed
from .operators.search import PathFilter, Pattern, Search
from .plans import index as ix
from .plans import indexed, maintain
from .sources.corpus import from_table, lines

_indexes: dict[tuple, str] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit("."), F.col("lang")))
    return from_table(df, "doc_id", "text", path, F.col("lang"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_table(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "html", F.col("url"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    path = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role")
    return from_table(df, "conv_id", "text", path)


def prepared(spark: SparkSession, sf_dir: str) -> ix.Index:
    """The index of the documents, with its folded twin; built at its first use in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
        path = f"{root.rstrip('/')}/siftwell-index-{uuid.uuid4().hex}"
        ix.build(documents(spark, sf_dir), path, ci=True)
        _indexes[key] = path
    return ix.Index(spark, _indexes[key])


def _find(text: str, invert: bool = False, paths: PathFilter | None = None, **how) -> Search:
    return Search(Pattern(text, **how), paths or PathFilter(), invert)


def _scan(search: Search, source=documents):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.run(source(spark, sf_dir)).drop("path") if source is documents else search.run(source(spark, sf_dir))

    return run


def _indexed(search: Search):
    return lambda spark, sf_dir: indexed.search_index(prepared(spark, sf_dir), search).drop("path")


def _of(search: Search, then):
    return lambda spark, sf_dir: then(search.matching(documents(spark, sf_dir)))


def _context(search: Search, before: int, after: int, index: bool = False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = indexed.search_index(prepared(spark, sf_dir), search, before, after) if index else with_context(documents(spark, sf_dir), search, before, after)
        return out.drop("path")

    return run


def _rendered(search: Search, form: str, before: int = 0, after: int = 0):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = with_context(documents(spark, sf_dir), search, before, after) if before or after else search.run(documents(spark, sf_dir))
        return render(found, form)

    return run


def old_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier state of the documents: those of src0 weren't there yet, German ones were
    in upper case, and there was a copy of each of src1 that is gone now."""
    docs = documents(spark, sf_dir)
    source = F.split("path", "/")[0]
    base = docs.where(source != "src0").withColumn("text", F.when(F.col("ext") == "de", F.upper("text")).otherwise(F.col("text"))).withColumn("mtime", F.when(F.col("ext") == "de", F.lit(0)).otherwise(F.lit(1)).cast("long"))
    gone = base.where(source == "src1").withColumn("path", F.concat(F.lit("gone/"), "path")).withColumn("doc_id", F.col("doc_id") + 1_000_000_000)
    return base.unionByName(gone)


def _updated(spark: SparkSession, sf_dir: str, then) -> DataFrame:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    index = ix.build(old_documents(spark, sf_dir), f"{root.rstrip('/')}/siftwell-update-{uuid.uuid4().hex}")
    new, _ = maintain.update(index, documents(spark, sf_dir).withColumn("mtime", F.lit(1).cast("long")))
    return then(new)


def update_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = documents(spark, sf_dir).withColumn("mtime", F.lit(1).cast("long"))
    return maintain.diff(old_documents(spark, sf_dir), new).select("path", "change")


def _ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of ASCII only, whose folding SQL knows."""
    return documents(spark, sf_dir).where(F.length("text") == F.octet_length("text")).select("doc_id")


def _posted(columns: list[str], table: str):
    return lambda spark, sf_dir: prepared(spark, sf_dir).table(table).select(*columns)


def binary_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' bytes, and the same with a NUL and with control bytes put in front."""
    docs = documents(spark, sf_dir).select("doc_id", F.col("text").cast("binary").alias("b"))
    put = lambda n, b: F.concat(F.lit(bytearray(b)), F.col("b")) if n else F.col("b")
    cases = {"plain": b"", "nul": b"\0", "control": b"\x01" * 4000}
    return docs.select("doc_id", *[is_binary(put(len(b), b)).alias(name) for name, b in cases.items()])


REGEX, ALTERNATION, REPEATED = "the.*and", "ation|ment|eaux", "(an)+d"
_CONTEXT = _find("token")


def queries() -> dict:
    docs = documents
    out = {
        "scan_lines": lambda s, d: lines(docs(s, d)).drop("path"),
        "search_literal": _scan(_find("the")),
        "search_fixed": _scan(_find("or.", fixed=True)),
        "search_regex": _scan(_find(REGEX)),
        "search_class": _scan(_find(r"[0-9]{3}-[0-9]{4}")),
        "search_alternation": _scan(_find(ALTERNATION)),
        "search_ignore_case": _scan(_find("THE.*AND", ignore_case=True)),
        "search_anchored": _scan(_find(r"^The .*\.$")),
        "search_invert": _scan(_find("the", invert=True)),
        "search_multiline": _scan(_find(r"\.\nThe", multiline=True)),
        "search_pages": _scan(_find("<p>"), pages),
        "search_conversations": _scan(_find("the.*and"), conversations),
        "only_matching": lambda s, d: ops.only_matching(_find("[a-z]+tion").matching(docs(s, d)), Pattern("[a-z]+tion")).drop("path"),
        "count_per_file": _of(_find("the"), ops.count_per_file),
        "count_total": _of(_find("the"), ops.count_total),
        "count_invert": _of(_find("the", invert=True), ops.count_total),
        "count_occurrences": lambda s, d: ops.count_occurrences(_find("tion").matching(docs(s, d)), Pattern("tion")),
        "files_with_matches": _of(_find("the"), ops.files_with_matches),
        "exists_match": _of(_find("the"), ops.exists),
        "summary_output": lambda s, d: summary(ops.count_per_file(_find("the").matching(docs(s, d)))),
        "filter_type": _scan(_find("e", paths=PathFilter(types=("de", "fr")))),
        "filter_include": _scan(_find("e", paths=PathFilter(include=("src1/**", "*.es")))),
        "filter_exclude": _scan(_find("e", paths=PathFilter(exclude=("*.en", "src2/")))),
        "filter_subtree": _scan(_find("e", paths=PathFilter(subtree="src1/en"))),
        "filter_hidden": lambda s, d: docs(s, d).select("doc_id", is_hidden(F.regexp_replace("path", "^src1/", ".src1/")).alias("hidden"), extension(F.col("path")).alias("ext")),
        "context_before": _context(_CONTEXT, 2, 0),
        "context_after": _context(_CONTEXT, 0, 2),
        "context_both": _context(_CONTEXT, 1, 2),
        "trim_output": lambda s, d: _find("the").run(docs(s, d).withColumn("text", F.regexp_replace("text", "\n", "\n \t "))).select("doc_id", "line_number", trimmed(F.col("line")).alias("line")),
        "format_grep": _rendered(_find("token"), "grep", 1, 1),
        "format_heading": _rendered(_find("token"), "heading"),
        "format_compact": lambda s, d: render(_find("token").run(docs(s, d)), "compact", root="src1"),
        "byte_offsets": lambda s, d: ix.with_offsets(docs(s, d)).drop("path"),
        "index_postings": _posted(["tri", "doc_id", "line_no", "byte_offset"], "postings"),
        "index_doc_sets": _posted(["tri", "doc_id"], "doc_postings"),
        "index_postings_ci": lambda s, d: prepared(s, d).table("postings_ci").join(_ascii(s, d), "doc_id", "left_semi").select("tri", "doc_id", "line_no"),
        "index_followers": _posted(["tri", "next"], "followers"),
        "index_stats": lambda s, d: prepared(s, d).stats(),
        "indexed_literal": _indexed(_find("token")),
        "indexed_regex": _indexed(_find(REGEX)),
        "indexed_alternation": _indexed(_find(ALTERNATION)),
        "indexed_ci": _indexed(_find("TOKEN", ignore_case=True)),
        "indexed_repetition": _indexed(_find(REPEATED)),
        "indexed_fallback_short": _indexed(_find("ü")),
        "indexed_invert": _indexed(_find("the", invert=True)),
        "indexed_filter": _indexed(_find("tion", paths=PathFilter(types=("fr",)))),
        "indexed_count": lambda s, d: ops.count_total(indexed.matching(prepared(s, d), _find(REGEX))),
        "indexed_files": lambda s, d: ops.files_with_matches(indexed.matching(prepared(s, d), _find("token"))),
        "indexed_context": _context(_CONTEXT, 1, 1, True),
        "candidate_docs": lambda s, d: indexed.candidate_docs(prepared(s, d), Pattern(REGEX)),
        "candidate_lines": lambda s, d: indexed.candidate_lines(prepared(s, d), Pattern(ALTERNATION)),
        "search_stats": lambda s, d: indexed.search_stats(prepared(s, d), _find(REGEX)),
        "update_diff": update_diff,
        "update_search": lambda s, d: _updated(s, d, lambda i: indexed.search_index(i, _find("und.*der")).drop("doc_id")),
        "compact_search": lambda s, d: _updated(s, d, lambda i: indexed.search_index(maintain.compact(i), _find("und.*der")).drop("doc_id")),
        "binary_detect": binary_detect,
    }
    return out


_PATH = "source || '/' || lang || '/' || doc_id || '.' || lang"


def _lines(table: str = "documents", columns: str = f"doc_id, lang, source, {_PATH} AS path", text: str = "text") -> str:
    return f"""SELECT {columns}, CAST(n AS BIGINT) AS line_number, line FROM
      (SELECT *, string_split({text}, chr(10)) AS parts FROM {table} WHERE {text} IS NOT NULL), unnest(parts) WITH ORDINALITY AS t(line, n)
      WHERE NOT (n = len(parts) AND line = '')"""


def _hits(where: str, columns: str = "doc_id, line_number, line") -> str:
    return f"WITH l AS ({_lines()}) SELECT {columns} FROM l WHERE {where}"


def _around(before: int, after: int, where: str) -> str:
    return f"""WITH l AS ({_lines()}), m AS (SELECT *, {where} AS hit FROM l),
      near AS (SELECT *, max(hit) OVER (PARTITION BY doc_id ORDER BY line_number ROWS BETWEEN {after} PRECEDING AND {before} FOLLOWING) AS wanted FROM m),
      kept AS (SELECT *, coalesce(line_number - lag(line_number) OVER (PARTITION BY doc_id ORDER BY line_number) > 1, true) AS gap FROM near WHERE wanted),
      chunks AS (SELECT *, CAST(sum(CAST(gap AS INT)) OVER (PARTITION BY doc_id ORDER BY line_number) AS BIGINT) AS chunk FROM kept)"""


def oracle_sql() -> dict[str, str]:
    regex, alternation = f"regexp_matches(line, '{REGEX}')", f"regexp_matches(line, '{ALTERNATION}')"
    grams = "SELECT DISTINCT doc_id, line_number AS line_no, byte_offset, substring(line, CAST(i AS BIGINT), 3) AS tri FROM o, generate_series(1, length(line) - 2) AS g(i)"
    offsets = f"WITH l AS ({_lines()}), o AS (SELECT doc_id, line_number, line, CAST(coalesce(sum(octet_length(encode(line)) + 1) OVER (PARTITION BY doc_id ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset FROM l)"
    docs_of = "WITH d AS (SELECT doc_id, source, lang, text FROM documents)"
    counts = f"WITH l AS ({_lines()}) SELECT path, count(*) AS n FROM l WHERE contains(line, 'the') GROUP BY path"
    update = f"WITH l AS ({_lines()}) SELECT path, line_number, line FROM l WHERE regexp_matches(line, 'und.*der')"
    the_and = ["the", "and"]
    return {
        "scan_lines": _hits("true"),
        "search_literal": _hits("contains(line, 'the')"),
        "search_fixed": _hits("contains(line, 'or.')"),
        "search_regex": _hits(regex),
        "search_class": _hits("regexp_matches(line, '[0-9]{3}-[0-9]{4}')"),
        "search_alternation": _hits(alternation),
        "search_ignore_case": _hits("regexp_matches(line, '(?i)THE.*AND')"),
        "search_anchored": _hits(r"regexp_matches(line, '^The .*\.$')"),
        "search_invert": _hits("NOT contains(line, 'the')"),
        "search_multiline": f"WITH l AS ({_lines()}), m AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY line_number) AS after FROM l) SELECT doc_id, line_number, line FROM m WHERE line LIKE '%.' AND after LIKE 'The%'",
        "search_pages": f"WITH l AS ({_lines('pages', 'page_id AS doc_id, url AS path', 'html')}) SELECT doc_id, path, line_number, CASE WHEN line LIKE '%' || chr(13) THEN left(line, length(line) - 1) ELSE line END AS line FROM l WHERE contains(line, '<p>')",
        "search_conversations": f"WITH l AS ({_lines('conversations', 'conv_id AS doc_id, concat_ws(chr(47), conv_id, turn, role) AS path')}) SELECT doc_id, path, line_number, line FROM l WHERE {regex}",
        "only_matching": f"WITH l AS ({_lines()}) SELECT doc_id, line_number, CAST(k AS BIGINT) AS nth, hit AS match FROM l, unnest(regexp_extract_all(line, '[a-z]+tion')) WITH ORDINALITY AS t(hit, k)",
        "count_per_file": counts,
        "count_total": f"WITH l AS ({_lines()}) SELECT count(*) AS n FROM l WHERE contains(line, 'the')",
        "count_invert": f"WITH l AS ({_lines()}) SELECT count(*) AS n FROM l WHERE NOT contains(line, 'the')",
        "count_occurrences": f"WITH l AS ({_lines()}) SELECT path, CAST(sum(len(regexp_extract_all(line, 'tion'))) AS BIGINT) AS n FROM l WHERE contains(line, 'tion') GROUP BY path",
        "files_with_matches": f"WITH l AS ({_lines()}) SELECT DISTINCT path FROM l WHERE contains(line, 'the')",
        "exists_match": "SELECT count(*) > 0 AS found FROM documents WHERE contains(text, 'the')",
        "summary_output": f"SELECT path, path || ':' || n AS output FROM ({counts})",
        "filter_type": _hits("contains(line, 'e') AND lang IN ('de', 'fr')"),
        "filter_include": _hits("contains(line, 'e') AND (source = 'src1' OR lang = 'es')"),
        "filter_exclude": _hits("contains(line, 'e') AND lang <> 'en' AND source <> 'src2'"),
        "filter_subtree": _hits("contains(line, 'e') AND source = 'src1' AND lang = 'en'"),
        "filter_hidden": "SELECT doc_id, source = 'src1' AS hidden, lang AS ext FROM documents",
        "context_before": _around(2, 0, "contains(line, 'token')") + " SELECT doc_id, line_number, line, CASE WHEN hit THEN 'match' ELSE 'context' END AS kind, chunk FROM chunks",
        "context_after": _around(0, 2, "contains(line, 'token')") + " SELECT doc_id, line_number, line, CASE WHEN hit THEN 'match' ELSE 'context' END AS kind, chunk FROM chunks",
        "context_both": _around(1, 2, "contains(line, 'token')") + " SELECT doc_id, line_number, line, CASE WHEN hit THEN 'match' ELSE 'context' END AS kind, chunk FROM chunks",
        "trim_output": f"WITH l AS ({_lines()}) SELECT doc_id, line_number, ltrim(line, concat(' ', chr(9))) AS line FROM l WHERE contains(line, 'the')",
        "format_grep": _around(1, 1, "contains(line, 'token')") + """, rows AS (
          SELECT path, line_number, coalesce(lag(chunk) OVER w <> chunk, false) AS split, path || mark || line_number || mark || line AS output
          FROM (SELECT *, CASE WHEN hit THEN ':' ELSE '-' END AS mark FROM chunks) WINDOW w AS (PARTITION BY path ORDER BY line_number))
          SELECT path, line_number, CAST(split AS BIGINT) AS part, output FROM rows UNION ALL SELECT path, line_number, 0, '--' FROM rows WHERE split""",
        "format_heading": f"""WITH l AS ({_lines()}), h AS (SELECT path, line_number, line, row_number() OVER (PARTITION BY path ORDER BY line_number) = 1 AS first FROM l WHERE contains(line, 'token'))
          SELECT path, line_number, CAST(first AS BIGINT) AS part, line_number || ':' || line AS output FROM h UNION ALL SELECT path, line_number, 0, path FROM h WHERE first""",
        "format_compact": f"""WITH l AS ({_lines()}), h AS (SELECT path, line_number, line, row_number() OVER (PARTITION BY path ORDER BY line_number) = 1 AS first FROM l WHERE contains(line, 'token'))
          SELECT path, line_number, CAST(first AS BIGINT) AS part, line_number || ':' || line AS output FROM h UNION ALL SELECT path, line_number, 0, CASE WHEN path LIKE 'src1/%' THEN substr(path, 6) ELSE path END FROM h WHERE first""",
        "byte_offsets": f"{offsets} SELECT doc_id, line_number, line, byte_offset FROM o",
        "index_postings": f"{offsets} {grams}",
        "index_postings_ci": f"{offsets}, a AS (SELECT doc_id, line_number, lower(line) AS line, byte_offset FROM o WHERE doc_id IN (SELECT doc_id FROM documents WHERE length(text) = octet_length(encode(text)))) SELECT tri, doc_id, line_no FROM ({grams.replace('FROM o', 'FROM a')})",
        "index_doc_sets": f"{offsets} SELECT DISTINCT tri, doc_id FROM ({grams})",
        "index_followers": f"{docs_of} SELECT DISTINCT substring(text, CAST(i AS BIGINT), 3) AS tri, substring(text, CAST(i AS BIGINT) + 3, 1) AS next FROM d, generate_series(1, length(text) - 3) AS g(i)",
        "index_stats": f"{offsets}, p AS ({grams}) SELECT (SELECT count(*) FROM documents) AS docs, count(DISTINCT tri) AS trigrams, count(*) AS postings, count(*) / count(DISTINCT tri) AS per_trigram FROM p",
        "indexed_literal": _hits("contains(line, 'token')"),
        "indexed_regex": _hits(regex),
        "indexed_alternation": _hits(alternation),
        "indexed_ci": _hits("regexp_matches(line, '(?i)token')"),
        "indexed_repetition": _hits(f"regexp_matches(line, '{REPEATED}')"),
        "indexed_fallback_short": _hits("contains(line, 'ü')"),
        "indexed_invert": _hits("NOT contains(line, 'the')"),
        "indexed_filter": _hits("contains(line, 'tion') AND lang = 'fr'"),
        "indexed_count": f"WITH l AS ({_lines()}) SELECT count(*) AS n FROM l WHERE {regex}",
        "indexed_files": f"WITH l AS ({_lines()}) SELECT DISTINCT path FROM l WHERE contains(line, 'token')",
        "indexed_context": _around(1, 1, "contains(line, 'token')") + " SELECT doc_id, line_number, line, CASE WHEN hit THEN 'match' ELSE 'context' END AS kind, chunk FROM chunks",
        "candidate_docs": f"{offsets} SELECT doc_id FROM ({grams}) WHERE tri IN ('{the_and[0]}', '{the_and[1]}') GROUP BY doc_id HAVING count(DISTINCT tri) = 2",
        "candidate_lines": f"WITH l AS ({_lines()}) SELECT doc_id, line_number AS line_no FROM l WHERE contains(line, 'ati') AND contains(line, 'tio') AND contains(line, 'ion') OR contains(line, 'men') AND contains(line, 'ent') OR contains(line, 'eau') AND contains(line, 'aux')",
        "search_stats": f"WITH l AS ({_lines()}), c AS (SELECT * FROM l WHERE contains(line, 'the') AND contains(line, 'and')) SELECT 'lines' AS strategy, (SELECT count(DISTINCT doc_id) FROM c) AS candidate_docs, (SELECT count(*) FROM c) AS candidate_lines, (SELECT count(*) FROM l WHERE {regex}) AS matches, (SELECT count(*) / nullif(count(DISTINCT doc_id), 0) FROM c) AS density",
        "update_diff": f"SELECT {_PATH} AS path, CASE WHEN source = 'src0' THEN 'added' ELSE 'modified' END AS change FROM documents WHERE source = 'src0' OR lang = 'de' UNION ALL SELECT 'gone/' || {_PATH}, 'deleted' FROM documents WHERE source = 'src1'",
        "update_search": update,
        "compact_search": update,
        "binary_detect": "SELECT doc_id, false AS plain, true AS nul, true AS control FROM documents",
    }
