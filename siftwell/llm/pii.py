"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Base spans come from one pattern per kind (email, ip, card, phone) with its check.  They
seed the bootstrap: a base span with all its tokens is an instance of the span's text, and
so is every other run of tokens with a digit that only blanks and phone punctuation part,
and every other token with an @.  A token begins after white space or a label's = or :.
The words around an instance, whatever they hold, are its lexical patterns (the two words
before it, the word before, the word after, and both neighbours), and patterns and
instances form a graph.  Spark scores the graph in rounds:

    pattern  = sum of its different instances' scores / (their number + SMOOTHING)

Base seeds score 1.  A pattern of score CONFIDENT or more that at least SUPPORT different
seeds of one kind back, and most of its seeds, is of this kind.  The other instances that
it holds are promoted: they become seeds of its kind with their best pattern's score, and
all patterns are scored anew, until a round brings no instance and
no pattern more and their mean score doesn't rise by a hundredth.  Then confident patterns
mark unseen instances, where no base span lies, as spans of kind ctx_<kind>.  Counts are
over all documents, combined before they are shuffled.

Offsets count code points, ends are exclusive.  A match's place is the length of what
`split` leaves before it plus that of earlier matches, so no row leaves the JVM.  The
patterns are written so that no text makes them quadratic: where a run of characters
must begin a match, it is entered only at its start or where the last match ended, and
runs are possessive; each says the same as the plain pattern in BASE.

Defined results: null and empty texts have no spans; repeated rows and null ids each get
their row; equal texts under one id have equal spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrays import running
from .columns import column, free_names
from .storage import Stages

# The base patterns, as the contract gives them.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The same matches, without quadratic ways.
FAST = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(BASE)
SMOOTHING = 2.0
CONFIDENT = 0.6
SUPPORT = 5
_TOKEN = r"(?<![^\s=:])[^\s0-9@=:]*+[0-9@]\S*+"
#: What may part the tokens of one number.
_JOINT = r"^[\x20\t().-]+$"

def _found(text: Column, pattern: str, sign: Column, name: str) -> list[Column]:
    """The pattern's matches and the gaps around them; none without the sign."""
    none = F.array().cast("array<string>")
    return [F.when(sign, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none).alias(f"{name}_m"), F.when(sign, F.split(text, pattern, -1)).otherwise(none).alias(f"{name}_g")]


def _ends(name: str) -> Column:
    steps = F.zip_with(f"{name}_m", F.slice(f"{name}_g", F.lit(1), F.size(f"{name}_m")), lambda m, g: F.length(m) + F.length(g))
    return F.when(F.size(f"{name}_m") > 0, running(steps)).otherwise(F.array().cast("array<int>")).alias(f"{name}_e")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Sum from the right, every second digit doubled, is a multiple of 10."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, (d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int")).otherwise(d.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(_digits(value)).between(16, 19) & _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _base(kind: str) -> Column:
    """array<struct<start, end>> of the kind's matches that pass its check."""
    rows = F.zip_with(f"{kind}_m", f"{kind}_e", lambda m, e: F.named_struct(F.lit("start"), e - F.length(m), F.lit("end"), e, F.lit("ok"), _valid(kind, m)))
    return F.transform(F.filter(rows, lambda r: r["ok"]), lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"))).alias(kind)


def _tokens() -> Column:
    """array of the tokens with a digit or an @, for `_instances`, with the words around each;
    a token is itself one word of its neighbours' surroundings."""
    token, gap = lambda i: F.coalesce(F.get("token_m", i), F.lit("")), lambda i: F.coalesce(F.get("token_g", i), F.lit(""))

    def row(m: Column, i: Column) -> Column:
        end = F.get("token_e", i)
        left = F.concat(gap(i - 2), token(i - 2), gap(i - 1), token(i - 1), gap(i))
        right = F.concat(gap(i + 1), token(i + 1))
        joins = gap(i).rlike(_JOINT) & ~F.contains(m, F.lit("@")) & ~F.contains(token(i - 1), F.lit("@"))
        return _part(end, False, end - F.length(m), end, F.lower(m), F.lower(F.regexp_extract(left, r"(?<!\S)(\S++)\s*+$", 1)), F.lower(F.regexp_extract(left, r"(?<!\S)(\S++\s++\S++)\s*+$", 1)), F.lower(F.regexp_extract(right, r"^\s*+(\S++)", 1)), joins)

    return F.transform("token_m", row)


def _part(at: Column, is_span: bool, start: Column, end: Column, value: Column, before: Column, before2: Column, after: Column, joins: Column, kind: str = "") -> Column:
    named = {"at": at, "is_span": F.lit(is_span), "start": start, "end": end, "value": value, "before": before, "before2": before2, "after": after, "joins": joins, "kind": F.lit(kind), "turn": F.lit(-KINDS.index(kind) if kind else 0)}
    return F.named_struct(*[c for k, v in named.items() for c in (F.lit(k), v)])


def _valued(kind: str) -> Column:
    """The kind's base spans with their text, as parts like the tokens."""
    none = F.lit("")
    rows = F.filter(F.zip_with(f"{kind}_m", f"{kind}_e", lambda m, e: F.named_struct(F.lit("m"), m, F.lit("e"), e)), lambda r: _valid(kind, r["m"]))
    return F.transform(rows, lambda r: _part(r["e"] - F.length(r["m"]), True, r["e"] - F.length(r["m"]), r["e"], F.lower(r["m"]), none, none, none, F.lit(False), kind))


def _instances(found: DataFrame) -> DataFrame:
    """(doc_id, text_key, start, end, value, before, before2, after, kind): the instances,
    kind being that of their base span, or null.

    A token's span is the one that ends last of those that start before the token's end.
    Tokens that one span covers are one instance, as are tokens of no span that join.
    """
    rows = found.where("size(parts) > 0").select("doc_id", "text_key", "parts", F.monotonically_increasing_id().alias("row")).select("row", "doc_id", "text_key", F.explode("parts").alias("p")).select("row", "doc_id", "text_key", "p.*")
    order = Window.partitionBy("row").orderBy("at", "is_span")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(F.col("is_span"), F.struct("end", "turn", "kind", "value"))).over(so_far)
    tokens = rows.withColumn("reach", reach).where("not is_span").withColumn("seed", F.when(F.col("reach.end") > F.col("start"), F.col("reach")))
    one_span = F.coalesce(F.lag("reach.end").over(order) > F.col("start"), F.lit(False))
    joined = F.col("joins") & F.col("seed").isNull() & F.lag("seed").over(order).isNull()
    runs = tokens.withColumn("opens", F.when(one_span | joined, 0).otherwise(1)).withColumn("run", F.sum("opens").over(so_far))
    made = runs.groupBy("row", "doc_id", "text_key", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.max("seed").alias("seed"), F.collect_list(F.struct("start", "value")).alias("texts"),
        F.min_by(F.struct("before", "before2"), "start").alias("b"), F.max_by("after", "start").alias("after"),
    )
    text = F.array_join(F.transform(F.array_sort("texts"), lambda t: t["value"]), " ")
    return made.select("doc_id", "text_key", "start", "end", F.coalesce("seed.value", text).alias("value"), "b.before", "b.before2", "after", F.col("seed.kind").alias("kind"))


def _spans_and_parts(source: DataFrame) -> DataFrame:
    """(doc_id, text_key, base, parts: the tokens and the base spans) of (doc_id, text); each
    step is a projection of its own, so that no pattern runs twice."""
    text = F.col("text")
    marked = source.select("doc_id", "text", F.xxhash64("text").alias("text_key"), text.rlike("[0-9]").alias("digit"), F.contains(text, F.lit("@")).alias("at"))
    sign = {"email": F.col("at"), "ip": F.col("digit") & F.contains(text, F.lit(".")), "card": F.col("digit"), "phone": F.col("digit") & F.contains(text, F.lit("+"))}
    matched = marked.select("doc_id", "text_key", *[c for k in KINDS for c in _found(text, FAST[k], sign[k], k)], *_found(text, _TOKEN, F.col("digit") | F.col("at"), "token"))
    placed = matched.select("*", *map(_ends, (*KINDS, "token")))
    return placed.select("doc_id", "text_key", F.struct(*map(_base, KINDS)).alias("base"), F.concat(_tokens(), *map(_valued, KINDS)).alias("parts"))


def _patterns() -> Column:
    """The lexical patterns of an instance: `a b _`, `b _ c`, `b _` and `_ c`."""
    b, a = F.col("before"), F.col("after")
    left, right = F.concat(b, F.lit(" _")), F.concat(F.lit("_ "), a)
    every = F.array(F.when(F.col("before2") != "", F.concat("before2", F.lit(" _"))), F.when((b != "") & (a != ""), F.concat(b, F.lit(" "), right)), F.when(b != "", left), F.when(a != "", right))
    return F.array_distinct(F.filter(every, lambda p: p.isNotNull()))


def confident_patterns(edges: DataFrame, stages: Stages) -> DataFrame:
    """(pattern, kind). edges: (pattern, value, kind), one for each different pair, kind being
    that of the base seed that the instance is, or null.

    Each round scores all patterns from the present seeds; values that a confident pattern
    holds become seeds themselves, of its kind and with its score, so that the contexts in
    which they recur can become patterns in the next round.  It ends with a round that brings
    nothing more; seeds and their scores only ever grow.
    """
    edges = stages.write(edges)
    # a pattern of fewer values can never have SUPPORT different seeds
    often = stages.write(edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT).select("pattern"))
    edges = stages.write(edges.join(often, "pattern"))
    base = stages.write(edges.where("kind is not null").groupBy("value").agg(F.max("kind").alias("seed"), F.lit(1.0).alias("score"), F.lit(0).alias("turn")))
    promoted, before, turn = base.limit(0), None, 0
    while True:
        turn += 1
        marked = stages.write(edges.select("pattern", "value").join(base.union(promoted), "value", "left"))
        support = [F.count(F.when(F.col("seed") == k, 1)).alias(k) for k in KINDS]
        scored = marked.groupBy("pattern").agg((F.sum(F.coalesce("score", F.lit(0.0))) / (F.count("*") + SMOOTHING)).alias("p"), *support)
        best = F.greatest(*[F.struct(F.col(k).alias("seeds"), F.lit(-i).alias("turn"), F.lit(k).alias("kind")) for i, k in enumerate(KINDS)])
        clear = (F.col("best.seeds") >= SUPPORT) & (F.col("best.seeds") * 2 > sum(map(F.col, KINDS[1:]), F.col(KINDS[0])))
        sure = stages.write(scored.where(F.col("p") >= CONFIDENT).withColumn("best", best).where(clear).select("pattern", F.col("best.kind").alias("kind"), "p"))
        held = marked.where("turn is null or turn > 0").join(sure, "pattern").groupBy("value").agg(F.max(F.struct("p", "kind")).alias("m"))
        held = held.select("value", F.col("m.kind").alias("seed"), F.col("m.p").alias("score"), F.lit(turn).alias("turn"))
        # a promoted value keeps its first kind; its score only grows
        grown = promoted.union(held).groupBy("value").agg(F.min(F.struct("turn", "seed")).alias("t"), F.max("score").alias("score"))
        promoted = stages.write(grown.select("value", "t.seed", "score", "t.turn"))
        now = *promoted.agg(F.count("*"), F.floor(100 * F.avg("score"))).first(), sure.count()
        if now == before or not now[0]:
            return sure.select("pattern", "kind")
        before = now
        stages.drop(marked)


def _tagged(kind: str) -> Column:
    """The kind's base spans as struct<start, end, kind>."""
    return F.transform(F.col(f"base.{kind}"), lambda s: F.named_struct(F.lit("start"), s["start"], F.lit("end"), s["end"], F.lit("kind"), F.lit(kind)))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, text_key, base: struct of the kinds' span arrays, and
    extra: array<struct<start, end, kind>> of what the bootstrap adds, in order."""
    stages = Stages(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    found = stages.write(_spans_and_parts(source))

    rows = _instances(found).select("doc_id", "text_key", "start", "end", "value", "kind", F.explode(_patterns()).alias("pattern"))
    rows = stages.write(rows)
    edges = rows.groupBy("pattern", "value").agg(F.max("kind").alias("kind"))
    sure = confident_patterns(edges, stages)
    new = rows.where("kind is null").drop("kind").join(sure, "pattern").groupBy("doc_id", "text_key", "start", "end").agg(F.min("kind").alias("kind"))
    new = new.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("start", "end", F.concat(F.lit("ctx_"), F.col("kind")).alias("kind")))).alias("extra"))
    n = new.select(F.col("doc_id").alias("__pii_id"), F.col("text_key").alias("__pii_key"), "extra")
    joined = found.drop("parts").join(n, F.col("doc_id").eqNullSafe(F.col("__pii_id")) & (F.col("text_key") == F.col("__pii_key")), "left")
    return joined.select("doc_id", "text_key", "base", F.coalesce("extra", F.array().cast("array<struct<start:int,end:int,kind:string>>")).alias("extra"))


def span_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans for each row of docs."""
    found = find_personal_data(docs, id_col, text_col)
    text = lambda k: F.transform(F.col(f"base.{k}"), lambda s: F.concat_ws(":", F.lit(k), s["start"].cast("string"), s["end"].cast("string")))
    base = F.flatten(F.array(*[text(k) for k in KINDS]))
    extra = F.array_sort(F.transform("extra", lambda s: F.struct(s["kind"].alias("k"), s["start"].alias("s"), s["end"].alias("e"))))
    added = F.transform(extra, lambda s: F.concat_ws(":", s["k"], s["s"].cast("string"), s["e"].cast("string")))
    return found.select(
        "doc_id",
        *[F.size(F.col(f"base.{k}")).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.concat_ws(",", base), 256).alias("base_sha256"),
        F.concat_ws(",", F.concat(base, added)).alias("spans"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each span in `text_col` replaced by [KIND]; spans that overlap become one,
    of the kind that starts first.  All columns and rows stay; null texts stay null."""
    fid, fkey, fspans = free_names(docs, "__pii_id", "__pii_key", "__pii_spans")
    found = find_personal_data(docs, id_col, text_col).dropDuplicates(["doc_id", "text_key"])
    every = found.select(F.col("doc_id").alias(fid), F.col("text_key").alias(fkey), F.array_sort(F.concat(*map(_tagged, KINDS), F.col("extra"))).alias(fspans)).where(F.size(fspans) > 0)
    text = column(text_col)
    marked = docs.join(every, column(id_col).eqNullSafe(F.col(fid)) & (F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))) == F.col(fkey)), "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        label = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        grown = F.concat(acc["out"], text.substr(acc["at"] + 1, s["start"] - acc["at"]), label)
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), grown.alias("out"))).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    clean = F.aggregate(fspans, start, step, lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))))
    return marked.select(*[F.when(F.col(fspans).isNull(), text).otherwise(clean).alias(text_col) if c == text_col else column(c) for c in docs.columns])
