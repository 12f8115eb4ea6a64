"""Near-duplicate documents by MinHash with tensored banding.

Two collections of m half-keys, each made of two minhashes, are formed for each set of
five-word shingles; table key (i, j) combines half-key i of the first with half-key j of
the second.  So 4m minhash functions serve m*m tables.  Two sets share a table exactly
if they share a half-key of either collection.  m is at least 8 and so large that a pair at
the wanted similarity is missed with a chance below 1e-4: 8 at 0.85 (below 4e-6 at 0.9), 10
at 0.80.

Documents of equal sets form a class, and only classes are compared.  Half-keys that one
class alone has are dropped first, as no table key made of them can be shared.  In each
table bucket, members are checked against one hub, the one whose half-keys are the most
common, which all buckets choose alike; links are confirmed on the full sets.  Buckets
whose members are then all in one component are done.  The members of the others are
joined exactly, whatever the size of their buckets: members with so many shingles of their
own that no other set can be similar are peeled off, and of the rest two can only be
similar if they share one of their rarest shingles (of each set as many as it may lack).
Members that such shingles connect form a cluster; it is dealt into blocks of bounded
size, each pair of blocks counts its common shingles in memory, and only links that join
components leave it.  The bounds are exact, and nothing is capped.

Defined results: null and empty texts and texts of white space have no shingles and are
linked with nothing; a text of fewer than five words is one shingle; rows with a null
doc_id get their n_shingles, a null component_id and kept = true, and link nothing;
repeated doc_ids are rows like others, each with its text's component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .columns import append_columns, column, flat, free_names, releasing, sliced
from .components import components
from .storage import Stages
from .wordhash import chunks, mix, run_hashes, word_hashes

SHINGLE = 5
HALF_KEYS = 8  # of each of the two collections, at least
MISS = 1e-4
PER_KEY = 2  # minhashes in a half-key
#: Turns of counting own shingles; more of them only save time.
PEELINGS = 3
#: Shingles of a block (8 bytes each); two blocks are compared in one task.
BLOCK_SHINGLES = 1 << 20
#: Members checked together with one copy of their hub's text.
PER_HUB_COPY = 256


def half_key_count(percent: int) -> int:
    """Half-keys of each collection that a similarity of percent / 100 needs."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be above 0 and at most 100")
    m = HALF_KEYS
    while 1 - (1 - (1 - (percent / 100) ** PER_KEY) ** m) ** 2 >= MISS:
        m += 1
    return m


@cache
def _functions(m: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands of the minhash functions."""
    rng = np.random.default_rng(77)
    return rng.integers(1, 2**63, 2 * m * PER_KEY, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, 2 * m * PER_KEY, dtype=np.uint64)


def shingle_sets(body: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, counts = word_hashes(body, ends, True)
    runs = run_hashes(words, SHINGLE)
    out, at = [], 0
    for n in counts.tolist():
        if n >= SHINGLE:
            x = np.sort(runs[at : at + n - SHINGLE + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        else:
            out.append(run_hashes(words[at : at + n], n) if n else np.zeros(0, np.uint64))
        at += n
    return out


def set_name(sets: list[np.ndarray]) -> list[bytes]:
    """16 bytes that name each set."""
    with np.errstate(over="ignore"):
        return [np.array([mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64)], "<u8").tobytes() for s in sets]


def half_keys(sets: list[np.ndarray], m: int = HALF_KEYS) -> np.ndarray:
    """A row of 2 * m half-keys for each (non-empty) set."""
    multiply, add = _functions(m)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    every, first = np.concatenate(sets), np.cumsum(sizes) - sizes
    out = np.empty((len(sets), 2 * m), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(2 * m):
            key = np.full(len(sets), k, np.uint64)
            for j in range(k * PER_KEY, (k + 1) * PER_KEY):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(every * multiply[j] + add[j], first))
            out[:, k] = key
    return out


def _fingerprint_kernel(m: int):
    def run(column):
        body, at = flat(column)
        names, sizes, keys = [], [], []
        for a, b in chunks(at):
            sets = shingle_sets(body[at[a] : at[b]], at[a + 1 : b + 1] - at[a])
            full = [s for s in sets if len(s)]
            rows = iter(half_keys(full, m).view(np.int64).tolist() if full else [])
            names += set_name(sets)
            sizes += map(len, sets)
            keys += [next(rows) if len(s) else None for s in sets]
        return names, sizes, keys

    return run


_FINGERPRINT = T.StructType([T.StructField("class", T.BinaryType()), T.StructField("n_shingles", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])


def buckets_of(classes: DataFrame, m: int, stages: Stages) -> DataFrame:
    """(bucket, n, c): the classes of each table bucket that holds n > 1 of them; keys that
    can't be shared are never made.  c is the class with its document and set size."""
    halves = classes.select(F.struct("class", "doc_id", "size").alias("c"), F.posexplode("keys").alias("k", "half"))
    # what is joined next is written first, so that a hot key's side can be split
    shared = stages.write(halves.groupBy("k", "half").agg(F.count("*").alias("n")).where("n > 1"))
    kept = halves.join(shared, ["k", "half"]).groupBy("c").agg(F.collect_list(F.struct("k", "half")).alias("halves"), F.sum("n").alias("common"))
    first = F.filter("halves", lambda x: x["k"] < m)
    second = F.filter("halves", lambda x: x["k"] >= m)
    tables = F.flatten(F.transform(first, lambda x: F.transform(second, lambda y: F.xxhash64(x["k"], x["half"], y["k"], y["half"]))))
    rows = stages.write(kept.select("c", "common", F.explode(tables).alias("bucket")))
    many = stages.write(rows.groupBy("bucket").agg(F.count("*").alias("n"), F.max(F.struct("common", "c"))["c"].alias("hub")).where("n > 1"))
    return rows.join(many, "bucket").select("bucket", "n", "c", "hub")


def confirm(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) among `pairs` (a, b, n): those whose full sets have a Jaccard
    similarity of percent / 100 or more. docs: (doc_id, text).

    Each pair carries the text of its b; the text of a goes once to each PER_HUB_COPY of
    the n members of its bucket, so a hub with very many members is spread over tasks.
    """
    fit = pairs.where(F.least("a.size", "b.size") * 100 >= F.greatest("a.size", "b.size") * percent).groupBy("a", "b").agg(F.max("n").alias("n"))
    copy = F.pmod(F.xxhash64("b.class"), F.ceil(F.col("n") / PER_HUB_COPY)).cast("int")
    sent = fit.select("a", "b", copy.alias("copy"))
    members = sent.select(F.col("a.class").alias("a"), "copy", F.lit(False).alias("hub"), F.col("b.class").alias("class"), F.col("b.doc_id").alias("doc_id"))
    hubs = sent.groupBy("a", "copy").agg(F.lit(True).alias("hub")).select(F.col("a.class").alias("a"), "copy", "hub", F.col("a.class").alias("class"), F.col("a.doc_id").alias("doc_id"))
    placed = members.union(hubs).join(docs, "doc_id").select("a", "copy", "hub", "class", "text")
    dealt = placed.repartition("a", "copy").sortWithinPartitions("a", "copy", F.desc("hub"))

    def run(batches: Iterator[pa.RecordBatch]):
        group, hubs = None, []
        for batch in batches:
            for part in sliced(batch, 4):
                body, at = flat(part.column(4))
                found = []
                rows = [part.column(i).to_pylist() for i in range(4)]
                for x, y in chunks(at):
                    sets = shingle_sets(body[at[x] : at[y]], at[x + 1 : y + 1] - at[x])
                    for i, s, name in zip(range(x, y), sets, set_name(sets), strict=True):
                        a, copy, hub, cls = (r[i] for r in rows)
                        if (a, copy) != group:
                            group, hubs = (a, copy), []
                        if name != cls:
                            continue  # another text of a repeated doc_id
                        if hub:
                            hubs = [s]
                        elif hubs:
                            both = np.concatenate((hubs[0], s))
                            both.sort()
                            same = int(np.count_nonzero(both[1:] == both[:-1]))
                            if same * 100 >= percent * (len(both) - same):
                                found.append((a, cls))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found, strict=True)], names=["a", "b"])

    return dealt.mapInArrow(releasing(run), T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])).distinct()


def _set_rows(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for part in sliced(batch, 1):
            names = part.column(0).to_pylist()
            body, at = flat(part.column(1))
            for x, y in chunks(at):
                sets = shingle_sets(body[at[x] : at[y]], at[x + 1 : y + 1] - at[x])
                own = [(names[i], s.view(np.int64)) for i, s, name in zip(range(x, y), sets, set_name(sets), strict=True) if name == names[i]]
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in own], pa.binary()), pa.array([s for _, s in own], pa.list_(pa.int64()))], names=["class", "shingles"])


def unpeeled(members: DataFrame, docs: DataFrame, stages: Stages, percent: int) -> DataFrame:
    """(class, shingles) of the members (class, doc_id) that may be linked with another.

    Of a set of n with u shingles that no other member has, at most n - u can be common, so
    it is peeled off if these are less than percent of n; then the rest is counted anew.  A
    member left in only costs time.
    """
    rows = stages.write(members.join(docs, "doc_id").select("class", "text").mapInArrow(releasing(_set_rows), "class binary, shingles array<long>"))
    for _ in range(PEELINGS):
        alone = rows.select("class", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n"), F.min("class").alias("class")).where("n = 1")
        far = alone.groupBy("class").agg(F.count("*").alias("u")).join(rows.select("class", F.size("shingles").alias("n")), "class").where((F.col("n") - F.col("u")) * 100 < F.col("n") * percent)
        far = stages.write(far.select("class"))
        if far.isEmpty():
            break
        before, rows = rows, stages.write(rows.join(far, "class", "left_anti"))
        stages.drop(before)
    return rows


def _common(x: list[np.ndarray], y: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For runs of rows of x: (first row, how many shingles each shares with each row of y).
    Frequent shingles are counted by a matrix product, others by their lists."""
    ny = len(y)
    rows_y = np.repeat(np.arange(ny), [len(s) for s in y])
    words, col_y = np.unique(np.concatenate(y), return_inverse=True)
    df = np.bincount(col_y, minlength=len(words))
    often = np.flatnonzero(df > max(8, ny // 32))
    dense_at = np.full(len(words), -1)
    dense_at[often] = np.arange(len(often))
    dense = np.zeros((ny, len(often)), np.float32)
    hit = dense_at[col_y] >= 0
    dense[rows_y[hit], dense_at[col_y[hit]]] = 1
    order = np.argsort(col_y, kind="stable")
    lists, first = rows_y[order], np.cumsum(df) - df
    step = max(1, min(512, (1 << 22) // ny))
    for a in range(0, len(x), step):
        part = x[a : a + step]
        rows = np.repeat(np.arange(len(part)), [len(s) for s in part])
        every = np.concatenate(part)
        at = np.minimum(np.searchsorted(words, every), len(words) - 1)
        known = words[at] == every
        rows, at = rows[known], at[known]
        d = dense_at[at]
        left = np.zeros((len(part), len(often)), np.float32)
        left[rows[d >= 0], d[d >= 0]] = 1
        counts = (left @ dense.T).astype(np.int64)
        rows, at = rows[d < 0], at[d < 0]
        n = df[at]
        pick = np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        counts += np.bincount(np.repeat(rows, n) * ny + lists[pick], minlength=len(part) * ny).reshape(len(part), ny)
        yield a, counts


def block_links(names: list[bytes], roots: list[bytes], sides: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[bytes, bytes]]:
    """Links that join components among the members of one block, or of side 0 and side 1:
    no more of them than members."""
    ids = {r: k for k, r in enumerate(dict.fromkeys(roots))}
    root, size = np.array([ids[r] for r in roots]), np.array([len(s) for s in sets])
    if sides.any():
        xs, ys = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
    else:  # a pair across components has a member outside the largest one
        xs, ys = np.flatnonzero(root != np.bincount(root).argmax()), np.arange(len(names))
    if not len(xs) or not len(ys):
        return []
    above = list(range(len(ids)))

    def find(k: int) -> int:
        while above[k] != k:
            above[k] = k = above[above[k]]
        return k

    out = []
    for a, counts in _common([sets[i] for i in xs], [sets[i] for i in ys]):
        rows = xs[a : a + len(counts)]
        linked = (counts * 100 >= percent * (size[rows][:, None] + size[ys] - counts)) & (root[rows][:, None] != root[ys])
        for i, j in zip(*np.nonzero(linked), strict=True):
            p, q = find(int(root[rows[i]])), find(int(root[ys[j]]))
            if p != q:
                above[p] = q
                out.append((names[rows[i]], names[ys[j]]))
    return out


def clusters_of(known: DataFrame, stages: Stages, percent: int) -> DataFrame:
    """(class, cluster): members that their rarest shingles connect over components; others
    can have no link that joins any. known: (class, of, shingles).

    In the order of how many members hold them, each set of n has n - ceil(n * percent / 100)
    + 1 rarest shingles; of two similar sets, each lacks fewer of the other's, so they share
    one of these.
    """
    each = known.select("class", "of", F.explode("shingles").alias("s"))
    common = stages.write(each.groupBy("s").agg(F.count("*").alias("n"), F.min("of").alias("low"), F.max("of").alias("high")))
    order = each.join(common, "s").groupBy("class").agg(F.array_sort(F.collect_list(F.struct("n", "s", (F.col("low") < F.col("high")).alias("mixed")))).alias("all"))
    may_lack = (F.size("all") - F.ceil(F.size("all") * F.lit(percent) / 100) + 1).cast("int")
    rare = stages.write(order.select("class", F.explode(F.slice("all", F.lit(1), may_lack)).alias("x")).where("x.mixed").select("class", F.col("x.s").alias("s")))
    low = stages.write(rare.groupBy("s").agg(F.min("class").alias("low")))
    roots = components(rare.join(low, "s").select(F.col("class").alias("a"), F.col("low").alias("b")), stages)
    return roots.select(F.col("node").alias("class"), F.col("root").alias("cluster")).union(roots.select("root", "root")).distinct()


def cluster_links(open_: DataFrame, docs: DataFrame, stages: Stages, percent: int) -> DataFrame:
    """Links (a, b) across components of the members of open buckets. open_: (c, root)."""
    members = stages.write(open_.select(F.col("c.class").alias("class"), F.col("c.doc_id").alias("doc_id"), F.col("root").alias("of")).distinct())
    sets = unpeeled(members.select("class", "doc_id"), docs, stages, percent)
    sets = stages.write(sets.join(members.select("class", "of"), "class").select("class", "of", "shingles"))
    known = stages.write(sets.join(clusters_of(sets, stages, percent), "class").select("class", "of", "cluster", "shingles"))
    blocks = known.groupBy("cluster").agg(F.ceil(F.sum(F.size("shingles")) / BLOCK_SHINGLES).cast("int").alias("blocks"), F.countDistinct("of").alias("roots")).where("roots > 1")
    own = F.pmod(F.xxhash64("class"), F.col("blocks").cast("long")).cast("int")
    placed = known.join(blocks, "cluster").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    dealt = placed.select("cluster", i, j, (F.col("own") > F.col("other")).alias("second"), "class", "of", "shingles").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]):
        key, names, roots, sides, sets = None, [], [], [], []

        def links():
            found = block_links(names, roots, np.array(sides, np.int64), sets, percent) if names else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found, strict=True)], names=["a", "b"])

        for batch in batches:
            lists = batch.column(6)
            values, at = np.asarray(lists.values), np.asarray(lists.offsets)
            for k, now in enumerate(zip(*[batch.column(c).to_pylist() for c in range(6)], strict=True)):
                if now[:3] != key:
                    yield from links()
                    key, names, roots, sides, sets = now[:3], [], [], [], []
                names.append(now[4])
                roots.append(now[5])
                sides.append(int(now[3]))
                sets.append(values[at[k] : at[k + 1]].copy())
        yield from links()

    return dealt.mapInArrow(releasing(run), "a binary, b binary")


def group_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, with_text_key: bool = False) -> DataFrame:
    """A row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id of the
    documents that links reach), kept (doc_id = component_id); with_text_key adds
    text_key, xxhash64 of the text, and root, which names the group (null for rows that
    link nothing)."""
    stages, m = Stages(docs.sparkSession), half_key_count(percent)
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    key = ["text_key"] * with_text_key
    prints = stages.write(append_columns(docs.withColumn("text_key", F.xxhash64("text")), "text", _FINGERPRINT, lambda: _fingerprint_kernel(m), ["doc_id", *key]))
    linked = prints.where("doc_id is not null and n_shingles > 0")
    # equal sets have equal keys, so any row's will do
    classes = stages.write(linked.groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("size"), F.first("keys").alias("keys")))
    buckets = stages.write(buckets_of(classes, m, stages))

    inner = buckets.where("c <> hub")
    links = stages.write(confirm(inner.select(F.col("hub").alias("a"), F.col("c").alias("b"), "n"), docs, percent))
    roots = components(links, stages)
    # every member was compared with the hub; what is left are pairs of the others
    at = inner.join(roots, inner["c.class"] == roots["node"], "left").select("bucket", "c", F.coalesce("root", "c.class").alias("root"))
    at = stages.write(at)
    open_ = at.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    rest = stages.write(at.join(stages.write(open_), "bucket").select("c", "root").distinct())
    found = None if rest.isEmpty() else stages.write(cluster_links(rest, docs, stages, percent))
    if found is not None and not found.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found), stages)
    groups = classes.join(roots, classes["class"] == roots["node"], "left").select("class", "doc_id", F.coalesce("root", "class").alias("root"))
    least = groups.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    root = ["root"] * with_text_key
    of_class = groups.join(least, "root").select("class", "component_id", *root)
    alone = prints.where("doc_id is null or n_shingles = 0").select("doc_id", *key, "n_shingles", F.col("doc_id").alias("component_id"), *[F.lit(None).cast("binary").alias(c) for c in root])
    out = linked.join(of_class, "class").select("doc_id", *key, "n_shingles", "component_id", *root).union(alone)
    return out.select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """docs with one document of each group, that of the smallest id and, where rows of a
    group repeat it, of the least text_key; of rows that repeat an id and a text one stays.
    Rows of one id in different groups each stay for their group.  Rows with a null id stay.  Columns are those of docs."""
    groups = group_near_duplicates(docs, id_col, text_col, percent, True)
    kept = groups.where("kept and doc_id is not null").groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("rows"))
    least = kept.where("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "text_key", "rows")).alias("k")).select("k.*")
    kid, kkey, krows, place = free_names(docs, "__kept_id", "__kept_key", "__rows", "__at")
    kept = least.union(kept.where("root is null").select("doc_id", "text_key", "rows")).toDF(kid, kkey, krows)
    same = (column(id_col) == F.col(kid)) & F.xxhash64(column(text_col).cast("string")).eqNullSafe(F.col(kkey))
    out = docs.where(column(id_col).isNotNull()).join(kept, same)
    one = F.row_number().over(Window.partitionBy(kid, kkey).orderBy(krows))
    once, again = out.where(F.col(krows) == 1), out.where(F.col(krows) > 1).withColumn(place, one).where(F.col(place) == 1)
    names = [column(c) for c in docs.columns]
    return once.select(names).union(again.select(names)).union(docs.where(column(id_col).isNull()).select(names))
