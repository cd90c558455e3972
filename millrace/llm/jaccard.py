"""Jaccard join over word n-gram sets by a token-group matrix.

Documents with equal n-gram sets are one class; copies are never expanded into pairs. Similar classes are partitioned
into groups: each goes to the most frequent of its band keys (a band key is a hash of a few min-hashes); a key whose
classes have more than ``GROUP_GRAMS`` n-grams is split by a hash of the class. The token-group matrix has a row a
group: its token union with postings to its members, and their sizes, stored once as a table. A class queries every group it
shares a band key with, in one direction. Sizes bound first: a query whose size is out of reach of all members is
never sent. Of those that are, the overlap with the stored union bounds the similarity to any member, and only then a
group is opened: the query's tokens are counted through the postings, which gives exact similarities to all members.
So links are exact, and what can be missed is only a link whose classes share no band key: (1 - s**3)**36 of those of
similarity s, 0.8 % at 0.5. There is no cap on candidates or partners. Every document is a query.

Scale: the text is moved once at most (only documents that share a key with another), all else are hashes. Keys, groups and
links are counted by aggregates with map-side combining, never in a window, so a hot key is no single task. A group holds about
``GROUP_GRAMS`` n-grams, however long its texts; the queries of a group are streamed past it, and above ``QUERY_GRAMS``
they are spread over copies of its row.

Defined results
* a document is a distinct (doc_id, text); it is reported in one row, however often it is repeated, with ``class_id``, the smallest doc_id
  that links lead to, ``copies``, the other documents of equal n-grams, and ``links``, all other documents of
  similarity percent/100 or more, copies among them;
* texts without words and documents without doc_id have no links (class_id is their own doc_id), and ``one_of_each``
  keeps them; a text of fewer than n words has one n-gram, all of it;
* rows equal in doc_id and text are one document repeated, and one of them stays in ``one_of_each``;
* ties: the member with the smallest doc_id (then text hash) stays; columns pass through untouched; empty tables give
  empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, stage, table, text_key
from .words import WORD_RE2, Words, finish, lists, ngram_hash, pieces, signed, strings

N, PERCENT = 3, 50
BANDS, ROWS = 36, 3
GROUP_GRAMS, QUERY_GRAMS = 1_000_000, 8_000_000
#: Key tables of at most so many rows (of 40 bytes) are broadcast; larger ones are joined by a shuffle, to the same effect.
BROADCAST_ROWS = 200_000
_OUT_BYTES = 4 << 20

_A = np.random.default_rng(7).integers(0, 2**32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = np.random.default_rng(8).integers(0, 2**32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)


def gram_sets(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct n-gram hashes) of each text that has words."""
    for at, part in pieces(strings(texts)):
        w = Words(part)
        g = ngram_hash(w.hash, n) if len(w.hash) >= n else np.zeros(0, np.uint64)
        for i in range(len(part)):
            a, b = int(w.first[i]), int(w.first[i + 1])
            if b - a >= n:
                yield at + i, np.unique(g[a : b - n + 1])
            elif b > a:
                yield at + i, ngram_hash(w.hash[a:b], b - a)


def band_keys(grams: np.ndarray) -> np.ndarray:
    x = (grams ^ (grams >> np.uint64(32))).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 4096):
        h = x[i : i + 4096] * _A[:, None]
        h ^= h >> np.uint32(15)
        h *= _B[:, None] | np.uint32(1)
        np.minimum(least, h.min(axis=1), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for m in least.reshape(BANDS, ROWS).T:
        key = finish(key * np.uint64(0x9E3779B97F4A7C15) + m)
    return key


def _set_id(grams: np.ndarray) -> np.uint64:
    return finish(np.array([finish(grams).sum(dtype=np.uint64) + np.uint64(len(grams))]))[0]


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, text_key, sid, size, bands), a row a row: sid is the same for equal sets, null without words or doc_id."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.when(F.col("doc_id").isNotNull(), F.col("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.num_rows
            rows, sids, sizes, bands = [], np.zeros(m, np.uint64), np.zeros(m, np.int32), []
            for i, g in gram_sets(b.column("text"), n):
                rows.append(i)
                sids[i], sizes[i] = _set_id(g), len(g)
                bands.append(band_keys(g))
            flat = signed(np.concatenate(bands)) if bands else np.zeros(0, np.int64)
            first = np.concatenate([[0], np.cumsum(sizes > 0)]) * BANDS
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array(signed(sids), mask=sizes == 0), pa.array(sizes), lists(flat, first, pa.int64())], names=["doc_id", "text_key", "sid", "size", "bands"]
            )

    return in_arrow(d, run, "doc_id bigint, text_key bigint, sid bigint, size int, bands array<bigint>")


# --- the matrix


class Group:
    """A group's members (classes with their numbers of documents and n-grams) and its token union with postings."""

    def __init__(self, sids: np.ndarray, docs: np.ndarray, sizes: np.ndarray, union: np.ndarray, at: np.ndarray, members: np.ndarray):
        self.sids, self.docs, self.sizes, self.union, self.at, self.members = sids, docs, sizes, union, at, members

    @classmethod
    def of(cls, sids: list[int], docs: list[int], sets: list[np.ndarray]) -> Group:
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        members = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)[order]
        tokens = tokens[order]
        at = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        return cls(np.array(sids, np.int64), np.array(docs, np.int64), sizes, tokens[at], np.append(at, len(tokens)), members)

    def bytes(self) -> bytes:
        head = np.array([len(self.sids), len(self.union), len(self.members)], dtype=np.int64)
        return b"".join(x.tobytes() for x in (head, self.sids, self.docs, self.sizes, self.union, self.at.astype(np.int64), self.members))

    @classmethod
    def read(cls, blob) -> Group:  # noqa: ANN001 - a buffer
        m, u, p = np.frombuffer(blob, np.int64, 3).tolist()
        whole = np.frombuffer(blob, np.int64, 3 + 3 * m + 2 * u + 1)
        cut = np.cumsum([3, m, m, m, u])
        sids, docs, sizes, union, at = np.split(whole, cut)[1:]
        return cls(sids, docs, sizes, union.view(np.uint64), at, np.frombuffer(blob, np.int32, p, 8 * len(whole)))

    def query(self, grams: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray] | None:
        """(members, shared tokens) of similarity percent or more, or None where the bound closes the group."""
        j = np.minimum(np.searchsorted(self.union, grams), len(self.union) - 1)
        j = j[self.union[j] == grams]
        if len(j) * 100 < percent * len(grams):
            return None
        return self._open(j, len(grams), percent)

    def _open(self, j: np.ndarray, size: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        a, n = self.at[j], self.at[j + 1] - self.at[j]
        where = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        shared = np.bincount(self.members[where], minlength=len(self.sids))
        ok = np.flatnonzero((shared * (100 + percent) >= percent * (self.sizes + size)) & (shared > 0))
        return ok, shared[ok]

    def own(self, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(member, later members that are similar, shared tokens)."""
        if len(self.sids) < 2:
            return
        tokens = np.repeat(np.arange(len(self.union)), np.diff(self.at))[np.argsort(self.members, kind="stable")]
        first = np.concatenate([[0], np.cumsum(self.sizes)])
        for i in range(len(self.sids)):
            ok, shared = self._open(tokens[first[i] : first[i + 1]], int(self.sizes[i]), percent)
            later = ok > i
            yield i, ok[later], shared[later]


def _matrix(sets: DataFrame) -> DataFrame:
    """(gid, sid, docs, grams) to (gid, matrix): a row a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gid, sids, docs, rows = None, [], [], []
        made: list[tuple[int, bytes]] = []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.binary())], names=["gid", "matrix"])
            made.clear()
            return out

        size = 0
        for b in batches:
            for g, s, d, x in zip(*(b.column(c).to_pylist() for c in ("gid", "sid", "docs")), b.column("grams")):
                if g != gid:
                    if sids:
                        made.append((gid, Group.of(sids, docs, rows).bytes()))
                        size += len(made[-1][1])
                        if size > _OUT_BYTES:
                            yield flush()
                            size = 0
                    gid, sids, docs, rows = g, [], [], []
                if not sids or sids[-1] != s:
                    sids.append(s)
                    docs.append(d)
                    rows.append(np.frombuffer(x.as_buffer(), dtype=np.uint64).copy())
        if sids:
            made.append((gid, Group.of(sids, docs, rows).bytes()))
        yield flush()

    return in_arrow(sets.repartition("gid").sortWithinPartitions("gid", "sid"), run, "gid bigint, matrix binary")


class _Forest:
    """Union-find over what one group has joined."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[a] = b
        return a != b

    def root(self, a: int) -> int:
        while (u := self.up.get(a, a)) != a:
            self.up[a] = a = self.up.get(u, u)
        return a


def _answers(percent: int, every: bool):
    """Rows (gid, salt, matrix or null, sid, docs, grams), ordered by gid and salt, a group's matrix first, to links: a row (a, null,
    classes, documents) a class and group, of how many similar classes and documents it has there, and rows (a, b, shared, total)
    of similar classes, as many as join them, or ``every`` one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, group, joined = None, None, _Forest()
        classes = documents = np.zeros(0, np.int64)
        out: list[list] = [[], [], [], []]

        def add(a, b, c, d) -> None:  # noqa: ANN001
            for to, x in zip(out, (a, b, c, d)):
                to.append(x)

        def found(sid: int, docs: int, size: int, ok: np.ndarray, shared: np.ndarray) -> None:
            if not len(ok):
                return
            classes[ok] += 1
            documents[ok] += docs
            add(sid, None, len(ok), int(group.docs[ok].sum()))
            for k, n in zip(ok.tolist(), shared.tolist()):
                if (b := int(group.sids[k])) and (joined.join(sid, b) or every):
                    add(sid, b, n, int(group.sizes[k]) + size - n)

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b", "n", "m"])
            for x in out:
                x.clear()
            return batch

        def close() -> None:
            for k in np.flatnonzero(classes).tolist():
                add(int(group.sids[k]), None, int(classes[k]), int(documents[k]))

        for b in batches:
            for g, s, blob, sid, docs, grams in zip(*(b.column(c).to_pylist() for c in ("gid", "salt")), b.column("matrix"), *(b.column(c).to_pylist() for c in ("sid", "docs")), b.column("grams")):
                if (g, s) != of:
                    if group is not None:
                        close()
                    of, group, joined = (g, s), None, _Forest()
                if blob.is_valid:
                    group = Group.read(blob.as_buffer().to_pybytes())
                    classes, documents = np.zeros(len(group.sids), np.int64), np.zeros(len(group.sids), np.int64)
                    for i, ok, shared in group.own(percent) if s == 0 else ():
                        found(int(group.sids[i]), int(group.docs[i]), int(group.sizes[i]), ok, shared)
                        if len(out[0]) > 100_000:
                            yield flush()
                else:
                    x = np.frombuffer(grams.as_buffer(), dtype=np.uint64)
                    if (hit := group.query(x, percent)) is not None:
                        found(sid, docs, len(x), *hit)
                if len(out[0]) > 100_000:
                    yield flush()
        if group is not None:
            close()
        yield flush()

    return run


def _sets(texts: DataFrame, n: int) -> DataFrame:
    """(gid, sid, docs, text) to (gid, sid, docs, grams): each set as sorted 64-bit values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(gram_sets(b.column("text"), n))
            pick = pa.array([i for i, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pick) for c in ("gid", "sid", "docs")), pa.array([g.tobytes() for _, g in found], pa.binary())], names=["gid", "sid", "docs", "grams"])

    return in_arrow(texts, run, "gid bigint, sid bigint, docs bigint, grams binary")


def class_links(docs: DataFrame, sigs: DataFrame, n: int, percent: int, every: bool = False) -> DataFrame:
    """What ``_answers`` gives of all classes, staged."""
    classes = stage(sigs.filter("sid is not null").groupBy("sid").agg(F.min(F.struct("doc_id", "text_key", "bands", "size")).alias("x"), F.countDistinct("doc_id", "text_key").alias("docs")).select("sid", "docs", "x.*"), "classes")
    each = classes.select("sid", "size", F.explode("bands").alias("key"))
    # of a key: its classes and all their n-grams; only keys of several classes go on
    often = stage(each.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("size").cast("long")).alias("grams")).filter("n > 1"), "often")
    keys = stage(each.join(often, "key").select("sid", "size", "key", "n", "grams"), "keys")
    top = keys.groupBy("sid", "size").agg(F.max(F.struct("n", "key", "grams")).alias("top"))
    parts = F.ceil(F.col("top.grams") / GROUP_GRAMS)
    groups = stage(top.select("sid", "size", F.xxhash64("top.key", F.pmod(F.xxhash64("sid"), parts)).alias("gid")), "groups")
    reach = groups.groupBy("gid").agg(F.min("size").alias("least"), F.max("size").alias("most"), F.count("*").alias("members"))
    matrix = keys.select("sid", "key").join(groups, "sid")
    rows = matrix.select("key", F.col("gid").alias("g")).distinct().join(reach.withColumnRenamed("gid", "g"), "g")
    within = (F.col("size") * 100 >= percent * F.col("least")) & (F.col("most") * 100 >= percent * F.col("size"))
    asks = stage(matrix.join(rows, "key").filter((F.col("g") > F.col("gid")) & within).select("sid", "size", F.col("g").alias("gid")).distinct(), "asks")
    # a group of one class that nobody asks and that asks nobody has nothing to compare
    asked = asks.groupBy("gid").agg(F.ceil(F.sum(F.col("size").cast("long")) / QUERY_GRAMS).cast("int").alias("salts"))
    live = groups.join(reach.filter("members > 1").select("gid").unionByName(asked.select("gid")).distinct(), "gid", "left_semi").select("sid", "gid")
    wanted = live.unionByName(asks.select("sid").distinct().join(groups, "sid").select("sid", "gid")).distinct().join(classes.select("sid", "docs", "doc_id", "text_key"), "sid")
    wanted = stage(wanted.select("gid", "sid", "docs", F.col("doc_id").alias("__mr_id"), F.col("text_key").alias("__mr_key")), "wanted")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = docs.select("doc_id", "text").join(wanted, (F.col("doc_id") == F.col("__mr_id")) & (text_key() == F.col("__mr_key"))).select("gid", "sid", "docs", "text")
    sets = stage(_sets(texts, n), "sets")
    stored = stage(_matrix(sets), "matrix")
    none = lambda t: F.lit(None).cast(t)
    salts = F.coalesce("salts", F.lit(1))
    opened = stored.join(asked, "gid", "left").select("gid", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "matrix", none("bigint").alias("sid"), none("bigint").alias("docs"), none("binary").alias("grams"))
    queries = asks.join(asked, "gid").select("sid", "gid", F.pmod(F.xxhash64("sid", F.lit(3)), F.col("salts")).cast("int").alias("salt")).join(sets.drop("gid").dropDuplicates(["sid"]), "sid")
    parts = opened.unionByName(queries.withColumn("matrix", none("binary"))).repartition("gid", "salt").sortWithinPartitions("gid", "salt", F.col("matrix").isNull(), "sid")
    return stage(in_arrow(parts.select("gid", "salt", "matrix", "sid", "docs", "grams"), _answers(percent, every), "a bigint, b bigint, n bigint, m bigint"), "links")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of ``edges`` (a, b) with the smallest node it is joined to, by alternating large-star and
    small-star steps; each round is a table in the shared folder. Least neighbours come from aggregates, so a node of many
    edges is no single task."""
    e = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "large")
        m = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = m.select(F.col("u"), F.col("m").alias("v")).unionByName(m.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        e = stage(small, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def similar(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """(doc_id, class_id, copies, links): a row a document."""
    sigs = stage(signatures(docs, n), "signatures")
    links = class_links(docs, sigs, n, percent)
    root = components(links.filter("b is not null").select("a", "b"))
    found = links.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("m").alias("others"))
    ids = stage(sigs.select("doc_id", "text_key", "sid").distinct(), "ids")
    classes = ids.filter("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("first"), F.count("*").alias("docs"))
    joined = root.join(found, "node", "left").withColumnRenamed("node", "sid")
    per = stage(classes.join(joined, "sid", "left").withColumn("root", F.coalesce("root", "sid")), "classes")
    least = per.groupBy("root").agg(F.min("first").alias("class_id"))
    per = per.join(least, "root").select("sid", "class_id", (F.col("docs") - 1).alias("copies"), (F.col("docs") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    zero = F.lit(0).cast("bigint")
    alone = ids.filter("sid is null").select("doc_id", F.col("doc_id").alias("class_id"), zero.alias("copies"), zero.alias("links"))
    return ids.filter("sid is not null").join(per, "sid").select("doc_id", "class_id", "copies", "links").unionByName(alone)


def class_pairs(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """(doc_id_a, doc_id_b, shared, total, jaccard): all similar pairs of classes, each by its smallest doc_id."""
    sigs = stage(signatures(docs, n), "signatures")
    links = class_links(docs, sigs, n, percent, every=True).filter("b is not null")
    ids = stage(sigs.filter("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("doc_id")), "ids")
    a, b = (ids.select(F.col("sid").alias(c), F.col("doc_id").alias(x)) for c, x in (("a", "x"), ("b", "y")))
    out = links.join(a, "a").join(b, "b").select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"), F.col("n").alias("shared"), F.col("m").alias("total"))
    return out.withColumn("jaccard", F.round(F.col("shared") / F.col("total"), 4))


def surplus(docs: DataFrame, n: int = N, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key) of documents of which a similar one stays, and of documents that are repeated as rows."""
    sigs = stage(signatures(docs, n), "signatures")
    root = components(class_links(docs, sigs, n, percent).filter("b is not null").select("a", "b"))
    ids = sigs.filter("sid is not null").groupBy("sid", "doc_id", "text_key").agg(F.count("*").alias("rows"))
    grouped = stage(ids.join(root, F.col("sid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "sid")), "grouped")
    me = F.struct("doc_id", "text_key")
    first = grouped.groupBy("root").agg(F.min(me).alias("first"), F.count("*").alias("k")).filter("k > 1")
    drop = grouped.join(first, "root").filter(me != F.col("first")).select("doc_id", "text_key")
    return stage(drop, "surplus"), stage(grouped.filter("rows > 1").select("doc_id", "text_key"), "repeated")


def one_of_each(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """``docs`` (same columns) with one document of each group of similar ones."""
    drop, repeated = surplus(docs, n, percent)

    def on(d: DataFrame) -> tuple[DataFrame, Column]:
        d = d.select(F.col("doc_id").alias("__mr_id"), F.col("text_key").alias("__mr_key"))
        return F.broadcast(d) if d.count() <= BROADCAST_ROWS else d, (F.col("doc_id") == F.col("__mr_id")) & (text_key() == F.col("__mr_key"))

    kept = docs.join(*on(drop), "left_anti")
    if repeated.head(1):
        once = kept.join(*on(repeated), "left_semi").withColumn("__mr_key", text_key()).dropDuplicates(["doc_id", "__mr_key"]).drop("__mr_key")
        kept = kept.join(*on(repeated), "left_anti").unionByName(once)
    return kept


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS id, doc_id, w FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS t, regexp_extract_all(lower(coalesce(text, '')), '{WORD_RE2}') AS w FROM documents)),
g AS (SELECT DISTINCT id, hash(g) AS g FROM (SELECT id, unnest(CASE WHEN len(w) >= {N} THEN list_transform(generate_series(1, len(w) - {N - 1}), lambda i: array_to_string(list_slice(w, i, i + {N - 1}), ' ')) ELSE [array_to_string(w, ' ')] END) AS g
      FROM d WHERE len(w) > 0 AND doc_id IS NOT NULL)),
z AS (SELECT id, count(*) AS size FROM g GROUP BY id),
o AS (SELECT id, g FROM g WHERE g IN (SELECT g FROM g GROUP BY g HAVING count(*) > 1)),
s AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM o a JOIN o b ON a.g = b.g AND a.id <> b.id GROUP BY ALL),
p AS (SELECT s.a, s.b, shared = za.size AND shared = zb.size AS copy FROM s JOIN z za ON za.id = s.a JOIN z zb ON zb.id = s.b WHERE shared * {100 + PERCENT} >= {PERCENT} * (za.size + zb.size)),
r AS (SELECT id, id AS root FROM d UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.id),
c AS (SELECT r.id, min(d.doc_id) AS class_id FROM r JOIN d ON d.id = r.root GROUP BY r.id),
l AS (SELECT a AS id, count(*) AS links, count(*) FILTER (WHERE copy) AS copies FROM p GROUP BY a)
SELECT d.doc_id, class_id, coalesce(copies, 0) AS copies, coalesce(links, 0) AS links FROM d JOIN c USING (id) LEFT JOIN l USING (id)
"""
