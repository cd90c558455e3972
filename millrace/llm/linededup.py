"""Incremental, reversible line dedup: exact reference counts behind sharded cuckoo filters.

A line's identity is 128 bits of hash of its normal form (white space squeezed, trimmed, lower case). A ``LineStore``
holds, as tables in one folder, only ever appended to:

* postings (batch, doc_id, text_key, line_no, h1, h2, sign): where each line stands, so that documents can be taken out;
* refs (shard, h1, h2, delta): +n or -n references to a line; their sum is its exact reference count;
* filters (shard, version, blob): a cuckoo filter of the lines with a positive count; the last version counts;
* drops (doc_id, text_key, line_no, sign): lines that documents lose now, +1 when an insertion drops one, -1 when a deletion
  gives it back;
* log (version, shards, lines, name, path): the files of each finished change. A store that is opened again reads it; files of a
  change that was broken off are in no log and count for nothing.

An insertion probes each shard's filter first: a miss is certainly new, and only hits (true ones and the few false
ones) are looked up in refs. Each line without a positive count, a false hit too, gets a fingerprint of its own, so
that no line leans on another's. A deletion appends negative references and takes the fingerprints of lines that reach
zero out of the filters, which Bloom filters could not do; it looks only at lines of the documents that go. Shards are worked on
independently and in parallel; their number follows the lines held: a store that has grown beyond ``GROWTH`` times what its shards are
for gets more, its filters built anew from the exact counts. So a filter stays a few MB. A document's text is moved at most
once, to meet its verdicts.

``dedup_lines`` takes a table in ``BATCHES`` ranges of doc_id, each held against those before it. The query does so
too, then withdraws the documents that ``labels`` calls toxic and takes them in again, as the last batch.

Defined results
* of equal lines the first is kept: by batch, then doc_id (nulls last), then text hash, then line number;
* lines whose normal form has fewer than ``MIN_CHARS`` characters are always kept, blank ones among them;
* null text stays null; a document whose every line goes has an empty text; empty tables give empty tables;
* rows equal in doc_id and text are one document repeated and get the same result; columns pass through untouched;
* a document inserted again without a deletion between is a repetition of itself: all its lines are dropped; deleting one that
  is not held does nothing, deleting one takes out all its insertions.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, small, stage, table, text_key

MIN_CHARS, BATCHES = 8, 2
KEYS_A_SHARD, GROWTH = 250_000, 2
#: Verdicts on at most so many documents (and four times as many lines) go to the documents by broadcast; more meet them in a shuffle, to the same effect.
BROADCAST_ROWS = 200_000
SLOTS = 4
_LOAD = 0.8


class Cuckoo:
    """A cuckoo filter: buckets of four 16-bit fingerprints, 0 for none; a fingerprint's two buckets are known from
    either one, so what was inserted can be deleted. Insertion is by whole arrays; only the few that find both
    buckets full are moved one by one, and a filter that runs full says so, to be built anew at twice the size."""

    def __init__(self, n_keys: int = 0, blob: bytes | None = None):
        if blob is not None:
            self.slots = np.frombuffer(blob, dtype=np.uint16).reshape(-1, SLOTS).copy()
        else:
            buckets = 4
            while buckets * SLOTS * _LOAD < n_keys:
                buckets *= 2
            self.slots = np.zeros((buckets, SLOTS), dtype=np.uint16)

    @classmethod
    def of(cls, h: np.ndarray) -> Cuckoo:
        """A new filter of these keys, with room for a quarter more; larger than that if chance fills its buckets."""
        for k in range(16):
            made = cls(int(len(h) * 1.25) << k)
            if made.insert(h):
                return made
        raise ValueError("keys of a cuckoo filter have to be hashes")

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = np.ascontiguousarray(h).view(np.uint64)
        f = (h >> np.uint64(48)).astype(np.uint16)
        f[f == 0] = 1
        a = (h & np.uint64(len(self.slots) - 1)).astype(np.int64)
        return f, a, self._other(a, f)

    def _other(self, bucket, f):
        return bucket ^ ((f.astype(np.int64) * 0x5BD1E995 >> 3) & (len(self.slots) - 1))

    def contains(self, h: np.ndarray) -> np.ndarray:
        f, a, b = self._places(h)
        return (self.slots[a] == f[:, None]).any(axis=1) | (self.slots[b] == f[:, None]).any(axis=1)

    def _fill(self, bucket: np.ndarray, f: np.ndarray) -> np.ndarray:
        """Put fingerprints where their buckets have room; which were put."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        first = np.searchsorted(b, b, side="left")
        rank = np.arange(len(b)) - first
        free = self.slots == 0
        ok = rank < free.sum(axis=1)[b]
        where = np.argsort(~free, axis=1, kind="stable")  # free slots first
        self.slots[b[ok], where[b[ok], rank[ok]]] = f[order][ok]
        done = np.zeros(len(b), dtype=bool)
        done[order[ok]] = True
        return done

    def insert(self, h: np.ndarray) -> bool:
        """False if it ran full; the filter is then of no use."""
        f, a, b = self._places(h)
        left = ~self._fill(a, f)
        f, a, b = f[left], a[left], b[left]
        left = ~self._fill(b, f)
        rng = np.random.default_rng(len(self.slots))
        for fp, at in zip(f[left], b[left].tolist()):
            for _ in range(500):
                free = np.flatnonzero(self.slots[at] == 0)
                if len(free):
                    self.slots[at, free[0]] = fp
                    break
                k = int(rng.integers(SLOTS))
                fp, self.slots[at, k] = self.slots[at, k], fp
                at = int(self._other(np.int64(at), fp))
            else:
                return False
        return True

    def delete(self, h: np.ndarray) -> None:
        """Of keys that were inserted; each takes out one fingerprint."""
        for f, a, b in zip(*self._places(h)):
            for at in (a, b):
                k = np.flatnonzero(self.slots[at] == f)
                if len(k):
                    self.slots[at, k[0]] = 0
                    break

    @property
    def load(self) -> float:
        return float((self.slots != 0).mean())

    def bytes(self) -> bytes:
        return self.slots.tobytes()


def normal(text: Column) -> Column:
    """Each line of a text in its normal form. By whole texts, and the pattern finds only what is to be changed: one regular
    expression a line costs several times as much."""
    c = F.regexp_replace(text, r"[ \t\r\f\u000b]{2,}|[\t\r\f\u000b]", " ")
    return F.lower(F.trim(F.replace(F.replace(c, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, line_no, h1, h2) of the lines that count."""
    d = docs.select("doc_id", text_key().alias("text_key"), F.posexplode(F.split(normal(F.col("text")), "\n")).alias("line_no", "line"))
    return d.filter(F.length("line") >= MIN_CHARS).select("doc_id", "text_key", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(11), "line").alias("h2"))


def _order() -> Column:
    """Orders postings: batch, doc_id with nulls last, text hash, line."""
    return F.struct("batch", F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "line_no")


def _shard(n: int) -> Column:
    return F.pmod(F.col("h2"), F.lit(n)).cast("int")


def _probe(keys: DataFrame, filters: DataFrame) -> DataFrame:
    """(h1, h2) of the keys that the filters may hold; keys: (shard, h1, h2); filters: (shard, blob)."""

    def run(ks: pa.Table, fs: pa.Table) -> pa.Table:
        blobs = fs.column("blob").to_pylist()
        maybe = Cuckoo(blob=blobs[0]).contains(ks.column("h1").to_numpy()) if blobs and ks.num_rows else np.zeros(ks.num_rows, dtype=bool)
        return ks.select(["h1", "h2"]).filter(pa.array(maybe, pa.bool_()))

    return keys.select("shard", "h1", "h2").groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(run, "h1 bigint, h2 bigint")


def _filters(keys: DataFrame, filters: DataFrame, version: int) -> DataFrame:
    """keys: (shard, h1, h2, delta), of lines that had no count (delta > 0: insert) or have none now (else delete);
    filters: (shard, blob). A row a shard that has keys, with its filter after these changes, or none if it ran full."""

    def run(ks: pa.Table, fs: pa.Table) -> pa.Table:
        if not ks.num_rows:
            return into.empty_table()
        old = fs.column("blob").to_pylist()
        h1, delta = ks.column("h1").to_numpy(), ks.column("delta").to_numpy()
        fresh = h1[delta > 0]
        if old:
            now = Cuckoo(blob=old[0])
            now.delete(h1[delta < 0])
            full = now.load + len(fresh) / now.slots.size > _LOAD or not now.insert(fresh)
        else:
            now, full = Cuckoo.of(fresh), False
        return pa.table([ks.column("shard")[:1], pa.array([version], pa.int32()), pa.array([None if full else now.bytes()], pa.binary())], schema=into)

    into = pa.schema([("shard", pa.int32()), ("version", pa.int32()), ("blob", pa.binary())])
    return keys.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(run, "shard int, version int, blob binary")


class LineStore:
    """See the module. A filter that runs full is built anew, larger, from the exact counts. With the ``path`` of a store it goes
    on where that one ended."""

    def __init__(self, spark: SparkSession, path: str | None = None, shards: int | None = None):
        self.spark, self.path, self.shards, self.version = spark, path or f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}", shards, 0
        self.lines = 0  # at least as many as have references
        self._files: dict[str, list[str]] = {"postings": [], "refs": [], "filters": [], "drops": []}
        self._new: list[tuple[str, str]] = []
        log = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        if path and log.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(log):
            for r in spark.read.parquet(f"{self.path}/log/*").orderBy("version", F.col("path").isNotNull()).collect():  # a row a file
                if r["path"] is None:
                    self._files[r["name"]] = []
                else:
                    self._files[r["name"]].append(r["path"])
                self.version, self.shards, self.lines = max(self.version, r["version"]), r["shards"], r["lines"]

    def _append(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.path}/{name}/v{self.version}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        self._new.append((name, path))
        return self.spark.read.schema(df.schema).parquet(path)

    def _commit(self) -> None:
        rows = [(self.version, self.shards, self.lines, name, path) for name, path in self._new]
        self.spark.createDataFrame(rows, "version int, shards int, lines bigint, name string, path string").coalesce(1).write.parquet(f"{self.path}/log/v{self.version}-{uuid.uuid4().hex}")
        for name, path in sorted(self._new, key=lambda x: x[1] is not None):
            self._files[name] = [] if path is None else [*self._files[name], path]
        self._new = []

    def read(self, name: str) -> DataFrame | None:
        return self.spark.read.parquet(*self._files[name]) if self._files[name] else None

    def _current_filters(self) -> DataFrame:
        f = self.read("filters")
        if f is None:
            return self.spark.createDataFrame([], "shard int, blob binary")
        last = f.groupBy("shard").agg(F.max("version").alias("version"))  # blobs of older versions are not read
        return f.join(F.broadcast(last), ["shard", "version"]).select("shard", "blob")

    def _small(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small(df, BROADCAST_ROWS) else df

    def counts(self, of: DataFrame | None = None) -> DataFrame:
        """(h1, h2, refs): the exact reference counts, of lines that have any (of the staged keys ``of``)."""
        r = self.read("refs")
        if r is None:
            return self.spark.createDataFrame([], "h1 bigint, h2 bigint, refs bigint")
        if of is not None:
            r = r.join(self._small(of), ["h1", "h2"], "left_semi")
        return r.groupBy("h1", "h2").agg(F.sum("delta").alias("refs")).filter("refs > 0")

    def drops(self) -> DataFrame:
        """(doc_id, text_key, line_no): the lines that the documents held lose now."""
        d = self.read("drops")
        if d is None:
            return self.spark.createDataFrame([], "doc_id bigint, text_key bigint, line_no int")
        return d.groupBy("doc_id", "text_key", "line_no").agg(F.sum("sign").alias("n")).filter("n > 0").drop("n")

    def _update(self, keys: DataFrame) -> None:
        """Bring the filters up to date: keys as ``_filters`` has them, their references appended before."""
        built = stage(_filters(keys, self._current_filters(), self.version), "built")
        self._append("filters", built.filter("blob is not null").select("shard", "version", "blob"))
        full = built.filter("blob is null").select("shard")
        if full.head(1):
            refs = self.spark.read.parquet(*self._files["refs"], *[p for n, p in self._new if n == "refs"]).withColumn("shard", _shard(self.shards))
            left = refs.join(full, "shard", "left_semi").groupBy("shard", "h1", "h2").agg(F.sum("delta").alias("delta")).filter("delta > 0")
            again = _filters(left, self.spark.createDataFrame([], "shard int, blob binary"), self.version)
            self._append("filters", again.select("shard", "version", "blob"))

    def _reshard(self) -> None:
        """More shards, of which each has a new filter of what the counts hold (without the change that is under way)."""
        self.shards = -(-self.lines // KEYS_A_SHARD)
        keys = self.counts().select(_shard(self.shards).alias("shard"), "h1", "h2", F.col("refs").alias("delta"))
        built = stage(_filters(keys, self.spark.createDataFrame([], "shard int, blob binary"), self.version - 1), "resharded")
        self._files["filters"] = []
        self._new.append(("filters", None))
        self._append("filters", built)
        self._files["filters"].append(self._new[-1][1])

    def insert(self, docs: DataFrame) -> DataFrame:
        """Take in ``docs``; returns the postings that are dropped: (doc_id, text_key, line_no)."""
        self.version += 1
        lines = lines_of(docs).withColumn("batch", F.lit(self.version))
        # rows that repeat one document hold one posting
        posted = self._append("postings", lines.distinct().withColumn("sign", F.lit(1)))
        per = stage(posted.groupBy("h1", "h2").agg(F.count("*").alias("delta"), F.min(_order()).alias("first")), "per")
        self.lines += per.count()
        if self.shards is None:
            self.shards = max(8, -(-self.lines // KEYS_A_SHARD))
        elif self._files["refs"] and self.lines > GROWTH * KEYS_A_SHARD * self.shards:
            self._reshard()
        keys = self._append("refs", per.select(_shard(self.shards).alias("shard"), "h1", "h2", "delta"))
        held = None
        if not self._files["refs"]:
            self._update(keys)
        else:  # hits of the filters, looked up in the exact counts as they were
            maybe = stage(_probe(keys, self._current_filters()), "probed")
            held = stage(self.counts(maybe).select("h1", "h2"), "held")
            self._update(keys.join(self._small(held), ["h1", "h2"], "left_anti").select("shard", "h1", "h2", "delta"))
        doubtful = posted.join(per.filter("delta > 1").select("h1", "h2", "first"), ["h1", "h2"]).filter(_order() != F.col("first"))
        drop = doubtful.select("doc_id", "text_key", "line_no")
        if held is not None:
            drop = drop.unionByName(posted.join(self._small(held), ["h1", "h2"], "left_semi").select("doc_id", "text_key", "line_no")).distinct()
        drop = self._append("drops", drop.withColumn("sign", F.lit(1)))
        self._commit()
        return drop.drop("sign")

    def delete(self, docs: DataFrame) -> DataFrame:
        """Take documents out (doc_id and text as they went in); returns the postings that now keep their line
        because the one that kept it has gone: (doc_id, text_key, line_no). Only lines of these documents are looked at."""
        self.version += 1
        place = ["batch", "doc_id", "text_key", "line_no", "h1", "h2"]
        held = self.read("postings")
        ids = stage(docs.select(F.col("doc_id").alias("i"), text_key().alias("k")).distinct(), "ids")
        mine = held.join(self._small(ids), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("k")), "left_semi")
        out = self._append("postings", mine.groupBy(*place).agg(F.sum("sign").alias("n")).filter("n > 0").select(*place, (-F.col("n")).cast("int").alias("sign")))
        keys = stage(out.groupBy("h1", "h2").agg(F.sum("sign").alias("delta")), "keys")
        now = keys.join(self.counts(keys), ["h1", "h2"])
        changed = self._append("refs", now.select(_shard(self.shards).alias("shard"), "h1", "h2", "delta", (F.col("refs") + F.col("delta") <= 0).alias("gone")))
        self._update(changed.filter("gone").select("shard", "h1", "h2", "delta"))
        touched = held.join(self._small(keys), ["h1", "h2"], "left_semi").select(*place, "sign", F.lit(False).alias("new")).unionByName(out.withColumn("new", F.lit(True)))
        each = touched.groupBy(*place).agg(F.sum(F.when(~F.col("new"), F.col("sign"))).alias("was"), F.sum("sign").alias("is"))
        each = stage(each.filter("was > 0").select(*place, (F.col("is") > 0).alias("stays")), "touched")
        owners = each.groupBy("h1", "h2").agg(F.min(_order()).alias("before"), F.min(F.when(F.col("stays"), _order())).alias("after"))
        back = each.join(owners, ["h1", "h2"]).filter((_order() != F.col("before")) & (~F.col("stays") | (_order() == F.col("after"))))
        back = stage(back.select("doc_id", "text_key", "line_no", "stays"), "back")
        # a repeated insertion has dropped its lines once a batch
        self._append("drops", back.select("doc_id", "text_key", "line_no", F.lit(-1).alias("sign")))
        self._commit()
        return back.filter("stays").select("doc_id", "text_key", "line_no")


def batches(docs: DataFrame, n: int = BATCHES) -> list[DataFrame]:
    """Ranges of doc_id, in order; null doc_ids are in the last."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        return [docs]
    cuts = [low + (high - low) * k // n for k in range(1, n)]
    lower, out = F.lit(True), []
    for c in cuts:
        out.append(docs.filter(lower & (F.col("doc_id") <= c)))
        lower = F.col("doc_id") > c
    return [*out, docs.filter(lower | F.col("doc_id").isNull())]


def apply_drops(docs: DataFrame, drop: DataFrame) -> DataFrame:
    """``docs`` with ``__mr_drop``: the line numbers each loses, or null."""
    per = stage(drop.groupBy("doc_id", "text_key").agg(F.collect_set("line_no").alias("__mr_drop")), "drops")
    per = per.select(F.col("doc_id").alias("__mr_id"), F.col("text_key").alias("__mr_key"), "__mr_drop")
    if small(per, BROADCAST_ROWS, "__mr_drop"):
        per = F.broadcast(per)
    on = F.col("doc_id").eqNullSafe(F.col("__mr_id")) & (text_key() == F.col("__mr_key"))
    return docs.join(per, on, "left").drop("__mr_id", "__mr_key")


def _kept() -> Column:
    lines = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col("__mr_drop"), i))
    return F.when(F.col("__mr_drop").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n"))


def dedup_lines(docs: DataFrame, store: LineStore | None = None) -> DataFrame:
    """``docs`` (same columns) without the lines that ``store`` or an earlier line of ``docs`` holds."""
    if store:
        drops = store.insert(docs)
    else:
        store = LineStore(docs.sparkSession)
        for part in batches(docs):
            store.insert(part)
        drops = store.drops()
    return apply_drops(docs, drops).withColumn("text", _kept()).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    toxic = stage(table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct(), "toxic")
    toxic = F.broadcast(toxic) if small(toxic, BROADCAST_ROWS) else toxic
    withdrawn = docs.join(toxic, "doc_id", "left_semi")
    store = LineStore(spark)
    for part in batches(docs):
        store.insert(part)
    store.delete(withdrawn)
    store.insert(withdrawn)
    d = apply_drops(docs, store.drops())
    n = F.size(F.split("text", "\n"))
    return d.select("doc_id", _kept().alias("text"), n.alias("lines"), F.coalesce(F.size("__mr_drop"), F.lit(0)).alias("dropped"))


ORACLE_SQL = f"""
WITH d AS (SELECT DISTINCT doc_id, text, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN {BATCHES + 1} WHEN doc_id <= (SELECT min(doc_id) + (max(doc_id) - min(doc_id)) // {BATCHES} FROM documents) THEN 1 ELSE {BATCHES} END AS batch FROM documents WHERE text IS NOT NULL),
x AS (SELECT *, lower(trim(regexp_replace(line, '[ \t\r\f\x0b]+', ' ', 'g'), ' ')) AS k FROM (SELECT doc_id, text, batch, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM (SELECT *, string_split(text, chr(10)) AS ls FROM d))),
y AS (SELECT *, length(k) >= {MIN_CHARS} AND row_number() OVER (PARTITION BY k ORDER BY batch, doc_id NULLS LAST, text, i) > 1 AS gone FROM x),
z AS (SELECT doc_id, text, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS kept, count(*) AS lines, count(*) FILTER (WHERE gone) AS dropped FROM y GROUP BY doc_id, text)
SELECT documents.doc_id, kept AS text, CAST(lines AS INTEGER) AS lines, CAST(coalesce(dropped, 0) AS INTEGER) AS dropped FROM documents LEFT JOIN z ON documents.doc_id IS NOT DISTINCT FROM z.doc_id AND documents.text = z.text
"""
