"""Suffix-array dedup: all passages of ``LENGTH`` or more words that stand in more than one place.

1. Anchors. A 50-word window's anchor is the leftmost of its 39 12-grams of least hash, so equal windows have equal
   anchors. Consecutive windows of one anchor make a piece of 50 to 88 words; every window is in exactly one. An
   anchor row holds hashes of its 12-gram and its piece. There is one to about 20 words; only these rows are shuffled,
   by the 12-gram. Anchors that stand once are done with.
2. Pieces that are equal throughout need no comparison: all of each is repeated. Of the others one copy of each
   distinct piece is fetched from its text and brought together with the other pieces of its anchor.
3. Each task builds the suffix array and Burrows-Wheeler transform of its pieces (in word symbols, a unique separator
   after each) and derives common prefixes by increasing value: breadth-first, each interval whose end was just set is
   extended backwards by each symbol before it, and ends that were not yet known get the next value. At the minimum
   length it stops; suffixes whose value is still open share that many words with a neighbour.
4. Repeated windows return to all occurrences of their piece and are merged to spans a document.

An anchor of more than ``HOT`` distinct pieces (a phrase that a large part of all documents share) would be one array without
bound: its windows are counted by their hashes instead, in an aggregate with map-side combining, to the same result.

The result is exact (up to 64-bit hash collisions) over the whole corpus, however it is partitioned.

Defined results
* null and empty texts, and texts of fewer than LENGTH words, have no spans; null doc_ids are carried through;
* a passage that is repeated within one document counts; rows equal in doc_id and text are one document, once;
* periodic texts give many equal pieces, which are compared once; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_arrow, stage, table, text_key
from .words import U64, WORD_RE2, Words, _powers, finish, ngram_hash, pieces, signed, strings

LENGTH, ANCHOR = 50, 12
#: Words to one suffix array; more pieces in a task go to further arrays, an anchor's pieces always to one.
BATCH = 500_000
#: Distinct pieces of an anchor (of at most 88 words each) that one array takes.
HOT = 10_000
#: Fetch lists of at most so many documents are broadcast; longer ones meet the texts in a shuffle, to the same effect.
BROADCAST_ROWS = 100_000

_BASE = 0xA0761D6478BD642F
_tables: dict[str, np.ndarray] = {}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > len(_tables.get("pow", ())):
        size = 1 << max(16, int(n).bit_length())
        _tables["pow"], _tables["inv"] = _powers(_BASE, size), _powers(pow(_BASE, -1, 2**64), size)
    return _tables["pow"], _tables["inv"]


def anchors(w: Words, length: int = LENGTH, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the anchor, first and one past the last word of its piece): the windows of ``length`` words of each
    text, put together where consecutive ones have the same anchor, the leftmost of their least k-grams."""
    windows = length - k + 1
    m = len(w.hash) - length + 1
    if m <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = ngram_hash(w.hash, k)
    least, width = np.arange(len(g)), 1
    better = lambda a, b: np.where(g[a] <= g[b], a, b)
    while width * 2 <= windows:
        least = better(least[:-width], least[width:])
        width *= 2
    if width < windows:
        least = better(least[: len(least) - (windows - width)], least[windows - width :])
    s = np.flatnonzero(w.row[:m] == w.row[length - 1 :])
    if not len(s):
        return np.zeros(0, U64), s, s
    least = least[s]
    new = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    return g[least[new]], s[new], s[np.append(new[1:], len(s)) - 1] + length


def anchor_rows(docs: DataFrame, length: int, k: int) -> DataFrame:
    """(anchor, piece, doc_id, text_key, start, words)."""
    d = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for off, part in pieces(strings(b.column("text"))):
                w = Words(part)
                g, s, e = anchors(w, length, k)
                power, inverse = _pow(len(w.hash) + 1)
                sums = np.zeros(len(w.hash) + 1, dtype=U64)
                np.cumsum(w.hash * power[: len(w.hash)], out=sums[1:])
                p = finish((sums[e] - sums[s]) * inverse[s] + (e - s).astype(U64) * U64(0x9E3779B97F4A7C15))
                rows = pa.array(w.row[s] + off)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(g)), pa.array(signed(p)), b.column("doc_id").take(rows), b.column("text_key").take(rows), pa.array((s - w.first[w.row[s]]).astype(np.int32)), pa.array((e - s).astype(np.int32))],
                    names=["anchor", "piece", "doc_id", "text_key", "start", "words"],
                )

    return in_arrow(d, run, "anchor bigint, piece bigint, doc_id bigint, text_key bigint, start int, words int")


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Of symbols 0 to n; by prefix doubling, where only suffixes that aren't yet told apart are sorted again."""
    n = len(t)
    order = np.argsort(t, kind="stable")
    s = t[order]
    new = np.empty(n, dtype=bool)
    new[0] = True
    new[1:] = s[1:] != s[:-1]
    heads = np.flatnonzero(new)
    rank = np.empty(n + 1, dtype=np.int64)
    rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    rank[n] = -1
    size = np.diff(np.append(heads, n))
    active = order[np.repeat(size > 1, size)]
    h = 1
    while len(active):
        key = (rank[active] << 32) | (rank[np.minimum(active + h, n)] + 1)
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        group = key >> 32
        start = np.searchsorted(group, group, side="left")
        new = np.empty(len(key), dtype=bool)
        new[0] = True
        new[1:] = key[1:] != key[:-1]
        heads = np.flatnonzero(new)
        size = np.diff(np.append(heads, len(key)))
        rank[active] = group + np.repeat(heads - start[heads], size)
        active = active[np.repeat(size > 1, size)]
        h *= 2
    sa = np.empty(n, dtype=np.int64)
    sa[rank[:n]] = np.arange(n)
    return sa


def open_after(t: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, whether each place in it shares ``length`` or more symbols with the place before): by
    threshold-bounded interval expansion on the Burrows-Wheeler transform."""
    n = len(t)
    sa = suffix_array(t)
    isa = np.empty(n, dtype=np.int64)
    isa[sa] = np.arange(n)
    before = np.where(sa > 0, sa - 1, n - 1)
    bwt, lf = t[before], isa[before]
    order = np.argsort(bwt, kind="stable")
    following = np.full(n, n, dtype=np.int64)  # the next place of the same symbol in the transform
    same = bwt[order[1:]] == bwt[order[:-1]]
    following[order[:-1][same]] = order[1:][same]
    first = t[sa]
    known = np.ones(n + 1, dtype=bool)
    known[1:n] = first[1:] != first[:-1]  # common prefixes of value 0
    queue = np.flatnonzero(known[1:]) + 1  # ends of intervals that were just set
    for _ in range(1, length):
        if not len(queue):
            break
        ends = np.flatnonzero(known)
        low = ends[np.searchsorted(ends, queue) - 1]
        size = queue - low
        place = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
        last = following[place] >= np.repeat(queue, size)  # each symbol of an interval once, at its last place
        new = np.unique(lf[place[last]] + 1)
        queue = new[~known[new]]
        known[queue] = True
    return sa, ~known[:n]


def repeated_windows(texts: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each piece (word hashes), the starts of its windows of ``length`` words that stand elsewhere too."""
    if not texts:
        return []
    size = np.array([len(x) for x in texts])
    values, symbol = np.unique(np.concatenate(texts), return_inverse=True)
    at = np.cumsum(size + 1) - (size + 1)
    t = np.empty(int((size + 1).sum()), dtype=np.int64)
    sep = at + size
    t[sep] = len(values) + np.arange(len(texts))
    inside = np.ones(len(t), dtype=bool)
    inside[sep] = False
    t[inside] = symbol
    sa, more = open_after(t, length)
    places = np.flatnonzero(more)
    mark = np.zeros(len(t), dtype=bool)
    mark[sa[places]] = True
    mark[sa[places - 1]] = True
    return [np.flatnonzero(mark[a : a + s]) for a, s in zip(at.tolist(), size.tolist())]


def _spans(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), (starts[np.append(cut, len(starts) - 1)] + length).tolist()))


def _compare(length: int):
    """Rows (anchor, piece, body) ordered by anchor to (anchor, piece, from, to), relative to the piece."""

    def found(keys: list[tuple[int, int]], texts: list[np.ndarray]) -> pa.RecordBatch:
        rows = [(*k, s, e) for k, starts in zip(keys, repeated_windows(texts, length)) for s, e in _spans(starts, length)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], (pa.int64(), pa.int64(), pa.int32(), pa.int32())[i]) for i in range(4)], names=["anchor", "piece", "from", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[tuple[int, int]] = []
        texts: list[np.ndarray] = []
        total = 0
        for b in batches:
            for a, p, body in zip(b.column("anchor").to_pylist(), b.column("piece").to_pylist(), b.column("body")):
                if total >= BATCH and a != keys[-1][0]:
                    yield found(keys, texts)
                    keys, texts, total = [], [], 0
                keys.append((a, p))
                texts.append(np.frombuffer(body.as_buffer(), dtype=U64).copy())
                total += len(texts[-1])
        yield found(keys, texts)

    return run


def _bodies(wanted: DataFrame) -> DataFrame:
    """(text, pieces: array of (anchor, piece, start, words)) to (anchor, piece, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("pieces")
            for off, part in pieces(strings(b.column("text"))):
                w = Words(part)
                rows = [(x["anchor"], x["piece"], int(w.first[i]) + x["start"], x["words"]) for i in range(len(part)) for x in lists[off + i].as_py()]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([w.hash[r[2] : r[2] + r[3]].tobytes() for r in rows], pa.binary())], names=["anchor", "piece", "body"])

    return in_arrow(wanted, run, "anchor bigint, piece bigint, body binary")


def _counted(bodies: DataFrame, length: int) -> DataFrame:
    """(anchor, piece, from, to) of the windows of distinct pieces that stand in more than one place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [ngram_hash(np.frombuffer(x.as_buffer(), dtype=U64), length) for x in b.column("body")]
            n = np.array([len(x) for x in h], dtype=np.int64)
            rows = pa.array(np.repeat(np.arange(len(h)), n))
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            flat = np.concatenate(h) if h else np.zeros(0, U64)
            yield pa.RecordBatch.from_arrays([b.column("anchor").take(rows), b.column("piece").take(rows), pa.array(at.astype(np.int32)), pa.array(signed(flat))], names=["anchor", "piece", "from", "h"])

    w = stage(in_arrow(bodies.select("anchor", "piece", "body"), run, "anchor bigint, piece bigint, from int, h bigint"), "windows")
    often = w.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1").select("h")
    return w.join(often, "h", "left_semi").select("anchor", "piece", "from", (F.col("from") + length).cast("int").alias("to"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """(doc_id, start_word, end_word, words): the merged passages of ``length`` or more words that stand elsewhere too."""
    names = ["anchor", "piece", "doc_id", "text_key", "start", "words"]
    by = Window.partitionBy("anchor")
    occ = anchor_rows(docs, length, k).repartition("anchor").groupBy(*names).agg(F.lit(1).alias("one")).drop("one")
    occ = occ.withColumns({"n": F.count("*").over(by), "alike": F.min("piece").over(by) == F.max("piece").over(by)}).filter("n > 1").drop("n")
    occ = stage(occ, "occurrences")
    mixed = occ.filter("not alike").groupBy("anchor", "piece").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_key", "start", "words")).alias("x"))
    mixed = stage(mixed.select("anchor", "piece", "n", "x.*"), "pieces")
    wanted = mixed.groupBy(F.col("doc_id").alias("i"), F.col("text_key").alias("t")).agg(F.collect_list(F.struct("anchor", "piece", "start", "words")).alias("pieces"))
    wanted = stage(wanted, "wanted")
    if wanted.count() <= BROADCAST_ROWS and mixed.count() <= 8 * BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    # rows that repeat one document give the same pieces; that of an anchor and piece is taken once
    texts = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("i")) & (text_key() == F.col("t"))).select("text", "pieces")
    bodies = _bodies(texts)
    hot = mixed.groupBy("anchor").agg(F.count("*").alias("k")).filter(F.col("k") > HOT).select("anchor")
    found = None
    if hot.head(1):
        hot = stage(hot, "hot")
        bodies = stage(bodies, "bodies")
        found = _counted(bodies.join(hot, "anchor", "left_semi").dropDuplicates(["anchor", "piece"]), length)
        bodies = bodies.join(hot, "anchor", "left_anti")
    bodies = bodies.repartition("anchor").dropDuplicates(["anchor", "piece"]).sortWithinPartitions("anchor", "piece")
    compared = in_arrow(bodies, _compare(length), "anchor bigint, piece bigint, from int, to int")
    found = compared if found is None else compared.unionByName(found)
    same = mixed.filter("n > 1").select("anchor", "piece", F.lit(0).alias("from"), F.col("words").alias("to"))
    part = occ.filter("not alike").join(found.unionByName(same), ["anchor", "piece"]).select("doc_id", "text_key", (F.col("start") + F.col("from")).alias("s"), (F.col("start") + F.col("to")).alias("e"))
    whole = occ.filter("alike").select("doc_id", "text_key", F.col("start").alias("s"), (F.col("start") + F.col("words")).alias("e"))
    return _merged(whole.unionByName(part))


def _merged(spans: DataFrame) -> DataFrame:
    me = Window.partitionBy("doc_id", "text_key").orderBy("s", "e")
    reach = F.max("e").over(me.rowsBetween(Window.unboundedPreceding, -1))
    x = spans.withColumn("new", F.when(reach.isNull() | (F.col("s") > reach), 1).otherwise(0)).withColumn("island", F.sum("new").over(me))
    x = x.groupBy("doc_id", "text_key", "island").agg(F.min("s").alias("start_word"), F.max("e").alias("end_word"))
    return x.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("words"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
WITH d AS (SELECT DISTINCT doc_id, text, regexp_extract_all(lower(text), '{WORD_RE2}') AS w FROM documents),
v AS (SELECT doc_id, text, i - 1 AS s, array_to_string(list_slice(w, i, i + {LENGTH - 1}), ' ') AS g
      FROM (SELECT doc_id, text, w, unnest(generate_series(1, len(w) - {LENGTH - 1})) AS i FROM d WHERE len(w) >= {LENGTH})),
r AS (SELECT doc_id, text, s FROM v WHERE g IN (SELECT g FROM v GROUP BY g HAVING count(*) > 1)),
b AS (SELECT *, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id, text ORDER BY s) + {LENGTH} THEN 1 ELSE 0 END AS new FROM r),
x AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, text ORDER BY s) AS island FROM b)
SELECT doc_id, CAST(min(s) AS INTEGER) AS start_word, CAST(max(s) + {LENGTH} AS INTEGER) AS end_word, CAST(max(s) + {LENGTH} - min(s) AS INTEGER) AS words
FROM x GROUP BY doc_id, text, island
"""
