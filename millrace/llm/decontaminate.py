"""Benchmark decontamination: scan every window of the training text for the benchmark's word n-grams.

The benchmark's normalised words, and the sorted hashes of its n-grams with their places in these, go to the executors once, as flat arrays;
each Arrow batch of documents is cut into words and all of its windows are looked up; each hit is verified word by word; hits
that touch form spans. Documents aren't shuffled. Only when the benchmark's texts have more than ``broadcast_bytes`` is it
joined by a shuffle instead, of window hashes alone: documents with a hit then meet their hits once, and these are
verified word by word, with the same result. Only lengths that the benchmark has are looked for.

Defined results
* an item of fewer than n but at least ``min_words`` words is one n-gram of its own length; shorter items and null texts
  match nothing; an item listed twice under one id counts once; a null item_id is an id like any other;
* null or empty text has no words and is never contaminated; null doc_ids are carried through;
* a document loses its spans (first to last word of each, and nothing else); where these hold more than
  ``max_share`` of its words, the whole document goes; repeated rows are cleaned alike and reported once;
* columns pass through untouched; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_arrow, stage, table, text_key
from .words import WORD_RE2, Words, char_starts, pieces, signed, strings

N, MIN_WORDS, MAX_SHARE = 8, 5, 0.5
#: Bytes of benchmark texts that are broadcast; with hashes and places of n-grams they come to about ten times as many in memory.
BROADCAST_BYTES = 16 << 20
#: Lists of documents with hits of at most so many rows (16 bytes each) are broadcast.
BROADCAST_ROWS = 200_000


class Grams:
    """The benchmark's n-grams by length: sorted hashes, with the first word of each among the benchmark's words, which are kept
    once, as bytes. ``items`` are (item_id, text)."""

    def __init__(self, items: list[tuple[int | None, str]], n: int, min_words: int):
        w = Words(pa.array([t for _, t in items], pa.large_string()))
        self.buf, self.start, self.end, self.row = np.ascontiguousarray(w.buf), w.start, w.end, w.row.astype(np.int32)
        self.ids = [i for i, _ in items]
        size = np.diff(w.first)
        self.by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in sorted({n} | {int(s) for s in size if min_words <= s < n}):
            at, h = w.ngrams(length)
            whole = size[w.row[at]]
            ok = (whole >= n) if length == n else (whole == length)
            at, h = at[ok], h[ok]
            if len(at):
                order = np.argsort(h, kind="stable")
                self.by[length] = (h[order], at[order])

    def words(self, a: int, n: int) -> list[bytes]:
        return [self.buf[s:e].tobytes() for s, e in zip(self.start[a : a + n].tolist(), self.end[a : a + n].tolist())]

    def hits(self, w: Words) -> set[tuple[int, int | None, int, int]]:
        """(row, item_id, first word in the row, words) of each verified window."""
        out = set()
        for length, (keys, places) in self.by.items():
            at, h = w.ngrams(length)
            left = np.searchsorted(keys, h, side="left")
            found = np.flatnonzero(keys[np.minimum(left, len(keys) - 1)] == h)
            for i in found.tolist():
                a = int(at[i])
                mine = [w.buf[s:e].tobytes() for s, e in zip(w.start[a : a + length].tolist(), w.end[a : a + length].tolist())]
                j = int(left[i])
                while j < len(keys) and keys[j] == h[i]:
                    if self.words(int(places[j]), length) == mine:
                        out.add((int(w.row[a]), self.ids[self.row[places[j]]], a - int(w.first[w.row[a]]), length))
                    j += 1
        return out


def spans_of(hits) -> list[tuple[int, int | None, int, int]]:  # noqa: ANN001
    """(row, item_id, start, end) of runs of overlapping or touching windows of one item."""
    out: list[tuple[int, int | None, int, int]] = []
    for row, item, start, n in sorted(hits, key=lambda x: (x[0], x[1] is None, x[1] or 0, x[2], x[3])):
        if out and out[-1][:2] == (row, item) and start <= out[-1][3]:
            out[-1] = (row, item, out[-1][2], max(out[-1][3], start + n))
        else:
            out.append((row, item, start, start + n))
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _items(bench: DataFrame) -> DataFrame:
    return bench.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null").distinct()


def _fits(bench: DataFrame, limit: int) -> bool:
    """Whether the benchmark's texts have at most ``limit`` bytes."""
    return (_items(bench).agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) <= limit


def _broadcast(spark: SparkSession, bench: DataFrame, n: int, min_words: int):
    items = sorted(((r[0], r[1]) for r in _items(bench).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))  # of bounded bytes: see _fits
    return spark.sparkContext.broadcast(Grams(items, n, min_words))


_SPAN = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start_word", T.IntegerType()), T.StructField("end_word", T.IntegerType())])
_SPANS = T.ArrayType(_SPAN)


def _cut(texts: pa.Array, column: pa.Array, spans: dict[int, list[tuple[int, int]]], size: np.ndarray, max_share: float) -> tuple[pa.Array, np.ndarray]:
    """(``column`` with the texts that have spans cut, which rows stay): only these rows are touched."""
    cut = {i: _without(texts[i].as_py(), merged(s), int(size[i]), max_share) for i, s in spans.items()}
    keep, new = np.ones(len(texts), dtype=bool), np.zeros(len(texts), dtype=bool)
    rows = sorted(cut)
    keep[[i for i in rows if cut[i] is None]] = False
    new[rows] = True
    return pc.replace_with_mask(column, pa.array(new), pa.array([cut[i] for i in rows], column.type)), keep


def _spans_column(found: dict[int, list[tuple]], n: int) -> pa.Array:
    first = np.concatenate([[0], np.cumsum([len(found.get(i, ())) for i in range(n)])]).astype(np.int32)
    flat = [x for i in sorted(found) for x in found[i]]
    st = pa.StructArray.from_arrays([pa.array([x[k] for x in flat], t) for k, t in ((0, pa.int64()), (1, pa.int32()), (2, pa.int32()))], names=_SPAN.names)
    return pa.ListArray.from_arrays(pa.array(first), st)


def _scan(docs: DataFrame, hits, clean: bool, max_share: float) -> DataFrame:  # noqa: ANN001
    """``docs`` with ``__mr_spans`` and ``__mr_words``; if ``clean``, with spans and hopeless documents taken out. ``hits`` gives the
    verified windows of a batch's words, from its first row on."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = strings(b.column("text"))
            found: dict[int, list[tuple]] = {}
            size = np.zeros(len(texts), dtype=np.int64)
            for at, part in pieces(texts):
                w = Words(part)
                size[at : at + len(part)] = np.diff(w.first)
                for row, item, s, e in spans_of(hits(b, at, w)):
                    found.setdefault(at + row, []).append((item, s, e))
            if not clean:
                yield pa.RecordBatch.from_arrays([*b.columns, _spans_column(found, len(texts)), pa.array(size)], names=[*b.schema.names, "__mr_spans", "__mr_words"])
            elif found:
                k = names.index("text")
                text, keep = _cut(texts, b.column(k), {i: [x[1:] for x in v] for i, v in found.items()}, size, max_share)
                yield pa.RecordBatch.from_arrays([*b.columns[:k], text, *b.columns[k + 1 :]], names=b.schema.names).filter(pa.array(keep))
            else:
                yield b

    extra = [] if clean else [T.StructField("__mr_spans", _SPANS), T.StructField("__mr_words", T.LongType())]
    return in_arrow(docs, run, T.StructType([*docs.schema.fields, *extra]))


def _without(text: str, spans: list[tuple[int, int]], words: int, max_share: float) -> str | None:
    """``text`` without the spans, or None if they hold more than max_share of it."""
    if sum(b - a for a, b in spans) > max_share * words:
        return None
    own = pa.array([text], pa.large_string())
    w = Words(own)
    low = w.buf.tobytes().decode("utf-8")
    if len(low) != len(text):  # lower-casing that changes the number of characters would shift positions
        w = Words(own, lower=False)
    at = char_starts(w.buf, np.concatenate([w.start, w.end]))
    start, end = at[: len(w.start)], at[len(w.start) :]
    out, done = [], 0
    for a, b in spans:
        out.append(text[done : start[a]])
        done = int(end[b - 1])
    return "".join(out) + text[done:]


def _candidates(docs: DataFrame, bench: DataFrame, n: int, min_words: int) -> DataFrame:
    """(__mr_id, __mr_key, __mr_hits: array of (item_id, at, gram)): windows whose hash is a benchmark n-gram's, by document; for
    benchmarks too large to send around. Of the documents only hashes are shuffled."""

    def emit(bench: bool, lengths: tuple[int, ...]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at, part in pieces(strings(b.column("text"))):
                    w = Words(part)
                    size = np.diff(w.first)
                    for length in lengths:
                        pos, h = w.ngrams(length)
                        if bench:  # an item gives n-grams of n words, or itself
                            whole = size[w.row[pos]]
                            ok = (whole >= n) if length == n else (whole == length)
                            pos, h = pos[ok], h[ok]
                        rows = pa.array(w.row[pos] + at)
                        ids = [b.column(k).take(rows) for k in range(b.num_columns - 1)]
                        what = [pa.array([w.text(a, a + length) for a in pos.tolist()], pa.string())] if bench else [pa.array((pos - w.first[w.row[pos]]).astype(np.int32))]
                        yield pa.RecordBatch.from_arrays([*ids, pa.array(signed(h)), *what], names=[*b.schema.names[:-1], "__bh" if bench else "__h", "__gram" if bench else "__at"])

        return run

    items = _items(bench)
    words = F.regexp_count(F.lower("text"), F.lit(r"[^\x00-/:-@\[-`{-\x{bf}\x{2000}-\x{207f}\x{3000}-\x{303f}]+"))
    lengths = tuple(sorted(r[0] for r in items.select(F.least(words, F.lit(n)).alias("k")).filter(F.col("k") >= min_words).distinct().collect()))  # at most n - min_words + 1
    b = in_arrow(items, emit(True, lengths), T.StructType([items.schema["item_id"], T.StructField("__bh", T.LongType()), T.StructField("__gram", T.StringType())])).distinct()
    d = docs.select("doc_id", text_key().alias("__mr_key"), "text")
    d = in_arrow(d, emit(False, lengths), T.StructType([d.schema["doc_id"], d.schema["__mr_key"], T.StructField("__h", T.LongType()), T.StructField("__at", T.IntegerType())]))
    hits = d.join(b.hint("shuffle_hash"), F.col("__h") == F.col("__bh"))
    hit = F.struct("item_id", F.col("__at").alias("at"), F.col("__gram").alias("gram"))
    return stage(hits.groupBy(F.col("doc_id").alias("__mr_id"), "__mr_key").agg(F.collect_set(hit).alias("__mr_hits")), "candidates")


def _joined(docs: DataFrame, bench: DataFrame, n: int, min_words: int, clean: bool, max_share: float) -> DataFrame:
    """What ``_scan`` gives, without a broadcast of the benchmark."""
    names = docs.columns
    found = _candidates(docs, bench, n, min_words)
    ids = found.select("__mr_id", "__mr_key")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    keyed = docs.withColumn("__mr_of", text_key())
    # only documents with a hit meet their hits; the others are not moved
    on = lambda d: keyed["doc_id"].eqNullSafe(d["__mr_id"]) & (keyed["__mr_of"] == d["__mr_key"])
    none, some = keyed.join(ids, on(ids), "left_anti").select(*names), keyed.join(ids, on(ids), "left_semi")
    some = some.join(found, some["doc_id"].eqNullSafe(found["__mr_id"]) & (some["__mr_of"] == found["__mr_key"])).select(*names, "__mr_hits")

    def verified(b: pa.RecordBatch, at: int, w: Words) -> Iterator[tuple[int, int | None, int, int]]:
        column = b.column("__mr_hits")
        for row in range(len(w.first) - 1):
            for h in column[at + row].as_py():
                k, first = h["gram"].count(" ") + 1, int(w.first[row]) + h["at"]
                if w.text(first, first + k) == h["gram"]:
                    yield row, h["item_id"], h["at"], k

    out = _scan(some, verified, clean, max_share).drop("__mr_hits")
    return none.unionByName(out) if clean else out


def _marked(docs: DataFrame, bench: DataFrame, n: int, min_words: int, clean: bool, max_share: float, broadcast_bytes: int) -> DataFrame:
    if not _fits(bench, broadcast_bytes):
        return _joined(docs, bench, n, min_words, clean, max_share)
    grams = _broadcast(docs.sparkSession, bench, n, min_words)
    return _scan(docs, lambda b, at, w: grams.value.hits(w), clean, max_share)


def contaminated(docs: DataFrame, bench: DataFrame, n: int = N, min_words: int = MIN_WORDS, max_share: float = MAX_SHARE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, start_word, end_word, doc_words, action), a row a span."""
    s = _marked(docs.select("doc_id", "text"), bench, n, min_words, False, max_share, broadcast_bytes)
    s = s.filter(F.size("__mr_spans") > 0).select("doc_id", F.col("__mr_words").alias("doc_words"), "__mr_spans")
    covered = F.size(F.array_distinct(F.flatten(F.transform("__mr_spans", lambda x: F.sequence(x.start_word, x.end_word - 1)))))
    action = F.when(covered > max_share * F.col("doc_words"), "remove_document").otherwise("remove_spans")
    return s.withColumn("action", action).select("doc_id", F.explode("__mr_spans").alias("x"), "doc_words", "action").select("doc_id", "x.item_id", "x.start_word", "x.end_word", "doc_words", "action").distinct()


def decontaminated(docs: DataFrame, bench: DataFrame, n: int = N, min_words: int = MIN_WORDS, max_share: float = MAX_SHARE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` (same columns) without contaminated spans and documents."""
    return _marked(docs, bench, n, min_words, True, max_share, broadcast_bytes)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = f"""
WITH b AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '{WORD_RE2}') AS w FROM benchmark WHERE text IS NOT NULL),
bg AS (SELECT DISTINCT item_id, least(len(w), {N}) AS n, unnest(list_transform(generate_series(1, len(w) - least(len(w), {N}) + 1), lambda i: array_to_string(list_slice(w, i, i + least(len(w), {N}) - 1), ' '))) AS g FROM b WHERE len(w) >= {MIN_WORDS}),
d AS (SELECT DISTINCT doc_id, text, regexp_extract_all(lower(text), '{WORD_RE2}') AS w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT doc_id, text, len(w) AS size, n, i - 1 AS s, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
       FROM (SELECT doc_id, text, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bg))),
h AS (SELECT DISTINCT doc_id, text, size, item_id, s, s + bg.n AS e FROM dg JOIN bg ON dg.g = bg.g AND dg.n = bg.n),
m AS (SELECT *, max(e) OVER (PARTITION BY doc_id, text, item_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM h),
x AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, text, item_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS span FROM m),
c AS (SELECT doc_id, text, count(DISTINCT p) AS covered FROM (SELECT doc_id, text, unnest(generate_series(s, e - 1)) AS p FROM h) GROUP BY ALL)
SELECT DISTINCT x.doc_id, item_id, CAST(min(s) AS INTEGER) AS start_word, CAST(max(e) AS INTEGER) AS end_word, CAST(any_value(size) AS BIGINT) AS doc_words,
  CASE WHEN any_value(covered) > {MAX_SHARE} * any_value(size) THEN 'remove_document' ELSE 'remove_spans' END AS action
FROM x JOIN c ON x.doc_id IS NOT DISTINCT FROM c.doc_id AND x.text = c.text GROUP BY x.doc_id, x.text, item_id, span
"""
