"""Best-fit packing with large-item matching.

A document's length is its number of words, or what the column ``measure`` holds (tokens of some tokenizer). A document longer
than the capacity is cut into full bins and a rest, so nothing is truncated. Items above a third of the capacity are
paired, at most two in a bin, each with the largest that still fits; the smaller ones then go, longest first, into
the tightest gap left. Only (doc_id, text hash, length) is shuffled, never text: documents are spread by a hash over groups of
about ``GROUP`` that are packed independently, so the work is the same a document at any size and only the last few
bins of a group can be loose.

Defined results
* null or empty texts, and null, zero or negative measures, have length 0 and take no place: they are in no bin;
* equal lengths are ordered by doc_id (nulls first), then text hash, so the result does not depend on partitions; where other
  rows come, the groups and the bins of all documents may change, as in any packing;
* rows that repeat a doc_id are separate items; an empty table gives no bins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_arrow, stage, table, text_key
from .words import Words, pieces, strings

CAPACITY = 2048
GROUP = 50_000


def lengths(docs: DataFrame, measure: str | None = None) -> DataFrame:
    """(doc_id, text_key, __mr_len): the number of words of each row, or its ``measure``."""
    ids = [F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key")]
    if measure is not None:
        return docs.select(*ids, F.coalesce(F.col(measure).cast("long"), F.lit(0)).alias("__mr_len"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [np.diff(Words(p).first) for _, p in pieces(strings(b.column("text")))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(np.concatenate(n) if n else np.zeros(0, np.int64))], names=["doc_id", "text_key", "__mr_len"])

    return in_arrow(docs.select(*ids, "text"), run, "doc_id bigint, text_key bigint, __mr_len bigint")


class _Gaps:
    """Bins by room left; the tightest that holds n is found by one bit scan."""

    def __init__(self, capacity: int):
        self.mask, self.by = 0, [[] for _ in range(capacity + 1)]

    def add(self, room: int, b: int) -> None:
        if room:
            self.by[room].append(b)
            self.mask |= 1 << room

    def take(self, need: int) -> tuple[int, int] | None:
        above = self.mask >> need
        if not above:
            return None
        room = need + (above & -above).bit_length() - 1
        b = self.by[room].pop()
        if not self.by[room]:
            self.mask &= ~(1 << room)
        return room, b


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item; sizes between 1 and capacity, in the order that breaks ties."""
    order = np.argsort(-sizes, kind="stable")
    bins = np.full(len(sizes), -1, dtype=np.int64)
    large = order[sizes[order] * 3 > capacity]
    made = 0
    gaps = _Gaps(capacity)
    # greedy matching: the largest left takes the largest other one that fits beside it
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in large[::-1].tolist():
        waiting[sizes[i]].append(i)
        mask |= 1 << int(sizes[i])
    while mask:
        size = mask.bit_length() - 1
        i = waiting[size].pop()
        if not waiting[size]:
            mask &= ~(1 << size)
        bins[i] = made
        room = capacity - size
        below = mask & ((1 << (room + 1)) - 1)
        if below:
            mate = below.bit_length() - 1
            j = waiting[mate].pop()
            if not waiting[mate]:
                mask &= ~(1 << mate)
            bins[j] = made
            room -= mate
        gaps.add(room, made)
        made += 1
    for i in order[len(large) :].tolist():
        n = int(sizes[i])
        found = gaps.take(n)
        room, b = found or (capacity, made)
        made += found is None
        bins[i] = b
        gaps.add(room - n, b)
    return bins


def _group(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["__mr_len", "doc_id", "text_key"], ascending=[False, True, True], na_position="first", kind="stable").reset_index(drop=True)
    n = pdf["__mr_len"].to_numpy()
    count = -(-n // capacity)
    row = np.repeat(np.arange(len(n)), count)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = piece * capacity
    size = np.minimum(n[row] - start, capacity)
    b = pack(size, capacity)
    out = pd.DataFrame({"bin": b, "doc_id": pdf["doc_id"].to_numpy()[row], "piece": piece, "start_token": start, "n_tokens": size}).astype({"doc_id": "Int64"})
    out = out.sort_values(["bin", "n_tokens", "doc_id", "piece"], ascending=[True, False, True, True], kind="stable").reset_index(drop=True)
    first = out.groupby("bin")["n_tokens"].cumsum() - out["n_tokens"]
    out["slot"] = out.groupby("bin").cumcount()
    out["offset"] = first
    out["group"] = int(pdf["__mr_group"].iloc[0])
    return out


def packed(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP, measure: str | None = None) -> DataFrame:
    """(bin_id, slot, offset, doc_id, piece, start_token, n_tokens): where each piece of each document lies."""
    n = stage(lengths(docs, measure).filter("__mr_len > 0"), "lengths")
    groups = max(1, n.count() // group)
    n = n.withColumn("__mr_group", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(groups)).cast("int"))
    schema = T.StructType.fromDDL("bin bigint, doc_id bigint, piece bigint, start_token bigint, n_tokens bigint, slot bigint, offset bigint, group int")
    out = n.groupBy("__mr_group").applyInPandas(lambda pdf: _group(pdf, capacity)[schema.names], schema)
    bin_id = F.shiftleft(F.col("group").cast("long"), 32) + F.col("bin")
    return out.select(bin_id.alias("bin_id"), F.col("slot").cast("int").alias("slot"), F.col("offset").cast("int").alias("offset"), "doc_id", F.col("piece").cast("int").alias("piece"), "start_token", F.col("n_tokens").cast("int").alias("n_tokens"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
