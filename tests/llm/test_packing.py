from __future__ import annotations

import random

import brute
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from millrace.llm import packing
from oracle import SF


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_pack_is_the_plain_search(sizes):
    bins = packing.pack(np.array(sizes, dtype=np.int64), 30)
    rooms = [30 - sum(s for s, b in zip(sizes, bins) if b == k) for k in sorted(set(bins.tolist()))]
    assert sorted(rooms) == brute.pack_sizes(sizes, 30)


def test_round_trip(spark):
    lengths = {r.doc_id: len(brute.words(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    bins = brute.packed_ok(packing.query(spark, SF).collect(), lengths, packing.CAPACITY)
    assert len(bins) <= 1.05 * -(-sum(lengths.values()) // packing.CAPACITY) + 1
    want = [n % packing.CAPACITY or packing.CAPACITY for n in lengths.values() if n] + [packing.CAPACITY] * sum((n - 1) // packing.CAPACITY for n in lengths.values() if n)
    assert sorted(packing.CAPACITY - sum(n for _, n, _ in b) for b in bins.values()) == brute.pack_sizes(want, packing.CAPACITY)


def test_edges(spark):
    rows = [(1, "a b c"), (2, None), (3, ""), (4, "w " * 25_001), (None, "a b"), (5, " ".join("x" * 7)), (5, " ".join("x" * 7)), (6, "?!")]
    d = brute.table(spark, rows).selectExpr("*", "1 as bin", "2 as slot", "3 as piece", "4 as __group", "5 as n_tokens")
    out = packing.packed(d, capacity=10, group=3).collect()
    n = {}
    for r in out:
        n[r.doc_id] = n.get(r.doc_id, 0) + r.n_tokens
    assert n == {1: 3, 4: 25_001, None: 2, 5: 14}
    assert packing.packed(brute.table(spark, [])).count() == 0


def test_groups_are_tight(spark):
    r = random.Random(2)
    rows = [(i, "w " * r.randint(1, 200)) for i in range(2000)]
    lengths = {d: t.count("w") for d, t in rows}
    bins = brute.packed_ok(packing.packed(brute.table(spark, rows), capacity=256, group=300).collect(), lengths, 256)
    assert len(bins) <= 1.1 * sum(lengths.values()) / 256


def test_the_same_at_any_partitioning_and_nulls_are_spread(spark):
    rows = [(i % 50 if i % 3 else None, f"w{i} " * (1 + i % 9)) for i in range(900)]
    d = brute.table(spark, rows)
    one, many = (sorted(map(repr, packing.packed(x, capacity=16, group=100).collect())) for x in (d.coalesce(1), d.repartition(7)))
    assert one == many
    groups = {r.bin_id >> 32 for r in packing.packed(d, capacity=16, group=100).filter("doc_id is null").collect()}
    assert len(groups) > 3


def test_a_measure_of_tokens(spark):
    d = brute.table(spark, [(1, "a b"), (2, "c"), (3, "d"), (4, None)]).selectExpr("*", "case doc_id when 1 then 7 when 2 then 25 when 3 then null else -1 end as tokens")
    out = packing.packed(d, capacity=10, measure="tokens").collect()
    brute.packed_ok(out, {1: 7, 2: 25, 3: 0, 4: 0}, 10)
