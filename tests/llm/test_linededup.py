from __future__ import annotations

import random

import brute
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from millrace.llm import linededup
from millrace.llm.linededup import Cuckoo, LineStore
from millrace.llm.words import finish
from oracle import SF, connect, same


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_whole_table(spark):
    same(linededup.query(spark, SF), connect(), linededup.ORACLE_SQL)


def test_whole_table_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    assert toxic & {d for d, _ in rows}
    want = brute.line_dedup(rows, linededup.MIN_CHARS, lambda d: d in toxic)
    got = linededup.query(spark, SF).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted((d, t) for (d, _), t in zip(rows, want))
    before = dict(rows)
    assert all(r.lines == before[r.doc_id].count("\n") + 1 and (r.dropped > 0) == (r.text != before[r.doc_id]) for r in got)
    assert texts(linededup.dedup_lines(spark.read.parquet(f"{SF}/documents.parquet"))) == sorted(((d, t) for (d, _), t in zip(rows, brute.line_dedup(rows, linededup.MIN_CHARS))), key=repr)


def test_edges(spark):
    rows = [(1, "first line here\nsecond line here"), (2, "Second   LINE here \nthird line of it\n\nshort"), (3, None), (4, ""), (None, "third line of it\nfourth line of it"), (5, "\tfirst line here\r\nlast line here \t"), (8, "last line here\r"), (6, "same line twice\nsame line twice\n\n\nshort\nshort"), (7, "\n".join(f"line number {i % 5000}" for i in range(20_000))), (1, "first line here\nsecond line here")]
    d = brute.table(spark, rows).selectExpr("*", "1 as h1", "2 as h2", "3 as text_key", "4 as batch", "5 as line_no")
    out = linededup.dedup_lines(d)
    assert out.columns == d.columns
    assert texts(out) == sorted(((r[0], t) for r, t in zip(rows, brute.line_dedup([(r[0], r[1]) for r in rows], linededup.MIN_CHARS))), key=repr)
    assert linededup.dedup_lines(brute.table(spark, [])).count() == 0


def test_insertions_and_deletions(spark):
    """What a store says after insertions and deletions is what exact counts say."""
    r = random.Random(4)
    make = lambda ids: [(i, "\n".join(f"common line {r.randint(0, 30)}" for _ in range(6))) for i in ids]
    a, b, c = make(range(10)), make(range(10, 20)), make(range(20, 30))
    store = LineStore(spark, shards=3)
    store.insert(brute.table(spark, a)).count()
    drop = {(x.doc_id, x.line_no) for x in store.insert(brute.table(spark, b)).collect()}
    seen, want = {x for _, t in a for x in t.split("\n")}, set()
    for d, t in b:
        for i, x in enumerate(t.split("\n")):
            want |= {(d, i)} if x in seen else set()
            seen.add(x)
    assert drop == want
    moved = {(x.doc_id, x.line_no) for x in store.delete(brute.table(spark, a)).collect()}
    first, had = {}, {x for _, t in a for x in t.split("\n")}
    for d, t in b:
        for i, x in enumerate(t.split("\n")):
            first.setdefault(x, (d, i))
    assert moved == {p for x, p in first.items() if x in had}
    counts = {}
    for _, t in b:
        for x in t.split("\n"):
            counts[x] = counts.get(x, 0) + 1
    assert sorted(x.refs for x in store.counts().collect()) == sorted(counts.values())
    # lines that have gone are new again
    drop = {(x.doc_id, x.line_no) for x in store.insert(brute.table(spark, c)).collect()}
    seen, want = set(first), set()
    for d, t in c:
        for i, x in enumerate(t.split("\n")):
            want |= {(d, i)} if x in seen else set()
            seen.add(x)
    assert drop == want


def test_a_full_filter_is_built_anew(spark):
    store = LineStore(spark, shards=1)
    store.insert(brute.table(spark, [(1, "only one line")])).count()
    many = [(i, "\n".join(f"document {i} line {k}" for k in range(50))) for i in range(2, 30)]
    assert store.insert(brute.table(spark, many)).count() == 0
    assert store.insert(brute.table(spark, [(d + 100, t) for d, t in many])).count() == 28 * 50


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(-(2**63), 2**63 - 1), max_size=300), st.randoms())
def test_cuckoo_has_no_false_negatives(keys, rnd):
    keys = finish(np.array(sorted(keys), dtype=np.int64).view(np.uint64)).view(np.int64)  # keys are hashes
    f = Cuckoo.of(keys)
    assert f.contains(keys).all()
    gone = np.array([rnd.random() < 0.5 for _ in keys], dtype=bool)
    f.delete(keys[gone])
    assert Cuckoo(blob=f.bytes()).contains(keys[~gone]).all()


def test_cuckoo_false_positives_are_few():
    rng = np.random.default_rng(0)
    keys = rng.integers(-(2**63), 2**63 - 1, 40_000)
    f = Cuckoo(20_000)
    assert f.insert(keys[:20_000]) and f.contains(keys[20_000:]).mean() < 0.001


def test_lines_of_one_fingerprint_dont_lean_on_each_other(spark):
    """Two lines that the filter can't tell apart: what is deleted takes only its own fingerprint out, whichever goes."""
    d = linededup.lines_of(brute.table(spark, [(i, f"line number {i} of many") for i in range(20_000)])).select("doc_id", "h1").toPandas()
    f, a, b = Cuckoo()._places(d.h1.to_numpy())
    seen = {}
    pair = next((seen[k], i) for i, k in zip(d.doc_id.tolist(), zip(f.tolist(), np.minimum(a, b).tolist())) if seen.setdefault(k, i) != i)
    lines = [f"line number {i} of many" for i in pair]
    for gone in (0, 1):
        store = LineStore(spark, shards=1)
        for i, line in enumerate(lines):
            assert store.insert(brute.table(spark, [(i, line)])).count() == 0
        store.delete(brute.table(spark, [(gone, lines[gone])])).count()
        assert [x.doc_id for x in store.insert(brute.table(spark, [(3, lines[1 - gone])])).collect()] == [3]
        assert store.insert(brute.table(spark, [(4, lines[gone])])).count() == 0


def test_deletion_of_nulls_repeats_and_clashing_names(spark):
    rows = [(1, "first line here\nsecond line here"), (1, "first line here\nsecond line here"), (2, "second line here\nthird line here"), (None, "third line here\nfourth line here"), (3, None), (4, ""), (5, "fourth line here")]
    clash = "1 as h1", "2 as h2", "3 as text_key", "4 as batch", "5 as line_no", "6 as i", "7 as k", "8 as sign"
    store = LineStore(spark)
    store.insert(brute.table(spark, rows).selectExpr("*", *clash))
    lost = lambda: sorted(((r.doc_id, r.line_no) for r in store.drops().collect()), key=repr)
    assert lost() == [(2, 0), (5, 0), (None, 0)] or lost() == [(2, 0), (None, 0), (None, 1)]
    before = lost()
    assert store.delete(brute.table(spark, [(9, "never held"), (3, None), (4, "")])).count() == 0 and lost() == before
    back = store.delete(brute.table(spark, [rows[0], rows[0], rows[3]]).selectExpr("*", *clash))
    assert sorted((r.doc_id, r.line_no) for r in back.collect()) == [(2, 0)] and lost() == []
    assert store.delete(brute.table(spark, [rows[0]])).count() == 0
    store.insert(brute.table(spark, [rows[0], rows[3]]))
    assert lost() == [(1, 1), (None, 0), (None, 1)]
    assert store.insert(brute.table(spark, [])).count() == 0 and store.delete(brute.table(spark, [])).count() == 0


def test_a_store_is_opened_again(spark, tmp_path):
    path = str(tmp_path / "store")
    LineStore(spark, path=path).insert(brute.table(spark, [(1, "first line here\nsecond line here")]))
    again = LineStore(spark, path=path)
    assert (again.version, again.shards) == (1, 8)
    assert {(r.doc_id, r.line_no) for r in again.insert(brute.table(spark, [(2, "second line here\nthird line here")])).collect()} == {(2, 0)}
    third = LineStore(spark, path=path)
    assert third.version == 2 and sorted(x.refs for x in third.counts().collect()) == [1, 1, 2]
    # what a broken change left behind counts for nothing
    third._append("refs", third.read("refs"))
    assert sorted(x.refs for x in LineStore(spark, path=path).counts().collect()) == [1, 1, 2]
    assert {(r.doc_id, r.line_no) for r in LineStore(spark, path=path).delete(brute.table(spark, [(1, "first line here\nsecond line here")])).collect()} == {(2, 0)}


def test_a_store_that_grows_gets_more_shards(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(linededup, "KEYS_A_SHARD", 50)
    path = str(tmp_path / "store")
    store = LineStore(spark, path=path, shards=1)
    make = lambda a, b: [(i, "\n".join(f"document {i} line {k}" for k in range(40))) for i in range(a, b)]
    for a, b in ((0, 1), (1, 2), (2, 12), (12, 14)):
        assert store.insert(brute.table(spark, make(a, b))).count() == 0
    assert store.shards == 10 and store._current_filters().count() == 10
    again = LineStore(spark, path=path)
    assert (again.shards, again.lines) == (10, 560) and again._current_filters().count() == 10
    assert again.insert(brute.table(spark, [(d + 100, t) for d, t in make(0, 14)])).count() == 560
    again.delete(brute.table(spark, make(0, 14)))
    assert again.insert(brute.table(spark, [(d + 200, t) for d, t in make(3, 5)])).count() == 80
