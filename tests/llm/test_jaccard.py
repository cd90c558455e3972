from __future__ import annotations

import random
from collections import Counter

import brute
import pytest
from millrace.llm import jaccard
from oracle import SF, connect, same


def pairs(df):
    return {(r.doc_id_a, r.doc_id_b, r.shared, r.total) for r in df.collect()}


def rows_of(df):
    return sorted((r.doc_id, r.class_id, r.copies, r.links) for r in df.collect())


def expected(rows):
    found = brute.jaccard_pairs(rows, jaccard.N, jaccard.PERCENT)
    of, links = brute.groups(found), Counter(x for p in found for x in p[:2])
    copies = Counter(x for a, b, shared, total in found if shared == total for x in (a, b))
    return found, sorted((d, of.get(d, d), copies[d], links[d]) for d, _ in rows)


def corpus(seed=1):
    """Random texts, copies with some words changed, exact copies, and a large group."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(800)]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(30, 90)))) for i in range(60)]
    for i in range(60):
        w = rows[i][1].split()
        for _ in range(r.randint(0, 3)):
            x = list(w)
            for _ in range(r.randint(0, 6)):
                x[r.randrange(len(x))] = r.choice(vocabulary)
            rows.append((len(rows), " ".join(x)))
    base = rows[0][1].split()
    for i in range(120):
        x = list(base)
        x[i % len(x)] = f"v{i}"
        rows.append((len(rows), " ".join(x)))
    return rows


def test_recall_and_exactness(spark):
    rows = corpus()
    found, want = expected(rows)
    by = dict(rows)
    sets = {d: frozenset(brute.grams(t, jaccard.N)) for d, t in by.items()}
    least = {}
    for d in sorted(by):
        least.setdefault(sets[d], d)
    want_pairs = {(a, b, s, t) for a, b, s, t in found if s < t and least[sets[a]] == a and least[sets[b]] == b}
    got = pairs(jaccard.class_pairs(brute.table(spark, rows)))
    assert got <= want_pairs and len(got) >= 0.99 * len(want_pairs)
    mine = rows_of(jaccard.similar(brute.table(spark, rows)))
    assert sum(a == b for a, b in zip(mine, want)) >= 0.97 * len(want)
    assert all(x[3] <= y[3] and x[2] == y[2] for x, y in zip(mine, want))


def test_whole_table(spark):
    same(jaccard.query(spark, SF), connect(), jaccard.ORACLE_SQL)


def test_sql_is_brute_force(spark, tmp_path):
    rows = corpus(4)
    brute.table(spark, rows).toPandas().to_parquet(str(tmp_path / "documents.parquet"))
    got = connect(str(tmp_path)).execute(f"SELECT doc_id, class_id, copies, links FROM ({jaccard.ORACLE_SQL}) ORDER BY doc_id").fetchall()
    assert got == expected(rows)[1]


def test_shuffled_fetch_small_groups_and_salted_queries_give_the_same(spark, monkeypatch):
    rows = corpus(2)
    want = rows_of(jaccard.similar(brute.table(spark, rows)))
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(jaccard, "GROUP_GRAMS", 400)
    monkeypatch.setattr(jaccard, "QUERY_GRAMS", 300)
    assert rows_of(jaccard.similar(brute.table(spark, rows))) == want
    one = jaccard.one_of_each(brute.table(spark, rows))
    monkeypatch.undo()
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in jaccard.one_of_each(brute.table(spark, rows)).collect()}


def test_groups_are_bounded_in_ngrams_not_members(spark, monkeypatch):
    """A group of long texts is split, and its links are still all found."""
    monkeypatch.setattr(jaccard, "GROUP_GRAMS", 4_000)
    base = [f"t{i}" for i in range(3_000)]
    rows = [(k, " ".join([*base[: 100 * k], f"v{k}", *base[100 * k :]])) for k in range(8)]
    assert rows_of(jaccard.similar(brute.table(spark, rows))) == [(k, 0, 0, 7) for k in range(8)]


def test_matrix_row_round_trip_and_bound():
    import numpy as np

    sets = [np.array(sorted(x), np.uint64) for x in ({1, 2, 3, 4}, {3, 4, 5, 6}, {9, 10})]
    g = jaccard.Group.read(jaccard.Group.of([7, 8, 9], [1, 2, 1], sets).bytes())
    assert g.union.tolist() == [1, 2, 3, 4, 5, 6, 9, 10] and g.sizes.tolist() == [4, 4, 2] and g.docs.tolist() == [1, 2, 1]
    assert g.query(np.array([1, 20, 21], np.uint64), 50) is None
    members, shared = g.query(np.array([1, 2, 3, 5], np.uint64), 50)
    assert members.tolist() == [0] and shared.tolist() == [3]
    assert [(i, m.tolist(), s.tolist()) for i, m, s in g.own(30)] == [(0, [1], [2]), (1, [], []), (2, [], [])]


def test_one_of_each(spark):
    rows = corpus(3)
    of = {d: c for d, c, _, _ in rows_of(jaccard.similar(brute.table(spark, rows)))}
    kept = {r.doc_id for r in jaccard.one_of_each(brute.table(spark, rows)).collect()}
    assert kept == {d for d, _ in rows if of[d] == d}


def test_edges(spark):
    a = "one two three four five six seven eight nine ten"
    rows = [(1, a), (1, a), (2, a + " eleven"), (3, None), (3, None), (4, ""), (4, ""), (None, a), (5, "hi you"), (6, "Hi, you!"), (7, "x " * 60_000), (8, "y " + "x " * 60_000), (9, "alone in this table with these words")]
    d = brute.table(spark, rows).selectExpr("*", "1 as sid", "2 as bands", "3 as text_key", "4 as root", "5 as gid", "6 as class_id")
    got = sorted(((r.doc_id, r.class_id, r.copies, r.links) for r in jaccard.similar(d).collect()), key=repr)
    assert got == sorted([(1, 1, 0, 1), (2, 1, 0, 1), (3, 3, 0, 0), (4, 4, 0, 0), (None, None, 0, 0), (5, 5, 1, 1), (6, 5, 1, 1), (7, 7, 0, 1), (8, 7, 0, 1), (9, 9, 0, 0)], key=repr)
    out = jaccard.one_of_each(d)
    assert out.columns == d.columns
    assert sorted(map(repr, (r.doc_id for r in out.collect()))) == sorted(map(repr, [1, 3, 3, 4, 4, None, 5, 7, 9]))


@pytest.mark.parametrize("f", [jaccard.similar, jaccard.class_pairs, jaccard.one_of_each])
def test_empty(spark, f):
    assert f(brute.table(spark, [])).count() == 0


def test_components(spark):
    r = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 140)] + [(r.randint(0, 60), r.randint(0, 60)) for _ in range(40)]
    got = {x.node: x.root for x in jaccard.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == brute.groups([e for e in edges if e[0] != e[1]])
