from __future__ import annotations

import random

import brute
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from millrace.llm import suffix
from oracle import SF, connect, same


def spans(df):
    return sorted(((r.doc_id, r.start_word, r.end_word) for r in df.collect()), key=repr)


def test_sql(spark):
    same(suffix.query(spark, SF), connect(), suffix.ORACLE_SQL)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 6))
def test_expansion_is_the_common_prefixes(symbols, length):
    t = np.append(np.array(symbols), 9)
    sa, more = suffix.open_after(t, length)
    assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())

    def lcp(a, b):
        n = 0
        while a + n < len(t) and b + n < len(t) and t[a + n] == t[b + n]:
            n += 1
        return n

    assert more.tolist() == [i > 0 and lcp(sa[i - 1], sa[i]) >= length for i in range(len(t))]


def test_small_alphabets_against_brute_force(spark, monkeypatch):
    r = random.Random(9)
    rows = [(i, " ".join(r.choice("abc") for _ in range(r.randint(0, 60)))) for i in range(40)]
    rows += [(i, " ".join(r.choice("abcdefghijkl") for _ in range(80))) for i in range(40, 60)]
    for length, k in ((6, 3), (9, 4)):
        for hot in (suffix.HOT, 5):
            monkeypatch.setattr(suffix, "HOT", hot)
            assert spans(suffix.repeated_spans(brute.table(spark, rows), length, k)) == brute.repeated_spans(rows, length)


def test_edges(spark, monkeypatch):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    passage = " ".join(word() for _ in range(55))
    filler = lambda n: " ".join(word() for _ in range(n))
    rows = [(1, f"{filler(10)} {passage} {filler(10)}"), (2, f"{passage} {filler(300)}"), (3, None), (4, ""), (5, "few words"), (None, f"{filler(5)} {passage}"), (6, f"{filler(30)} {filler(30)}"), (7, "ab " * 30_000), (8, f"{filler(60)}"), (8, None)]
    rows += [rows[6]]  # a row that is repeated is one document
    twice = filler(52)
    rows += [(9, f"{twice} {filler(20)} {twice}")]
    d = brute.table(spark, rows).selectExpr("*", "1 as anchor", "2 as piece", "3 as start", "4 as text_key", "5 as n")
    want = brute.repeated_spans([x[:2] for x in rows], 50)
    assert {x[0] for x in want} == {1, 2, None, 7, 9}
    assert spans(suffix.repeated_spans(d)) == want
    monkeypatch.setattr(suffix, "BROADCAST_ROWS", 0)  # fetched by a shuffle instead
    assert spans(suffix.repeated_spans(d)) == want
    monkeypatch.setattr(suffix, "HOT", 0)  # windows counted by hash instead of compared
    assert spans(suffix.repeated_spans(d)) == want
    assert suffix.repeated_spans(brute.table(spark, [])).count() == 0
