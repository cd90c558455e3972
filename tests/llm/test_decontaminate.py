from __future__ import annotations

import brute
import pytest
from millrace.llm import decontaminate as D
from oracle import SF, connect, same

ITEM = "The quick brown fox, jumps over the lazy dog near the old river bank"
SHORT = "six words make a short item"
ITEMS = [(1, ITEM), (1, ITEM), (2, SHORT), (3, None), (4, ""), (None, ITEM), (5, "too short"), (6, ITEM.upper() + " today")]


def bench(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id bigint, text string")


FILL = " ".join(f"fill{i}" for i in range(40))
ROWS = [
    (1, f"{FILL}. {ITEM} {FILL}"), (1, f"{FILL}. {ITEM} {FILL}"), (2, ITEM), (3, None), (4, ""), (None, f"{FILL} {SHORT.title()}! {FILL}"), (5, f"{FILL} quick brown fox jumps over the lazy {FILL}"),
    (6, ("long text " * 50_000) + ITEM), (7, f"İstanbul ẞ {FILL} {ITEM} {FILL}"), (8, f"{FILL} fox jumps over the lazy dog near the {FILL}"), (9, SHORT + " and five more words behind it here"),
]


def spans(df):
    return {(r.doc_id, r.item_id, r.start_word, r.end_word) for r in df.collect()}


def test_sql(spark):
    same(D.query(spark, SF), connect(), D.ORACLE_SQL)


@pytest.mark.parametrize("limit", [D.BROADCAST_BYTES, 0])
def test_both_ways_against_brute_force(spark, limit):
    want = brute.contamination(ROWS, ITEMS, D.N, D.MIN_WORDS)
    d = brute.table(spark, ROWS).selectExpr("*", "1 as item_id", "2 as h", "3 as spans", "4 as start_word")
    assert spans(D.contaminated(d, bench(spark), broadcast_bytes=limit)) == {(*k, *s) for k, v in want.items() for s in v}
    out = D.decontaminated(d, bench(spark), broadcast_bytes=limit)
    assert out.columns == d.columns
    texts = []
    for i, t in ROWS:
        cut = D.merged([s for (d_, _), v in brute.contamination([(i, t)], ITEMS, D.N, D.MIN_WORDS).items() for s in v])
        if sum(b - a for a, b in cut) <= 0.5 * len(brute.words(t)):
            texts.append((i, (f"İstanbul ẞ {FILL}  {FILL}" if i == 7 else brute.without_words(t, cut)) if cut else t))
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(texts, key=repr)


@pytest.mark.parametrize("limit", [D.BROADCAST_BYTES, 0])
def test_empty(spark, limit):
    for rows, items in (([], ITEMS), (ROWS, []), ([], [])):
        assert D.contaminated(brute.table(spark, rows), bench(spark, items), broadcast_bytes=limit).count() == 0
        assert D.decontaminated(brute.table(spark, rows), bench(spark, items), broadcast_bytes=limit).count() == len(rows)


@pytest.mark.parametrize("limit", [D.BROADCAST_BYTES, 0])
def test_items_without_an_id_and_hashes_that_collide(spark, limit, monkeypatch):
    items = [(None, ITEM), (None, SHORT), (3, "other words of an item that stand nowhere at all")]
    want = brute.contamination(ROWS, items, D.N, D.MIN_WORDS)
    assert any(k[1] is None for k in want)
    assert spans(D.contaminated(brute.table(spark, ROWS), bench(spark, items), broadcast_bytes=limit)) == {(*k, *s) for k, v in want.items() for s in v}


def test_a_hit_is_verified_word_by_word():
    import numpy as np
    import pyarrow as pa

    g = D.Grams([(1, ITEM)], D.N, D.MIN_WORDS)
    w = D.Words(pa.array([FILL], pa.large_string()))
    keys, places = g.by[D.N]
    g.by[D.N] = (np.sort(w.ngrams(D.N)[1][: len(keys)]), places)  # the document's own hashes, with other words behind them
    assert g.hits(w) == set()
