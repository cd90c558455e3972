from __future__ import annotations

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from millrace.llm import langid
from oracle import SF


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text").collect()]
    random.Random(5).shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def model(labelled):
    train = labelled[: len(labelled) // 2]
    langs = sorted({x for x, _ in train})
    texts = [[t for x, t in train if x == k] for k in langs]
    m = langid.Model(langs, [t[: len(t) * 4 // 5] for t in texts])
    m.calibrate([t[len(t) * 4 // 5 :] for t in texts])
    return m


def test_held_out_accuracy(model, labelled):
    held = [(x, t) for x, t in labelled[len(labelled) // 2 :] if len(t) > 150]
    said, _, _ = model.choose(pa.array([t for _, t in held], pa.large_string()))
    assert np.mean([a == b for a, (b, _) in zip(said, held)]) > 0.93


def test_gibberish_is_rejected(model):
    r = random.Random(1)
    junk = ["".join(r.choice("qxzjkvwyh ") for _ in range(400)) for _ in range(20)]
    assert model.choose(pa.array(junk, pa.large_string()))[0] == [langid.UND] * 20


def test_probabilities_sum_to_one(model):
    """Over all next symbols, after seen and unseen contexts, of every order."""
    rng = np.random.default_rng(2)
    seen = rng.choice(model.contexts[langid.ORDER], 20)
    for context in [*seen.tolist(), 0x00700F100E2, 0x000100020003]:
        codes = (np.uint64(context) << np.uint64(16)) | np.arange(langid.CLASSES, dtype=np.uint64)
        assert np.allclose(np.exp2(model.log2(codes).astype(float)).sum(axis=0), 1, atol=1e-3)


def test_kneser_ney_by_hand():
    """A bigram's probability by the formula, from counts made the plain way."""
    m = langid.Model(["x"], [["abab abba baba"]])
    s, first = langid.symbols(pa.array(["abab abba baba"], pa.large_string()))
    s = s.tolist()
    four = {}
    for i in range(3, len(s)):
        g = tuple(s[i - 3 : i + 1])
        four[g] = four.get(g, 0) + 1
    d4 = langid._discount(np.array(list(four.values())))
    three = {}
    for g in four:
        three[g[1:]] = three.get(g[1:], 0) + 1
    two, one = {}, {}
    for g in three:
        two[g[1:]] = two.get(g[1:], 0) + 1
    for g in two:
        one[g[1:]] = one.get(g[1:], 0) + 1

    def p(g, tables):
        if not tables:
            return 1 / langid.CLASSES
        t = tables[0]
        d = langid._discount(np.array(list(t.values())))
        ctx = {k: v for k, v in t.items() if k[:-1] == g[:-1]}
        below = p(g[1:], tables[1:])
        return below if not ctx else max(t.get(g, 0) - d, 0) / sum(ctx.values()) + d * len(ctx) / sum(ctx.values()) * below

    assert d4 > 0
    for g in [*list(four)[:5], (1, 2, 1, 1), (9, 9, 9, 1)]:
        code = sum(c << (16 * (3 - i)) for i, c in enumerate(g))
        assert np.isclose(2 ** float(m.log2(np.array([code], np.uint64))[0, 0]), p(g, [four, three, two, one]), rtol=1e-4)


def test_letters_have_numbers_of_their_own():
    """Case folds, scripts don't meet, what is no letter is 0."""
    assert langid._CLASS[ord("A")] == langid._CLASS[ord("a")] != langid._CLASS[ord("b")] and langid._CLASS[ord("1")] == 0
    cjk, cyrillic, arabic = (set(langid._CLASS[a:b].tolist()) for a, b in ((0x4E00, 0x9C00), (0x430, 0x450), (0x628, 0x63B)))
    assert len(cjk) == 0x9C00 - 0x4E00 and len(cyrillic) == 0x20 and not cjk & cyrillic and not cyrillic & arabic
    assert langid._CLASS[0x20000] > 0


class Plain:
    """One language's model, in dictionaries."""

    def __init__(self, texts):
        self.counts = [{}, {}, {}, {}]
        for t in texts:
            s = symbols(t)
            for i in range(3, len(s)):
                self.counts[3][s[i - 3 : i + 1]] = self.counts[3].get(s[i - 3 : i + 1], 0) + 1
        for n in (2, 1, 0):
            for g in self.counts[n + 1]:
                self.counts[n][g[1:]] = self.counts[n].get(g[1:], 0) + 1
        self.context, self.d = [{}, {}, {}, {}], []
        for n, c in enumerate(self.counts):
            for g, m in c.items():
                total, types = self.context[n].get(g[:-1], (0, 0))
                self.context[n][g[:-1]] = (total + m, types + 1)
            one, two = sum(m == 1 for m in c.values()), sum(m == 2 for m in c.values())
            self.d.append(one / (one + 2 * two) if one and two else 0.5)
        self.known = {}

    def p(self, g):
        if not g:
            return 1 / langid.CLASSES
        if g not in self.known:
            n, below = len(g) - 1, self.p(g[1:])
            total, types = self.context[n].get(g[:-1], (0, 0))
            m = self.counts[n].get(g, 0)
            self.known[g] = below if not total else (max(m - self.d[n], 0) if m else 0) / total + self.d[n] * types / total * below
        return self.known[g]

    def entropy(self, t):
        s = symbols(t)
        return -sum(np.log2(self.p(s[i - 3 : i + 1])) for i in range(3, len(s))) / max(len(s) - 3, 1), len(s) - 3


def symbols(t):
    """Letters in lower case, runs of all else as one blank, three blanks before and one after."""
    low = "".join(c.lower()[0] if c.isalpha() else " " for c in t)
    return "   " + " ".join(low.split()) + " "


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted({(r.lang, r["rank"], r.text) for r in langid.sample(docs).collect()})
    langs = sorted({r[0] for r in rows})
    model = langid.fit(docs)
    plain = [Plain([t for x, k, t in rows if x == lang and k % 5]) for lang in langs]
    got = {r.doc_id: r for r in langid.query(spark, SF).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(got) == set(texts)
    for d, t in texts.items():
        if len(t) > 20_000:
            continue
        found = [m.entropy(t) for m in plain]
        best = min(range(len(langs)), key=lambda k: (found[k][0], k))
        h, n = found[best]
        mid, spread, char = model.limits[best]
        rejected = n < langid.MIN_CHARS or h > mid + langid.SPREAD * max(spread, 0.05) + langid.NOISE * char / max(n, 1) ** 0.5
        assert got[d].language == (langid.UND if rejected else langs[best]), d
        assert got[d].letters == n and (n < 2 or abs(got[d].cross_entropy - h) < 2e-3)


def test_ties_go_to_the_language_that_sorts_first(spark):
    same = [(i, f"the same words of both languages number {i % 7} in a row", lang) for i, lang in enumerate(["b", "a"] * 40)]
    d = brute.table(spark, same)
    assert {r.language for r in langid.identified(d, langid.fit(d.withColumn("doc_id", d.doc_id * 0))).collect()} == {"a"}


def test_edges(spark, model):
    rows = [(1, None), (2, ""), (3, "ab"), (4, "12 34 !!"), (None, "x" * 500_000), (5, "\U0001f600 \U0001f600"), (6, "same"), (6, "same")]
    d = brute.table(spark, rows).selectExpr("*", "1 as language", "2 as letters")
    out = langid.identified(d, model)
    assert out.count() == len(rows) and {r.language for r in out.filter("doc_id is not null").collect()} == {langid.UND}
    assert langid.identified(brute.table(spark, []), model).count() == 0


def test_without_training_rows(spark):
    none = langid.fit(brute.table(spark, [(1, None), (2, "text of no language at all", None)]))
    assert {r.language for r in langid.identified(brute.table(spark, [(1, "some text or other")]), none).collect()} == {langid.UND}


def test_sample_is_bounded_and_repeatable(spark):
    d = brute.table(spark, [(i, f"text {i}", "en" if i % 2 else "de") for i in range(100)])
    a, b = (sorted(map(tuple, langid.sample(x, 10).collect())) for x in (d, d.repartition(7)))
    assert a == b and len(a) == 20


def test_query_keeps_every_row(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert langid.query(spark, SF).count() == docs.count()


@pytest.mark.parametrize("docs,chars", [(4, 2000), (1, 400), (60, 60)])
def test_rejection_at_any_size(labelled, spark, docs, chars):
    """A rare language, one of a single document, and one of short texts alone reject gibberish and keep their own."""
    by = {}
    for x, t in labelled:
        if len(t) > 150 and x:
            by.setdefault(x, []).append(t[:chars])
    rows = [(i, t, x) for x, ts in sorted(by.items()) for i, t in enumerate(ts[:docs])]
    m = langid.fit(brute.table(spark, rows))
    r = random.Random(3)
    junk = ["".join(r.choice("qxzjkvwyh ") for _ in range(300)) for _ in range(20)]
    assert m.choose(pa.array(junk, pa.large_string()))[0] == [langid.UND] * 20
    own = [t for ts in by.values() for t in ts[docs : docs + 20]]
    assert np.mean([x != langid.UND for x in m.choose(pa.array(own, pa.large_string()))[0]]) > 0.9
