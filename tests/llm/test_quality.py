from __future__ import annotations

import random

import brute
from millrace.llm import quality
from oracle import SF, connect, same


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(["the", "of", "and", "to", "stone", "river", "garden", "walks", "in", "a", "quiet"]) for _ in range(n)) + "."


def reasons(df):
    return sorted(((r.doc_id, r["__mr_reason"]) for r in df.select("doc_id", "__mr_reason").collect()), key=repr)


def test_sql(spark):
    same(quality.query(spark, SF), connect(), quality.ORACLE_SQL)


def test_junk_goes_and_prose_stays(spark):
    rows = [(i, prose(200, i)) for i in range(60)] + [(900, "#$%&!@ 0101 " * 60), (901, "xq zzv wrt " * 80), (902, None), (903, ""), (None, prose(200, 77)), (904, "the of"), (905, prose(60_000, 5)), (906, prose(100, 6), None), (1, prose(200, 1))]
    got = dict(reasons(quality.scored(brute.table(spark, rows))))
    assert got[900] == "characters" and got[901] == "words"
    assert got[902] == got[903] == got[904] == "short"
    assert all(got[k] == "kept" for k in [*range(60), 905, None])
    assert got[906] == "short"  # a language of its own, with too little of it
    kept = quality.keep_good(brute.table(spark, rows))
    assert kept.columns == brute.table(spark, []).columns and kept.count() == len(rows) - 2


def test_empty_and_clashing_columns(spark):
    assert quality.scored(brute.table(spark, [])).count() == 0
    d = brute.table(spark, [(i, prose(100, i)) for i in range(30)]).selectExpr("*", "1 as reason", "2 as keep", "3 as words", "4 as s0", "5 as __mr_x")
    assert quality.keep_good(d).columns == d.columns and quality.keep_good(d).count() == 30


def test_divergence_is_the_formula(spark):
    import math

    rows = [(1, "The cat 12, sat"), (2, "of the: dog  ran!")]
    rules = quality.Rules(min_chars=1, min_words=1, min_reference=1)
    got = {r[0]: r[1] for r in quality.scored(brute.table(spark, rows), rules).select("doc_id", "__mr_char_distance").collect()}

    def hist(t):
        kinds = [str.isupper, str.islower, str.isdigit, str.isspace]
        c = [sum(map(k, t)) for k in kinds]
        return [*c, len(t) - sum(c), 0]

    hs = {d: hist(t) for d, t in rows}
    ref = [sum(x) for x in zip(*hs.values())]
    for d, h in hs.items():
        p, q = [x / sum(h) for x in h], [x / sum(ref) for x in ref]
        want = sum(x * math.log2(2 * x / (x + y)) for a, b in ((p, q), (q, p)) for x, y in zip(a, b) if x) / 2
        assert abs(got[d] - math.sqrt(want)) < 1e-9


def test_allowance_is_the_chance_of_the_words(spark):
    """Texts drawn from the language itself: no more of them than stated go beyond the allowance."""
    import numpy as np

    rng = np.random.default_rng(3)
    q = rng.dirichlet(np.ones(quality.N_COMMON + 1) * 5)
    n, rules = 400, quality.Rules()
    p = rng.multinomial(n, q, size=4000) / n
    term = lambda x, y: np.where(x > 0, x * np.log2(np.maximum(2 * x / (x + y), 1e-300)), 0)
    jsd = (term(p, q) + term(q, p)).sum(axis=1) / 2
    assert 0.002 < (jsd > rules.by_chance / n).mean() < 0.02


def test_recall_on_labels(spark):
    found = quality.query(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").groupBy("quality", "keep").count().collect()
    n = {(r.quality, r.keep): r["count"] for r in found}
    assert not n.get((1, False)) and n[0, False] > 0.7 * (n[0, False] + n.get((0, True), 0))
