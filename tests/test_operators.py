"""Operators whose meaning the tables alone don't show."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from millrace.operators import dedup, evaluation, joins, prompts, sampling, scoring, standoff, stats
from oracle import SF


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- dedup and joins


def test_first_by_prefix_keeps_the_first(spark):
    df = spark.createDataFrame([(1, "A b-c"), (2, "abc"), (3, None), (4, None), (5, "abd")], "i int, t string")
    assert rows(dedup.first_by_prefix(df, "t", "i").select("i")) == [(1,), (3,), (5,)]


def test_rows_without_an_id_all_stay(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a"), (5, ""), (6, "")], "i int, k string")
    assert rows(dedup.first_by_id(df, "k", "i").select("i")) == [(1,), (2,), (3,), (5,), (6,)]


def test_prefix_anti_join_knows_lengths(spark):
    df = spark.createDataFrame([(x,) for x in ("Heart overview", "Heart attack", "Hear", "Lung", "Heart", None)], "name string")
    assert {r.name for r in joins.without_subarticles(df).collect()} == {"Heart overview", "Hear", "Lung", None}


def test_metadata_of_the_last_row_wins(spark):
    left = spark.createDataFrame([(1, "old"), (2, "x"), (None, "y")], "k int, v string")
    right = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (None, "c", 3)], "k int, v string, o int")
    assert rows(joins.with_metadata(left, right, "k", "o")) == [(1, "b")]


def test_marks_and_sub_spans(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    assert rows(joins.mark(df, spark.createDataFrame([(2,), (None,)], "id int"), F.col("k"), "id", "f")) == [(1, 0), (2, 1), (None, 0)]
    spans = spark.createDataFrame([Row(a=[Row(start=0, end=9), Row(start=3, end=5), Row(start=4, end=5)])])
    assert spans.select(joins.within(F.col("a"), F.lit(2), F.lit(6))["start"]).first()[0] == 3


# --- sampling


def test_splits_are_exact_and_repeatable(spark):
    df = spark.range(1003).toDF("k")
    a, b = (rows(sampling.exact_split(d, "k")) for d in (df, df.repartition(7)))
    assert a == b
    n = {s: sum(1 for _, x in a if x == s) for s in ("train", "validation", "test")}
    assert n == {"train": 902, "validation": 50, "test": 51}


def test_group_ranks(spark):
    df = spark.range(3000).selectExpr("id as k", "cast(id % 3 = 0 as string) as g")
    got = sampling.ranked(df, "k", by=["g"])
    for g, n in (("true", 1000), ("false", 2000)):
        assert sorted(r["rank"] for r in got.filter(F.col("g") == g).collect()) == list(range(1, n + 1))


def test_priority_quotas(spark):
    df = spark.createDataFrame([(i, "a" if i < 20 else "b" if i < 60 else "c") for i in range(100)], "k int, g string")
    n = {r.g: r["count"] for r in sampling.downsample(df, "g", "k", 50, ["a"]).groupBy("g").count().collect()}
    assert n == {"a": 20, "b": 15, "c": 15}


def test_replication_follows_the_factor(spark):
    df = spark.range(20_000).select(F.col("id").alias("k"), F.lit(1.3).alias("f"))
    n = df.select(sampling.stochastic_round(F.col("f"), "k").alias("n"))
    assert rows(n.distinct()) == [(1,), (2,)] and abs(n.agg(F.avg("n")).first()[0] - 1.3) < 0.02
    assert sampling.replicate(df.limit(3), F.lit(2)).count() == 6 and sampling.replicate(df.limit(3), F.lit(0)).count() == 0


# --- scoring


def test_factors_and_reasons(spark):
    schema = "publicationtype array<string>, mesh array<string>, venue string, publicationDate string, citationCount int, top25 double, bottom25 double"
    df = spark.createDataFrame(
        [
            (["Review", "Review"], ["Humans"], "Good: Journal", "2022-07-16", 100, 10.0, 1.0), (["Preprint"], ["Humans"], "x", "2022-07-16", 100, 10.0, 1.0), (["Review"], ["Animals"], "x", "2022-07-16", 100, 10.0, 1.0),
            (["Review"], ["Humans"], "x", "no date", 100, 10.0, 1.0), (None, ["Humans"], "x", "2022-07-16", 1, 10.0, 1.0), (["Review"], [], "x", "2001-01-01", 100, 10.0, 1.0), (["Novelty"], [], "x", "2022-07-16", 100, 10.0, 1.0), (["Guideline"], [], "x", "2022-07-16", 1, 10.0, 1.0),
        ], schema)
    ok = scoring.journal_key(F.col("venue")) == scoring.approved_key("Good, Journal")
    assert [r[0] for r in df.select(scoring.factor(ok)).collect()] == [4.0, scoring.DROP, scoring.DROP + 0.5, scoring.DROP, scoring.DROP, 1.0, 0.0, 2.0]
    assert [r[0] for r in df.select(scoring.reason(ok)).collect()] == ["include", "publication_type", "mesh", "nometadata", "nometadata", "date", "publication_notcovered", "citation"]


# --- articles


def test_rendering():
    text = "Front matter\nIntroduction\nWe saw (1) that it works. x = y\nFigure 1\nFig. 1: A small plot\nReferences\nA long title Smith"
    at = lambda s, k=0: {"start": text.index(s, k), "end": text.index(s, k) + len(s)}
    ann = {
        "sectionheader": [at("Introduction")],
        "bibref": [{**at("1"), "attributes": {"ref_id": "b0"}}],
        "bibentry": [{**at("A long title Smith"), "attributes": {"id": "b0"}}],
        "bibtitle": [at("A long title")], "bibauthorlastname": [at("Smith")],
        "formula": [at("x = y")],
    }
    out = standoff.Article(text, {k: json.dumps(v) for k, v in ann.items()}, standoff.Options()).render()
    assert "Front" not in out and "\n# Introduction\n" in out and "[bib_ref] A long title, Smith [/bib_ref]" in out and "[formula] x = y [/formula]" in out
    assert standoff.Article("", {}, standoff.Options()).render() is None
    assert "[bib]" in standoff.Article(text, {k: json.dumps(v) for k, v in ann.items()}, standoff.Options(bibliography=True)).render()
    assert set(standoff.Options().special_tokens()) >= {"[bib_ref]", "[/bib_ref]", "[fig]", "[/table]"}


def test_unreadable_annotations_give_null(spark):
    df = spark.createDataFrame([("text", "[{"), ("text", None), ("text", '[{"start":0}]')], "t string, sectionheader string")
    assert [r[0] for r in df.select(standoff.render(F.col("t"), F.struct("sectionheader"))).collect()] == [None, "text", None]


def test_xml(spark):
    xml = "<S><PubmedArticle><PMID>1</PMID><MeshHeading><D>Heart &amp; lung</D><Q>q</Q></MeshHeading><PublicationType>Review</PublicationType></PubmedArticle><PubmedArticle><PMID>2</PMID></PubmedArticle></S>"
    got = joins.enrich_from_xml(spark.createDataFrame([("1",), ("2",), ("3",)], "pmid string"), spark.createDataFrame([(xml,)], "xml string"), "pmid")
    assert rows(got) == [("1", ["Heart & lung"], ["Review"]), ("2", [], [])]


# --- answers and prompts


def test_answers(spark):
    df = spark.createDataFrame([("A. it is", "a"), ("B", "c"), ("zzz", "a"), ("the answer is: C ###", "so answer is: c ###"), (None, "a")], "output string, gold string")
    assert [(r.status, r.pred) for r in evaluation.judged(df).collect()][:3] == [(1, "a"), (0, "b"), (2, "zzz")]
    assert [r.status for r in evaluation.judged(df, cot=True).collect()][3:] == [1, 2]
    assert evaluation.answer_type("gsm8k") == "numeric" and evaluation.answer_type("other") == "mcq"


def test_weighted_scores_against_the_formula(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "b"), ("c", "c"), ("a", "a")]
    r = evaluation.weighted_scores(spark.createDataFrame(pairs, "p string, g string"), "p", "g", swapped=False).first()
    want = dict.fromkeys(("precision", "recall", "f1"), 0.0)
    for x in {g for _, g in pairs}:
        tp, pred, true = sum(p == g == x for p, g in pairs), sum(p == x for p, _ in pairs), sum(g == x for _, g in pairs)
        for k, v in (("precision", tp / pred if pred else 0), ("recall", tp / true), ("f1", 2 * tp / (pred + true))):
            want[k] += v * true / len(pairs)
    assert all(abs(r[k] - v) < 1e-12 for k, v in want.items())


def test_majority_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([("P", "b", "a", 1), ("p", "a", "a", 2), ("p", "a", "a", 3), ("q", "c", "x", 4), ("q", "d", "x", 5)], "prompt string, pred string, answer string, i int")
    assert rows(evaluation.majority(df, "prompt", "i")) == [("p", "a", "a", 2), ("q", "c", "x", 1)]


@pytest.mark.parametrize(("word", "want"), [("caresses", "caress"), ("ponies", "poni"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("adjustment", "adjust"), ("electrical", "electr"), ("sky", "sky")])
def test_stems(word, want):
    assert evaluation.stem(word) == want


def test_entities(spark):
    assert evaluation.match_entities(["Heart attacks", "tumour (TM)", "x"], ["heart attack", "tm", "y"]) == (2, 3, 3)
    df = spark.createDataFrame([("a#b", "a#c"), (None, None)], "output string, gold string")
    r = evaluation.entity_scores(df).first()
    assert (r.precision, r.recall, r.f1, r.total) == (0.5, 0.5, 0.5, 2)


def test_prompts(spark):
    df = spark.createDataFrame([(i, f"q{i}", "w", "x", "y", "z", i % 5) for i in range(6)], "id int, question string, opa string, opb string, opc string, opd string, cop int")
    out = {r.id: r for r in prompts.prepare(df, "medmcqa", with_instruction=False).collect()}
    assert out[1].prompt == "Question: q1?\n\nOptions:\nA. w\nB. x\nC. y\nD. z" and [out[i].gold for i in range(6)] == ["A", "B", "C", "D", None, "A"]
    bank = prompts.prepare(df, "medmcqa", with_instruction=False).filter("gold is not null")
    shot = prompts.prepare(df, "medmcqa", 2, bank).first().prompt
    assert shot.count("The answer is: ") >= 2 and shot.count("Question:") == 3
    with pytest.raises(KeyError):
        prompts.prepare(df, "none")
    assert prompts.instruction("medqa4_x") == prompts.INSTRUCTIONS["medqa4"]
    assert prompts.parallel_levels("m-tp2-pp4") == (2, 4) and prompts.cut_at("ab###c", ("###",)) == "ab"


def test_generation_calls_the_model_once_a_prompt(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "prompt string, i int")
    got = prompts.generate(df, lambda xs: [x + "!###rest" for x in xs])
    assert rows(got.select("i", "output")) == [(1, "a!"), (2, "a!"), (3, "b!")]


def test_top_token(spark):
    df = spark.createDataFrame([({"a": -2.0, "c": -1.0, "b": -1.0},)], "m map<string,double>")
    assert df.select(prompts.top_token(F.col("m"))).first()[0] == "b"


# --- statistics


def test_statistics(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    s = {r.source: r for r in stats.source_stats(docs).collect()}
    assert s[None].docs == docs.count() == sum(r.docs for k, r in s.items() if k)
    assert sum(r.n for r in stats.step_counts(docs, {"never": F.lit(False), "null": F.lit(None)}).collect()) == docs.count()


def test_selections():
    assert prompts.selected("curated", "medqa4") == prompts.Selection("mcq", "test", "medqa", None)
    assert prompts.selected("simple", "pubmedqa", cot=True) == prompts.Selection("mcq", "test", "open_question_cot", "long_answer")
    assert prompts.selected("finetune", "gsm8k", tags=True, cot=True).prompt == "gsm8k_tags_cot"
    for kind, runs in prompts.SELECTIONS.items():
        for name in runs:
            assert prompts.instruction(prompts.selected(kind, name).prompt)
    with pytest.raises(KeyError):
        prompts.selected("finetune", "blurb")


def test_the_last_answer_follows_the_order_of_files_and_skips_nulls(spark, tmp_path):
    """Files of growing sizes, so that partitions come in another order than files; a null is no answer."""
    import duckdb
    from millrace.plans import corpus, registry
    from oracle import connect, same

    con = duckdb.connect()
    (tmp_path / "lineitem.parquet").mkdir()
    con.execute(f"COPY (SELECT range AS o_orderkey FROM range(5)) TO '{tmp_path}/orders.parquet'")
    for i in range(3):
        rows = f"SELECT range % 4 AS l_orderkey, CASE WHEN range % 4 = 2 THEN NULL ELSE CAST(1 AS INTEGER) END AS l_linenumber, 'f{i}' AS l_returnflag FROM range({10 ** (i + 1)})"
        rows += " UNION ALL SELECT 1, 2, NULL UNION ALL SELECT 3, NULL, 'n'"
        con.execute(f"COPY ({rows}) TO '{tmp_path}/lineitem.parquet/part-{i}.parquet'")
    duck = connect(str(tmp_path))
    duck.execute("SET threads = 1")
    got = corpus.update_by_key(spark, str(tmp_path))
    assert {r.o_orderkey: r.answer for r in got.collect()} == {0: "f0", 1: "f0", 2: None, 3: "f0", 4: None}
    same(got, duck, registry.oracle_sql()["update_by_key"])
