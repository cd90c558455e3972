"""What plans must and must not hold, and what the staged forms give."""

from __future__ import annotations

import json
import warnings

import pytest
from millrace.operators import dedup, guidelines, html, sampling, scoring
from millrace.plans import text as plans
from millrace.sources import io, staging
from oracle import SF
from pyspark.sql import functions as F


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name,mark", [("aafp", "on this topic"), ("idsa", "currently in development"), ("wikidoc", "Redirect to")])
def test_an_article_is_computed_once(spark, name, mark):
    assert optimized(plans._guideline(spark, SF, name)).count(mark) == 1


def test_dedup_shuffles_no_text(spark, monkeypatch):
    """The staged tables hold keys, orders and counts, and the rows themselves meet a broadcast."""
    staged = []
    keep = dedup.stage
    monkeypatch.setattr(dedup, "stage", lambda df, name: staged.append(df.columns) or keep(df, name))
    out = dedup.first_by_prefix(spark.read.parquet(f"{SF}/documents.parquet"), "text", "doc_id", ["source"])
    assert staged and not any("text" in c for c in staged)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


ROWS = [(1, "a", "Same text here"), (2, "a", "same TEXT, here!"), (3, "b", "same text here"), (4, None, "x"), (5, None, "x"), (None, "a", "Same text here"), (2, "a", "same TEXT, here!"), (7, "c", None), (8, "c", None), (9, "d", "tie"), (9, "d", "tie")]


@pytest.mark.parametrize("limit", [staging.BROADCAST_ROWS, -1])
def test_first_by_prefix_with_nulls_ties_and_repeats(spark, monkeypatch, limit):
    monkeypatch.setattr(staging, "BROADCAST_ROWS", limit)
    df = spark.createDataFrame(ROWS, "id int, source string, text string").withColumn("n", F.lit(1))
    out = dedup.first_by_prefix(df, "text", "id", ["source"])
    assert out.columns == df.columns
    # null orders are the least; null sources and texts are keys like any other; of a tie one stays
    assert sorted(map(repr, ((r.id, r.source) for r in out.collect()))) == sorted(map(repr, [(None, "a"), (3, "b"), (4, None), (7, "c"), (9, "d")]))
    assert dedup.first_by_prefix(df.limit(0), "text", "id").count() == 0


def test_first_by_last_and_by_id(spark):
    df = spark.createDataFrame([(1, 5, "x"), (1, 7, "y"), (1, 7, "z"), (0, 1, "p"), (0, 2, "q"), (None, 3, "r")], "k int, o int, v string").coalesce(1)
    assert sorted(map(tuple, dedup.first_by(df.filter("k = 1"), F.col("k"), "o", last=True).collect())) == [(1, 7, "y")]
    for wide in (False, True):
        assert sorted(r.v for r in dedup.first_by_id(df, "k", "o", wide).collect()) == ["p", "q", "r", "x"]


def test_ids_are_ranked_in_ranges(spark):
    rows = [(i * 7 % 101, "ab"[i % 2]) for i in range(101)] + [(None, "a")]
    out = sampling.numbered(spark.createDataFrame(rows, "k int, g string"), "k", by=["g"], ranges=5).collect()
    for g in "ab":
        mine = sorted((r for r in out if r.g == g), key=lambda r: (r.k is None, r.k))
        assert [r.rank for r in mine] == list(range(1, len(mine) + 1))


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    class Context:
        applicationId, master = "other", "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            @staticmethod
            def get(*_):
                return None

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_dir(Session())


def test_build_is_the_whole_corpus(spark):
    rows = [(1, "The first article of all.\nIt is about the care of the patient and of the family."), (2, "the FIRST article of all. It is about the care of the patient, and of the family!"), (3, "Der zweite Artikel ist nicht in der Sprache, die zu behalten ist."), (4, "the a")]
    df = spark.createDataFrame(rows, "id int, text string")
    assert [r.id for r in guidelines.build(df, "rch", "id").collect()] == [1]
    assert sorted(r.id for r in guidelines.build(df, "rch", "id", detect=None).collect()) == [1, 3]


def test_site_sections(spark):
    page = "<div class='content'><h2>Head</h2><p>One</p><ul><li>two</li></ul></div>"
    df = spark.createDataFrame([([("Symptoms & causes", page), ("Doctors", page), ("Diagnosis", None)],), (None,)], "s array<struct<name: string, html: string>>")
    got = [r[0] for r in df.select(html.site_sections(F.col("s"), "patient")).collect()]
    assert [x.name for x in got[0]] == ["Symptoms & causes", "Diagnosis"] and "One\n- two" in got[0][0].body and got[0][1].body is None and got[1] is None
    guidance = spark.createDataFrame([([("1 Context", "<h3>1.2 Aim</h3><p>1.2.3 See [4].</p>")],)], "s array<struct<name: string, html: string>>")
    assert tuple(guidance.select(html.site_sections(F.col("s"), "guidance")).first()[0][0]) == ("Context", "# Aim\nSee .")


def test_reports_and_finetune_files(spark, tmp_path):
    io.write_report(spark.range(2), str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == [{"id": 0}, {"id": 1}]
    assert io.text_report("t", {"a": 1, "b": 0.5, "c": None}, 4) == ["# t", "a: 1 (25.00%)", "b: 0.5000", "c: none", "-" * 20]
    with pytest.raises(ValueError):
        io.write_finetune(spark.range(1), str(tmp_path), "b", "p", "dev")


def test_benchmark_files_warn_where_several_fit(spark, tmp_path):
    for n in ("a-train.jsonl", "b-train.jsonl", "c-val.jsonl"):
        (tmp_path / n).write_text('{"id": 1}\n')
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        files = io.benchmark_files(spark, str(tmp_path))
    assert files["train"].endswith("a-train.jsonl") and files["test"].endswith("c-val.jsonl") and any("2 files" in str(w.message) for w in seen)


def test_journals_are_a_table(spark):
    j = scoring.approved_journals(spark.createDataFrame([("J. Art & Law",), (None,)], "name string"))
    a = spark.createDataFrame([("J Art and Law",), ("J Art & Law",), (None,)], "venue string")
    assert {r.venue: r.approved for r in scoring.with_approved(a, j).collect()} == {"J Art and Law": True, "J Art & Law": False, None: False}
