"""The pipeline against its stages done the plain way, each on what the stage before it wrote."""

from __future__ import annotations

import brute
import corpus_pipeline
from millrace.llm import decontaminate, jaccard, linededup, packing, quality
from oracle import SF, connect


def test_against_brute_force(spark, tmp_path):
    con = connect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k + 1 == len(corpus_pipeline.STAGES):
            brute.packed_ok(out.collect(), {d: len(brute.words(t)) for d, t in rows.items()}, packing.CAPACITY)
            last = {(r.doc_id, r.piece, r.n_tokens) for r in out.collect()}
            break
        path = str(tmp_path / str(k))
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        got = {r.doc_id: r.text for r in docs.collect()}
        if k == 0:
            want = {d: rows[d] for d, keep in con.execute(f"SELECT doc_id, keep FROM ({quality.ORACLE_SQL})").fetchall() if keep}
        elif k == 1:
            want = dict(zip(rows, brute.line_dedup(list(rows.items()), linededup.MIN_CHARS)))
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        elif k == 2:
            of = brute.groups(brute.jaccard_pairs(list(rows.items()), jaccard.N, jaccard.PERCENT))
            want = {d: t for d, t in rows.items() if of.get(d, d) == d}
        else:
            want = {}
            found = brute.contamination(rows.items(), items, decontaminate.N, decontaminate.MIN_WORDS)
            for d, t in rows.items():
                cut = decontaminate.merged([s for (i, _), v in found.items() if i == d for s in v])
                if sum(b - a for a, b in cut) <= decontaminate.MAX_SHARE * len(brute.words(t)):
                    want[d] = brute.without_words(t, cut) if cut else t
        assert got == want, name
        rows = got
    assert {(r.doc_id, r.piece, r.n_tokens) for r in corpus_pipeline.run(spark, SF).collect()} == last


def test_edges(spark, tmp_path):
    """Nulls in every column, empty texts, repeated rows and an empty table go through all stages."""
    rows = [(None, None, None), (1, None), (2, ""), (3, "one text of a few words"), (3, "one text of a few words"), (None, "another text of some words", None), (4, "x " * 30_000)]
    (tmp_path / "d").mkdir()
    spark.createDataFrame([(1, None), (None, "a b c d e f g h")], "item_id bigint, text string").write.parquet(str(tmp_path / "d/benchmark.parquet"))
    for given, n in ((rows, 3), ([], 0)):
        docs = brute.table(spark, given).selectExpr("*", "1 as anchor", "2 as __group")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path / "d"))
            if k + 1 < len(corpus_pipeline.STAGES):
                assert out.columns == docs.columns
            path = str(tmp_path / f"{n}-{k}")
            out.write.parquet(path)
            docs = spark.read.parquet(path)
        assert docs.select("doc_id").distinct().count() == n
