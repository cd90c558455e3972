"""Readers, writers and streams."""

from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from millrace.sources import io
from millrace.streaming import streams


def jsonl(path, rows):
    path.write_text("".join(r if isinstance(r, str) else json.dumps(r) + "\n" for r in rows))
    return str(path)


def test_bad_lines(spark, tmp_path):
    p = jsonl(tmp_path / "x.jsonl", [{"a": 1, "b": "é"}, "not json\n", {"a": 3}])
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        io.read_jsonl(spark, p, "a int, b string").collect()
    assert io.read_jsonl(spark, p, "a int, b string", "drop").filter("a is not null").count() == 2
    kept = io.read_jsonl(spark, p, "a int, b string", "keep").cache()
    assert [r[io.CORRUPT] for r in kept.filter(f"{io.CORRUPT} is not null").collect()] == ["not json"]


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x\ny")], "a int, b string")
    io.write_jsonl(df, str(tmp_path / "j"))
    assert sorted(map(tuple, io.read_jsonl(spark, str(tmp_path / "j"), "a int, b string").collect())) == [(1, None), (2, "x\ny")]
    assert '"b":null' in "".join(p.read_text() for p in (tmp_path / "j").glob("*.json"))
    io.write_parquet(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    io.write_routed(df, str(tmp_path / "r"), F.when(F.col("a") == 1, "one").otherwise("more"))
    assert sorted(p.name for p in (tmp_path / "r").glob("bucket=*")) == ["bucket=more", "bucket=one"]
    io.write_report(df, str(tmp_path / "rep.json"))
    assert json.loads((tmp_path / "rep.json").read_text())[1]["b"] == "x\ny"
    with pytest.raises(ValueError, match="more than 1"):
        io.write_report(df, str(tmp_path / "no.json"), limit=1)


def test_gzip_and_single_documents(spark, tmp_path):
    with gzip.open(tmp_path / "x.jsonl.gz", "wt") as f:
        f.write('{"a": 1}\n{"a": 2}\n')
    df = io.read_gzip(spark, str(tmp_path / "x.jsonl.gz"), "a int", 3)
    assert df.count() == 2 and df.rdd.getNumPartitions() == 3
    (tmp_path / "one.json").write_text('{\n "a": 7\n}')
    assert io.read_json(spark, str(tmp_path / "one.json"), "a int").first().a == 7


def test_parts_and_corpora(spark, tmp_path):
    for n in ("python", "git-commits", "jupyter-scripts"):
        spark.createDataFrame([(n,)], "content string").write.parquet(str(tmp_path / n))
    names = ["python", "git-commits", "jupyter-scripts"]
    assert io.code_corpus(spark, str(tmp_path), names, ignore_git=True).count() == 2
    assert [r["starcoder-lang"] for r in io.code_corpus(spark, str(tmp_path), names, notebooks_only=True).collect()] == ["jupyter-scripts"]
    with pytest.raises(ValueError, match="no part"):
        io.read_parts(spark, str(tmp_path), names, keep=lambda n: False)


def test_combine_fills_missing_columns(spark):
    a, b = spark.createDataFrame([("x",)], "clean_text string"), spark.createDataFrame([("y", 1)], "text string, n int")
    assert sorted((r.subset, r.text, r.n) for r in io.combine({"guidelines": a, "more": b}).collect()) == [("guidelines", "x", None), ("more", "y", 1)]


def test_benchmarks(spark, tmp_path):
    jsonl(tmp_path / "b_train.jsonl", [{"q": "a"}])
    jsonl(tmp_path / "b_val.jsonl", [{"q": "b"}])
    assert io.read_benchmark(spark, str(tmp_path), "q string", "validation").first().q == "b"
    with pytest.raises(ValueError, match="unknown split"):
        io.read_benchmark(spark, str(tmp_path), "q string", "dev")
    for s in ("s1", "s2"):
        (tmp_path / s).mkdir()
        jsonl(tmp_path / s / "train.jsonl", [{"q": s}])
    assert sorted((r.q, r.subset) for r in io.read_benchmark(spark, str(tmp_path), "q string", "train", ("s1", "s2")).collect()) == [("s1", "s1"), ("s2", "s2")]


def test_ids_binary_and_paths(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("1\n\n 2 \n1\n")
    assert sorted(r.id for r in io.read_ids(spark, str(tmp_path / "ids.txt")).collect()) == ["1", "2"]
    (tmp_path / "a.pdf").write_bytes(b"good")
    (tmp_path / "b.pdf").write_bytes(b"\xff")
    assert [tuple(r) for r in io.read_binary(spark, str(tmp_path), lambda b: b.decode()).collect()] == [("a.pdf", "good")]
    links = io.read_links(spark, str(tmp_path), lambda b: [b.decode(), "x", "x"])
    assert sorted(map(tuple, links.collect())) == [("a.pdf", "good"), ("a.pdf", "x")]
    assert io.named(["/a/who.jsonl", "/a/who_guideline.jsonl", "/who/cma.jsonl"], ("who",)) == ["/a/who.jsonl"]
    assert io.split_path("x.jsonl", "test") == "x_test.jsonl" and io.generations_path("r", "b", "c", 3) == "r/b-c-3-shot.jsonl"
    df = spark.createDataFrame([("/d/s2orc/x",), ("/d/other",)], "p string")
    assert [r[0] for r in df.select(io.provenance(F.col("p"))).collect()] == ["s2orc", "unknown"]


def test_streams_resume_and_leave_out_what_is_done(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    (tmp_path / "in").mkdir()
    jsonl(tmp_path / "in/a.json", [{"k": 1, "t": "Same text"}, {"k": 2, "t": "same-TEXT"}])
    read = lambda: streams.distinct_by_prefix(streams.read(spark, src, "k int, t string"), "t").select("fingerprint")
    streams.write(read(), out, ck).awaitTermination()
    jsonl(tmp_path / "in/b.json", [{"k": 3, "t": "same text"}, {"k": 4, "t": "another"}])
    streams.write(read(), out, ck).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    rest = streams.without_done(lambda: spark.createDataFrame([(1,)], "k int"), "k")(spark.createDataFrame([(1,), (2,)], "k int"))
    assert [r.k for r in rest.collect()] == [2]
    streams.route(streams.read(spark, src, "k int, t string"), F.when(F.col("k") < 3, "low").otherwise("high"), ["low"], str(tmp_path / "routed"), str(tmp_path / "ck2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "routed")).select("k", "bucket").collect() and spark.read.parquet(str(tmp_path / "routed")).count() == 2
    with pytest.raises(ValueError, match="share"):
        streams.bernoulli(spark.range(1), "id", 0)


def test_tokenizer(spark):
    P = pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([("hello world",), (None,)], "t string")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    got = [r.tokens for r in io.tokenize(df, "t", path, 50256).collect()]
    assert got == [[*Tokenizer.from_file(path).encode("hello world").ids, 50256], [50256]]
