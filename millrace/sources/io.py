"""Readers and writers. Schemas are given, not inferred; bad lines fail, are dropped, or are kept apart, as asked."""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CORRUPT = "_corrupt_record"


# --- readers


def read_jsonl(spark: SparkSession, path: str | list[str], schema: StructType | str, bad: str = "fail") -> DataFrame:
    """``bad``: fail at a bad line, drop it, or keep it in ``_corrupt_record``. Compressed files are read by their names."""
    mode = {"fail": "FAILFAST", "drop": "DROPMALFORMED", "keep": "PERMISSIVE"}[bad]
    s = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if bad == "keep" and CORRUPT not in s.names:
        s = StructType([*s.fields]).add(CORRUPT, "string")
    return spark.read.schema(s).option("mode", mode).option("columnNameOfCorruptRecord", CORRUPT).json(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One document a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_gzip(spark: SparkSession, path: str, schema: StructType | str, partitions: int | None = None) -> DataFrame:
    """Gzip members can't be split, so rows are spread after the scan; by default over the shuffle partitions."""
    df = read_jsonl(spark, path, schema)
    return df.repartition(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")))


def rows_between(df: DataFrame, order: str, start: int, end: int | None = None) -> DataFrame:
    """Rows start to end - 1 in the order of a column. Ranks come from one sort that is limited first."""
    out = df.orderBy(order)
    return out.offset(start).limit(end - start) if end is not None else out.offset(start)


def read_parts(spark: SparkSession, root: str, names: list[str], column: str = "part", keep: Callable[[str], bool] = lambda n: True, fmt: str = "parquet") -> DataFrame:
    """Named parts of a corpus under one root, with the name in a column; parts that ``keep`` refuses aren't listed."""
    parts = [spark.read.format(fmt).load(f"{root.rstrip('/')}/{n}").withColumn(column, F.lit(n)) for n in names if keep(n)]
    if not parts:
        raise ValueError(f"no part of {names} is kept")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def code_corpus(spark: SparkSession, root: str, names: list[str], ignore_git: bool = False, notebooks_only: bool = False) -> DataFrame:
    """(text, source, lang part): names with git are left out, or only those with jupyter kept."""
    df = read_parts(spark, root, names, "starcoder-lang", lambda n: not (ignore_git and "git" in n) and (not notebooks_only or "jupyter" in n))
    return df.withColumnRenamed("content", "text").withColumn("source", F.lit("starcoder"))


WEB_PARTS = ("arxiv", "book", "stackexchange", "wikipedia")
MORE_WEB_PARTS = ("c4", "common_crawl", "github")


def web_corpus(spark: SparkSession, root: str, small: bool = True) -> DataFrame:
    return read_parts(spark, root, [*WEB_PARTS, *(() if small else MORE_WEB_PARTS)], "pajama-block").withColumn("source", F.lit("redpajama"))


def refined_web(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path).withColumnRenamed("content", "text")
    return df.withColumn("source", F.lit("falcon-web")).withColumn("timestamp", F.col("timestamp").cast("string"))


def composite(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def benchmark_files(spark: SparkSession, root: str) -> dict[str, str]:
    """The first file named for training and the first for testing or validation, by name; a warning where several are."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(root))
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(hadoop)
    files = sorted((f.getPath().getName(), f.getPath().toString()) for f in found if not f.getPath().getName().startswith((".", "_")))
    wanted, out = {"train": ("train",), "test": ("test", "val")}, {}
    for kind, names in wanted.items():
        fits = [path for name, path in files if any(n in name for n in names)]
        if len(fits) > 1:
            warnings.warn(f"{root} has {len(fits)} files for {kind}; the first is taken", stacklevel=2)
        if fits:
            out[kind] = fits[0]
    return out


def read_benchmark(spark: SparkSession, root: str, schema: str, split: str, subsets: tuple[str, ...] = ()) -> DataFrame:
    """A split from files in a folder, or the union of the subset folders with a ``subset`` column."""
    if split not in ("train", "test", "validation"):
        raise ValueError(f"unknown split {split!r}")
    if subsets:
        return composite(*[read_benchmark(spark, f"{root}/{s}", schema, split).withColumn("subset", F.lit(s)) for s in subsets])
    files = benchmark_files(spark, root)
    kind = "train" if split == "train" else "test"
    if kind not in files:
        raise FileNotFoundError(f"{root} has no file for {split}")
    return read_jsonl(spark, files[kind], schema)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id): the distinct non-empty lines of a text file."""
    return spark.read.text(path).select(F.trim("value").alias("id")).filter("id <> ''").distinct()


def read_binary(spark: SparkSession, path: str, parse: Callable[[bytes], str], glob: str = "*.pdf") -> DataFrame:
    """(file_name, text) of files through a parser; files that it can't read are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for name, content in zip(p["path"], p["content"]):
                try:
                    out.append((name.rsplit("/", 1)[-1], parse(content)))
                except Exception:  # a parser may raise anything; one bad file must not end the job
                    continue
            yield pd.DataFrame(out, columns=["file_name", "text"])

    return files.mapInPandas(run, "file_name string, text string")


def read_links(spark: SparkSession, path: str, links: Callable[[bytes], list[str]], glob: str = "*.pdf") -> DataFrame:
    """(file_name, link): the distinct targets that a parser finds in each file."""
    found = read_binary(spark, path, lambda b: json.dumps(links(b)), glob)
    return found.select("file_name", F.explode(F.array_distinct(F.from_json("text", "array<string>"))).alias("link"))


def named(paths: list[str], wanted: tuple[str, ...], unwanted: tuple[str, ...] = ("guideline",)) -> list[str]:
    """Files whose name holds one of the wanted parts and none of the others; only these are then read."""
    name = lambda p: p.rsplit("/", 1)[-1]
    return [p for p in paths if any(w in name(p) for w in wanted) and not any(u in name(p) for u in unwanted)]


def read_xml_ids(xml: Column) -> Column:
    """Ids of a search answer."""
    return F.xpath(xml, F.lit("//Id/text()"))


def provenance(path: Column) -> Column:
    """Subset by the path of a file: the first that it names."""
    out = F.lit("unknown")
    for name in reversed(("s2orc", "abstracts", "guidelines", "replay")):
        out = F.when(path.contains(name), name).otherwise(out)
    return out


def with_provenance(df: DataFrame) -> DataFrame:
    return df.withColumn("subset", provenance(F.col("_metadata.file_path")))


def external_id(df: DataFrame, dataset: str) -> Column:
    """The id that a dataset's rows go by, or null."""
    some = lambda *names: F.coalesce(*[F.when(F.length(F.col(n).cast("string")) > 0, F.col(n).cast("string")) for n in names])
    paths = {"abstracts": ("openaccessinfo.externalids.PubMedCentral",), "s2orc": ("externalids.pubmed", "externalids.pubmedcentral"), "papers": ("externalids.PubMed", "externalids.PubMedCentral")}
    return some(*paths[dataset])


def id_kind(pubmed: Column, central: Column) -> Column:
    """``pmc``, ``pm`` or null; an empty id is none."""
    has = lambda c: F.coalesce(F.length(c.cast("string")) > 0, F.lit(False))
    return F.when(has(central), "pmc").when(has(pubmed), "pm")


def combine(parts: dict[str, DataFrame]) -> DataFrame:
    """The corpus: all parts with their ``subset``; cleaned guidelines give their ``clean_text`` as ``text``."""
    out = []
    for name, df in parts.items():
        if "clean_text" in df.columns:
            df = df.withColumn("text", F.coalesce("text", "clean_text") if "text" in df.columns else F.col("clean_text"))
        out.append(df.withColumn("subset", F.lit(name)))
    return composite(*out)


# --- writers


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object a line, nulls written. ``mode``: errorifexists, overwrite, append, or ignore to skip what is there."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_routed(df: DataFrame, path: str, bucket: Column, mode: str = "errorifexists") -> None:
    """One pass, an output folder a bucket."""
    df.withColumn("bucket", bucket).write.mode(mode).partitionBy("bucket").option("ignoreNullFields", False).json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_report(df: DataFrame, path: str, limit: int = 10_000) -> None:
    """A small result as one JSON document; more than ``limit`` rows are refused."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report of more than {limit} rows; write it as a table")
    write_text(df.sparkSession, [json.dumps([r.asDict(recursive=True) for r in rows], indent=2, default=str)], path)


def write_text(spark: SparkSession, lines: list[str], path: str) -> None:
    """A few lines as one text file, through the cluster's file system: a path that executors and driver share."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(hadoop, True)
    try:
        out.write(bytearray("\n".join([*lines, ""]).encode()))
    finally:
        out.close()


def text_report(title: str, counts: dict[str, int | float | None], of: int | None = None) -> list[str]:
    """Lines "name: value", with shares of ``of`` in percent where it is given."""
    value = lambda v: "none" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    share = lambda v: f" ({v / of * 100:.2f}%)" if of and isinstance(v, int) else ""
    return [f"# {title}", *[f"{k}: {value(v)}{share(v)}" for k, v in counts.items()], "-" * 20]


def finetune_path(root: str, benchmark: str, prompt: str, split: str) -> str:
    return f"{root.rstrip('/')}/{benchmark}_{prompt}_{split}.jsonl"


def write_finetune(df: DataFrame, root: str, benchmark: str, prompt: str, split: str) -> str:
    """A prepared benchmark as JSON lines, under the name of benchmark, prompt and split; returns the path."""
    if split not in ("train", "test", "validation"):
        raise ValueError(f"unknown split {split!r}")
    path = finetune_path(root, benchmark, prompt, split)
    write_jsonl(df, path)
    return path


def article_text(abstract: Column, sections: Column) -> Column:
    """Abstract and sections, an array of (heading, text), of a parsed file: the first section follows the abstract directly."""
    parts = F.transform(sections, lambda s: F.concat(F.lit("# "), s["heading"], F.lit("\n"), s["text"]))
    return F.concat(F.coalesce(abstract, F.lit("None")), F.array_join(parts, "\n"))


def replay(df: DataFrame, key: str, path: str, keep: float = 1.0, seed: int | None = None) -> None:
    """A share of a replay corpus as JSON lines; of a stream the same rows as of the table, in one pass. Refuses to overwrite."""
    from ..streaming import streams

    out = streams.bernoulli(df, key, keep, str(seed if seed is not None else 42))
    if df.isStreaming:
        streams.write(out, path, f"{path.rstrip('/')}-checkpoint", "json").awaitTermination()
    else:
        write_jsonl(out, path)


def write_samples(df: DataFrame, path: str, group: str, key: str, text: str, k: int = 10) -> None:
    """k texts a group, as text files by group."""
    from ..operators import sampling

    s = sampling.per_group(df, group, key, k).select(group, F.concat_ws("\n\n", text, F.lit("---")).alias("value"))
    s.write.mode("overwrite").partitionBy(group).text(path)


def generations_path(root: str, benchmark: str, checkpoint: str, shots: int = 0) -> str:
    return f"{root}/{benchmark}-{checkpoint}{f'-{shots}-shot' if shots else ''}.jsonl"


def split_path(path: str, split: str) -> str:
    """x.jsonl to x_train.jsonl."""
    return path.removesuffix(".jsonl") + f"_{split}.jsonl"


def histogram(df: DataFrame, c: str) -> DataFrame:
    return df.groupBy(c).agg(F.count("*").alias("n")).orderBy(c)


def tokenize(df: DataFrame, text: str, tokenizer: str, end_id: int | None = None) -> DataFrame:
    """``tokens``: ids by a tokenizer file (Hugging Face JSON, or a SentencePiece .model), with an end id if given."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if tokenizer.endswith(".model"):
            import sentencepiece

            p = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
            encode = lambda x: p.encode(x, num_threads=1)
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(tokenizer)
            t.encode_special_tokens = True
            encode = lambda x: [e.ids for e in t.encode_batch(x, add_special_tokens=False)]
        for part in parts:
            ids = encode(part[text].fillna("").tolist())
            yield part.assign(tokens=[[*i, end_id] if end_id is not None else i for i in ids])

    from pyspark.sql.types import ArrayType, IntegerType, StructField

    return df.mapInPandas(run, StructType([*df.schema.fields, StructField("tokens", ArrayType(IntegerType()))]))
