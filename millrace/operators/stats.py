"""Corpus statistics, each one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def source_stats(df: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """Documents, mean and total lines and words by source, and over all (null source)."""
    n = df.select(source, F.size(F.split(text, "\n")).alias("l"), F.size(F.split(text, " ")).alias("w"))
    return n.rollup(source).agg(F.count("*").alias("docs"), F.avg("l").alias("mean_lines"), F.avg("w").alias("mean_words"), F.sum("l").alias("lines"), F.sum("w").alias("words"))


def counts(df: DataFrame, c: str, explode: bool = False) -> DataFrame:
    """(c, n), most frequent first; of an array column, its elements."""
    d = df.select(F.explode(c).alias(c)) if explode else df.select(c)
    return d.groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c)


def distribution(df: DataFrame, c: Column, steps: Sequence[int] = (10, 20, 30, 40, 50, 60, 70, 80, 90, 99)) -> DataFrame:
    """Mean, population deviation, extremes and percentiles."""
    d = df.select(c.alias("x"))
    q = F.percentile("x", F.array(*[F.lit(s / 100) for s in steps]))
    out = d.agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"), q.alias("q"))
    return out.select("mean", "std", "min", "max", *[F.col("q")[i].alias(f"q{s}") for i, s in enumerate(steps)])


def categories(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """(category, n, percent): how many rows meet each condition."""
    one = df.agg(F.count("*").alias("total"), *[F.count_if(c).alias(f"c{i}") for i, c in enumerate(conditions.values())])
    rows = F.array(*[F.struct(F.lit(k).alias("category"), F.col(f"c{i}").alias("n")) for i, k in enumerate(conditions)])
    return one.select("total", F.explode(rows).alias("x")).select("x.category", "x.n", F.when(F.col("total") > 0, 100 * F.col("x.n") / F.col("total")).alias("percent"))


def token_totals(df: DataFrame, text: str, by: str | None = None, expected: int | None = None) -> DataFrame:
    """Token total and mean, and the total expected of so many documents."""
    g = df.select(*([by] if by else []), T.token_estimate(F.col(text)).alias("t")).groupBy(*([by] if by else []))
    out = g.agg(F.sum("t").alias("tokens"), F.count("*").alias("docs"), F.avg("t").alias("mean_tokens"))
    return out if expected is None else out.withColumn("expected_tokens", F.col("mean_tokens") * expected)


def step_counts(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """(status, n): each row counts for the first step that takes it out, else as kept."""
    status = F.lit("kept")
    for name, c in reversed(steps.items()):
        status = F.when(F.coalesce(c, F.lit(False)), name).otherwise(status)
    return df.select(status.alias("status")).groupBy("status").agg(F.count("*").alias("n"))


def sources(df: DataFrame, source: str = "source") -> DataFrame:
    return df.select(source).distinct().orderBy(source)
