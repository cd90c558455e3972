"""Session-level helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.staging import BATCH_BYTES, bound_batches, shared_dir, spread, stage  # noqa: F401 - the operators take them from here


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow`` in batches of bounded bytes; what a worker's pool has kept is given back after its last batch."""
    bound_batches(df.sparkSession)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(bounded, schema)


def text_key(text: Column | str = "text") -> Column:
    """With doc_id, the identity of a row: rows that agree in both are one document repeated."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def small(df: DataFrame, limit_rows: int, elements: str | None = None) -> bool:
    """Whether a staged table has at most so many rows, and its array column four times as many elements (it decides
    only how a join runs, never its result). Its rows are numbers, so rows bound bytes."""
    n, m = df.agg(F.count("*"), F.sum(F.size(elements)) if elements else F.lit(0)).first()
    return n <= limit_rows and (m or 0) <= 4 * limit_rows
