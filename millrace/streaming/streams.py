"""The streaming forms: file streams, dedup by state, micro-batches, resuming from checkpoints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T


def read(spark: SparkSession, path: str, schema, fmt: str = "json", files_a_batch: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt)
    return (r.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else r).load(path)


def bernoulli(df: DataFrame, key: str, keep: float, salt: str = "42") -> DataFrame:
    """A stateless sample; of a stream the same rows as of the table."""
    if not 0 < keep <= 1:
        raise ValueError("keep is a share above 0, at most 1")
    return df.filter(T.uniform(F.col(key), salt) <= keep)


def distinct_by_prefix(df: DataFrame, text: str, chars: int = 500, event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """One row a fingerprint. With an event time, state is kept only for so long; without, for good."""
    d = df.withColumn("fingerprint", F.md5(T.prefix_fingerprint(F.col(text), chars)))
    return d.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["fingerprint"]) if event_time else d.dropDuplicates(["fingerprint"])


def write(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """All that is there now, each input once: a restart goes on where the checkpoint says."""
    return df.writeStream.format(fmt).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def each_batch(df: DataFrame, checkpoint: str, do: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(do).start()


def without_done(done: Callable[[], DataFrame | None], key: str) -> Callable[[DataFrame], DataFrame]:
    """Leaves out keys of a table of finished work that grows between batches."""

    def run(batch: DataFrame) -> DataFrame:
        d = done()
        return batch if d is None else batch.join(d.select(key), key, "left_anti")

    return run


def route(df: DataFrame, bucket: Column, names: list[str], base: str, checkpoint: str) -> StreamingQuery:
    """A folder a bucket, from one pass over each micro-batch."""

    def do(batch: DataFrame, n: int) -> None:
        batch.withColumn("bucket", bucket).filter(F.col("bucket").isin(*names)).write.mode("append").partitionBy("bucket").parquet(base)

    return each_batch(df, checkpoint, do)
