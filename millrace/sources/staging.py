"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A staged table of keys of at most so many rows (and 64 bytes a row) is broadcast.
BROADCAST_ROWS = 200_000
#: Bytes of an Arrow batch that goes to a Python worker, so that its memory follows neither the number of rows in a batch nor
#: their length (one row that is longer goes alone). A session that has set its own bound keeps it.
BATCH_BYTES = 8 << 20
_ARROW_BYTES, _ARROW_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This session's folder below spark.checkpoint.dir, which all executors share; removed when the driver ends. Only a
    local session, whose executors are this process, may do without that setting."""
    sc = spark.sparkContext
    if sc.applicationId not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
        if not base:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="millrace-")
        path = f"{base.rstrip('/')}/millrace-{uuid.uuid4().hex}"
        hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(hadoop)
        fs.deleteOnExit(hadoop)
        _folders[sc.applicationId] = path
    return _folders[sc.applicationId]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: a lineage cut that outlives lost executors, and
    gives later joins true sizes."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(keys: DataFrame) -> DataFrame:
    """A staged table of keys, marked for broadcast if it has few rows (it decides only how a join runs)."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def spread(df: DataFrame) -> DataFrame:
    """A scan whose largest partition holds twice a core's share of the rows or more over all cores; any other as it is. Partitions are
    counted by rows: a file of one row group is cut into several, of which all but one are empty."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    n = df._jdf.rdd().getNumPartitions()
    if n * 2 > cores and n < 4 * cores:
        rows = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        return df.repartition(cores) if max(rows, default=0) * cores >= 2 * sum(rows) > 0 else df
    return df.repartition(cores) if n * 2 <= cores else df


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of this session that go to Python get a bound in bytes, unless it has set its own."""
    if spark.conf.get(_ARROW_BYTES) == _ARROW_DEFAULT:
        spark.conf.set(_ARROW_BYTES, str(BATCH_BYTES))
