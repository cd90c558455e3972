from __future__ import annotations

import brute
import pyarrow as pa
from millrace.llm import common

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def sizes(df):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], names=["rows", "bytes"])

    return [tuple(r) for r in common.in_arrow(df.select("text"), run, "rows bigint, bytes bigint").collect()]


def test_batches_are_bounded_in_bytes(spark):
    before = spark.conf.get(KEY)
    df = brute.table(spark, [(i, "x" * 100_000) for i in range(300)] + [(999, "y" * 20_000_000)]).coalesce(1)
    try:
        got = sizes(df)
        assert sum(r for r, _ in got) == 301 and len(got) >= 4
        assert all(n <= common.BATCH_BYTES + 20_100_000 for _, n in got) and sorted(n for _, n in got)[-2] <= 2 * common.BATCH_BYTES
        spark.conf.set(KEY, str(1 << 20))  # a session's own bound is kept
        assert len(sizes(df)) > 25 and spark.conf.get(KEY) in (str(1 << 20), f"{1 << 20}b")
    finally:
        spark.conf.set(KEY, before)


def test_a_staged_table_is_what_it_was(spark):
    df = brute.table(spark, [(1, None), (None, "")])
    again = common.stage(df, "t")
    assert again.schema == df.schema and sorted(map(repr, again.collect())) == sorted(map(repr, df.collect()))
    assert common.stage(df.limit(0), "t").count() == 0
