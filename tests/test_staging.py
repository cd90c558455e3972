"""How scans are spread, and the bound of what goes to Python at once."""

from __future__ import annotations

import pyarrow as pa
from millrace.plans import registry
from millrace.plans import text as plans
from millrace.sources import staging
from oracle import rows_of
from pyspark.sql import functions as F

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
PART = "spark.sql.files.maxPartitionBytes"


def test_one_row_group_in_several_partitions_is_spread(spark, tmp_path):
    """A file of one row group that is cut into as many partitions as there are cores is read by one of them."""
    spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text")).coalesce(1).write.parquet(str(tmp_path / "t"))
    before, opened = spark.conf.get(PART), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set(PART, str(256 << 10))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = spark.read.parquet(str(tmp_path / "t"))
        cores = spark.sparkContext.defaultParallelism
        assert cores < 2 * df.rdd.getNumPartitions()
        out = staging.spread(df)
        rows = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(rows) == 20_000 and max(rows) * cores < 2 * sum(rows)
        assert rows_of(out.columns, out.collect()) == rows_of(df.columns, df.collect())
    finally:
        spark.conf.set(PART, before)
        spark.conf.set("spark.sql.files.openCostInBytes", opened)


def test_batches_of_text_queries_are_bounded(spark, tmp_path):
    before = spark.conf.get(KEY)
    try:
        spark.conf.set(KEY, "67108864b")  # as a session starts
        spark.range(400).select(F.col("id").alias("page_id"), F.repeat(F.lit("<p>x</p>"), 12_500).alias("html")).coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
        pages = registry.table(spark, str(tmp_path), "pages").coalesce(1)

        @F.arrow_udf("long")
        def size(x: pa.Array) -> pa.Array:
            return pa.array([x.nbytes] * len(x), pa.int64())

        assert pages.select(size("html").alias("n")).agg(F.max("n")).first()[0] <= 2 * staging.BATCH_BYTES
    finally:
        spark.conf.set(KEY, before)


def test_conversion_of_nulls_and_empty_articles(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, ""), (3, "<h2>A</h2><p>b</p>")], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert {r.page_id: r.text for r in plans._html("patient")(spark, str(tmp_path)).collect()} == {1: None, 2: "", 3: "A\nb"}


def test_xml_is_parsed_on_all_cores(spark, tmp_path):
    """A table of one partition, however small, is not parsed by one core."""
    spark.range(400).selectExpr("id AS p_partkey", "concat('n', id) AS p_name", "'t' AS p_type", "'b' AS p_brand").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    out = registry.queries()["xml_fields"](spark, str(tmp_path))
    rows = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(rows) == 400 and max(rows) * spark.sparkContext.defaultParallelism < 800
    assert tuple(out.filter("p_partkey = 7").first()) == (7, "7", "t,n7", "b")
