"""All queries of the package, by name, with the SQL that states what each returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.staging import bound_batches, spread

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "guideline_build"
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        if f.__name__ in _queries:
            raise ValueError(f"two queries are called {f.__name__}")
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df  # the work on texts is large against their reading


def _load() -> None:
    from . import corpus, evaluation, more, text  # noqa: F401 - they register themselves


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
