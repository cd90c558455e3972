"""Joins. Sides are left to the optimizer; nothing is broadcast by hint unless its size is fixed by design."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import dedup


def with_metadata(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """Inner join; of right rows with one key the last by ``order`` counts, right columns replace left ones, rows
    without a key are dropped."""
    last = dedup.first_by(right.filter(F.col(key).isNotNull()), F.col(key), order, last=True).drop(order)
    return left.select(*[c for c in left.columns if c == key or c not in last.columns]).join(last, key)


def split_by_ids(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is among the ids, the others)."""
    k = ids.select(key).distinct()
    return df.join(k, key, "left_semi"), df.join(k, key, "left_anti")


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the ids; rows without a key stay."""
    return df.join(ids.select(key), key, "left_anti")


def mark(df: DataFrame, ids: DataFrame, key: Column, id_col: str, flag: str) -> DataFrame:
    """``flag``: 1 if the key is among the ids, else 0."""
    k = ids.select(F.col(id_col).alias("__mr_id")).filter("__mr_id is not null").distinct()
    return df.join(k, key == F.col("__mr_id"), "left").withColumn(flag, F.when(F.col("__mr_id").isNotNull(), 1).otherwise(0)).drop("__mr_id")


def without_subarticles(df: DataFrame, name: str = "name", suffix: str = "overview") -> DataFrame:
    """Names that begin with the subject of an overview go, overviews stay. The theta join is bucketed: each name is
    exploded to the prefixes whose lengths occur among subjects, so it is an equi-join for any number of rows."""
    subject = F.trim(F.replace(F.col(name), F.lit(suffix), F.lit("")))
    subjects = df.filter(F.col(name).endswith(suffix)).select(subject.alias("__mr_s")).distinct()
    lengths = F.broadcast(subjects.agg(F.collect_set(F.length("__mr_s")).alias("__mr_l")))  # one row, one entry a length
    probes = df.filter(F.col(name).isNotNull()).select(name).distinct().filter(~F.col(name).endswith(suffix)).crossJoin(lengths)
    probes = probes.select(name, F.explode(F.filter("__mr_l", lambda n: n <= F.length(name))).alias("__mr_n"))
    hit = probes.join(subjects, F.substring(F.col(name), F.lit(1), F.col("__mr_n")) == F.col("__mr_s"), "left_semi").select(name).distinct()
    return df.join(hit, name, "left_anti")


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default: str = "Unknown") -> DataFrame:
    """Left join to one value a key, with a default."""
    t = table.groupBy(key).agg(F.max(value).alias(value))
    return df.join(t, key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def enrich_from_xml(df: DataFrame, xml: DataFrame, key: str, column: str = "xml") -> DataFrame:
    """Inner join with the articles of XML answers: (key, mesh, publicationtype)."""
    one = xml.select(F.explode(articles(F.col(column))).alias("x"))
    parsed = one.select(
        F.xpath_string("x", F.lit("/*/PMID | /*//PMID[1]")).alias(key),
        F.xpath("x", F.lit("//MeshHeading/*[1]/text()")).alias("mesh"),
        F.xpath("x", F.lit("//PublicationType/text()")).alias("publicationtype"),
    )
    return df.join(parsed, key)


def articles(xml: Column, tag: str = "PubmedArticle") -> Column:
    """The articles of a set, as an array of XML strings."""
    return F.regexp_extract_all(xml, F.lit(f"(?s)<{tag}\\b.*?</{tag}>"), F.lit(0))


def within(annotations: Column, start: Column, end: Column) -> Column:
    """The first of an array of (start, end) that lies in [start, end], or null."""
    return F.get(F.filter(annotations, lambda x: (x["start"] >= start) & (x["end"] <= end)), F.lit(0))


def replace_source(old: DataFrame, new: DataFrame, source: str = "source") -> DataFrame:
    """``old`` without the sources of ``new``, and ``new``."""
    return old.join(new.select(source).distinct(), source, "left_anti").unionByName(new, allowMissingColumns=True)


def update_by_key(df: DataFrame, answers: DataFrame, key: str, value: str, order: str, place: Sequence[str] = ()) -> DataFrame:
    """``value`` for all rows of a key, from the last answer by ``order``, a whole number; what has no value or no order is no answer.
    Of answers that tie the one least by ``place`` stays, or without it the one that the input has first."""
    known = answers.filter(F.col(value).isNotNull() & F.col(order).isNotNull())
    last = dedup.first_by(known, F.col(key), F.struct((-F.col(order).cast("decimal(20,0)")).alias("order"), *place)).select(key, value)
    return df.drop(value).join(last, key, "left")


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def running_remainder(counts: DataFrame, order: str, n: str, total: int | Column) -> DataFrame:
    """What is left after each stage; the stages are few, so one partition."""
    gone = F.sum(n).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("remaining", (total if isinstance(total, Column) else F.lit(total)) - gone)
