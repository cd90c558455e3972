"""First-wins dedup, keys and their windows. Order is always an explicit column."""

from __future__ import annotations

from functools import reduce

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.staging import broadcast_if_small, stage
from .sampling import numbered


def first_by(df: DataFrame, key: Column, order: str | Column, by: Sequence[str] = (), last: bool = False) -> DataFrame:
    """The first (or last) row of each key, for tables of narrow rows: an aggregate with map-side combining, so a key of many rows
    is no single task. Of rows that tie in the order the one that the input has first stays; null orders are the least."""
    order = F.col(order) if isinstance(order, str) else order
    placed = df.withColumns({"__mr_key": key, "__mr_order": order, "__mr_place": F.monotonically_increasing_id()})
    place = -F.col("__mr_place") if last else F.col("__mr_place")
    pick = (F.max_by if last else F.min_by)(F.struct(*df.columns), F.struct("__mr_order", place))
    return placed.groupBy(*by, "__mr_key").agg(pick.alias("__mr_row")).select("__mr_row.*")


def first_by_key(df: DataFrame, key: Column, order: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """The same for tables of wide rows: only keys and orders are shuffled, and the rows meet a list of those that go, broadcast
    if it is short."""
    order = F.col(order) if isinstance(order, str) else order
    at = [*by, "__mr_key"]
    alike = lambda a, b, names: reduce(lambda x, y: x & y, (a[n].eqNullSafe(b[n + "_"]) for n in names))
    other = lambda d, names: d.select(*[F.col(n).alias(n + "_") for n in names], *[c for c in d.columns if c not in names])
    rows = stage(df.select(*by, key.alias("__mr_key"), order.alias("__mr_order")).groupBy(*at, "__mr_order").agg(F.count("*").alias("n")), "keys")
    first = other(rows.groupBy(*at).agg(F.min(F.struct("__mr_order")).alias("first"), F.count("*").alias("of")), at)
    judged = rows.join(first, alike(rows, first, at)).filter((F.col("of") > 1) | (F.col("n") > 1))
    leads = F.struct("__mr_order").eqNullSafe(F.col("first"))
    judged = stage(judged.select(*at, "__mr_order", leads.alias("leads"), "n"), "judged")
    place = [*at, "__mr_order"]
    gone, tied = judged.filter("not leads").select(*place), judged.filter("leads and n > 1").select(*place)
    named = df.withColumns({"__mr_key": key, "__mr_order": order})
    g = other(broadcast_if_small(gone), place)
    out = named.join(g, alike(named, g, place), "left_anti")
    if tied.head(1):  # rows of one key and order: one of them stays
        t = other(broadcast_if_small(tied), place)
        some = out.join(t, alike(out, t, place), "left_semi")
        out = out.join(t, alike(out, t, place), "left_anti").unionByName(some.dropDuplicates(at))
    return out.drop("__mr_key", "__mr_order")


def first_by_prefix(df: DataFrame, text: str, order: str | Column, by: Sequence[str] = (), chars: int = 500) -> DataFrame:
    """The first row of each fingerprint: letters and digits of the first characters, in lower case. The shuffle key is
    the fingerprint's 128-bit hash, and no text is shuffled."""
    return first_by_key(df, F.md5(T.prefix_fingerprint(F.col(text), chars)), order, by)


def first_by_id(df: DataFrame, key: str, order: str | Column, wide: bool = False) -> DataFrame:
    """The first row of each id; rows without an id (null, empty or zero) all stay."""
    c = F.col(key)
    none = c.isNull() | c.cast("string").isin("", "0")
    return df.filter(none).unionByName((first_by_key if wide else first_by)(df.filter(~none), c, order))


def surrogate_ids(df: DataFrame, source: str, order: str) -> DataFrame:
    """``id``: SHA-1 of the source and the row's 0-based place in it, by a number column; a source is ranked in ranges of it."""
    n = numbered(df, order, by=[source])
    return n.withColumn("id", F.sha1(F.concat(F.col(source), (F.col("rank") - 1).cast("string")))).drop("rank")


def merge_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """(name, urls in order, text of the first, duplicates, of which with the same text)."""
    g = df.groupBy(name).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(order, "url"))), lambda x: x["url"]).alias("urls"),
        F.min_by("text", order).alias("text"),
        (F.count("*") - 1).alias("duplicates"),
        F.array_sort(F.collect_list(F.struct(order, "text"))).alias("__mr_all"),
    )
    same = F.size(F.filter(F.slice("__mr_all", F.lit(2), F.size("__mr_all")), lambda x: x["text"].eqNullSafe(F.col("text"))))
    return g.withColumn("same_text", same).drop("__mr_all")


def runs(df: DataFrame, by: Sequence[str], order: str, label: str) -> DataFrame:
    """Consecutive rows of one label: (by, label, first, last, n)."""
    w = Window.partitionBy(*by).orderBy(order)
    d = df.withColumn("__mr_new", F.when(F.lag(label).over(w).eqNullSafe(F.col(label)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    d = d.withColumn("__mr_run", F.sum("__mr_new").over(w))
    return d.groupBy(*by, "__mr_run", label).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("__mr_run")
