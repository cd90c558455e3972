"""Samples and splits from hashes of keys: the same rows whatever the partitioning, and on every run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

SALT = "42"


def bernoulli(df: DataFrame, key: str, ratio: float, salt: str = SALT, inclusive: bool = False) -> DataFrame:
    u = T.uniform(F.col(key), salt)
    return df.filter(u <= ratio if inclusive else u < ratio)


def train_test(df: DataFrame, key: str, test: float, salt: str = SALT) -> DataFrame:
    """``split``: test with that probability, else train."""
    return df.withColumn("split", F.when(T.uniform(F.col(key), salt) < test, "test").otherwise("train"))


def ranked(df: DataFrame, key: str, salt: str = SALT, buckets: int = 1024, by: Sequence[str] = ()) -> DataFrame:
    """(by, key, rank): 1-based places of all rows (of each group) in the order of their hashes, without bringing them, or
    a large group, to one partition: hashes are counted by bucket, ranked within, and shifted by what lies before."""
    u = df.select(*by, F.col(key), T.uniform(F.col(key), salt).alias("u")).withColumn("b", F.floor(F.col("u") * buckets).cast("int"))
    n = u.groupBy(*by, "b").agg(F.count("*").alias("n"))
    before = n.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(*by, "b", "before")
    r = u.withColumn("r", F.row_number().over(Window.partitionBy(*by, "b").orderBy("u", key)))
    # without groups ``before`` has as many rows as buckets; with groups it is laid out as the ranks are
    return r.join(before if by else F.broadcast(before), [*by, "b"]).select(*by, key, (F.col("r") + F.col("before")).alias("rank"))


def numbered(df: DataFrame, key: str, *ties: str, by: Sequence[str] = (), ranges: int = 128) -> DataFrame:
    """``df`` with ``rank``: 1-based places of all rows (of each group) in the order of a number column (nulls last, equal keys by
    ``ties``), without bringing them, or a large group, to one partition: keys are cut to ranges at approximate quantiles,
    ranked within, and shifted by what lies before. Where the cuts fall doesn't change a rank."""
    cuts = df.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 10_000).alias("__mr_cuts"))
    below = F.size(F.filter("__mr_cuts", lambda c: c < F.col(key)))
    u = df.crossJoin(F.broadcast(cuts)).withColumn("__mr_b", F.when(F.col(key).isNull(), ranges).otherwise(below)).drop("__mr_cuts")
    n = df.select(*by, key).crossJoin(F.broadcast(cuts)).groupBy(*by, F.when(F.col(key).isNull(), ranges).otherwise(below).alias("__mr_b")).agg(F.count("*").alias("n"))
    before = n.select(*by, "__mr_b", F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("__mr_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__mr_before"))
    r = u.withColumn("__mr_r", F.row_number().over(Window.partitionBy(*by, "__mr_b").orderBy(F.col(key).asc_nulls_last(), *ties)))
    # without groups ``before`` has as many rows as ranges; with groups it is laid out as the ranks are
    before = before.select(*[F.col(c).alias(f"__mr_{c}") for c in by], F.col("__mr_b").alias("__mr_of"), "__mr_before")
    on = F.col("__mr_b") == F.col("__mr_of")
    for c in by:
        on = on & r[c].eqNullSafe(before[f"__mr_{c}"])
    out = r.join(before if by else F.broadcast(before), on)
    return out.withColumn("rank", F.col("__mr_r") + F.col("__mr_before")).select(*df.columns, "rank")


def exact_split(df: DataFrame, key: str, train: float = 0.9, validation: float = 0.5, salt: str = SALT) -> DataFrame:
    """``split``: floor(train n) rows, of the rest floor(validation part), the others test. ``key`` is unique."""
    n = df.agg(F.count("*").alias("n"))
    cut = F.floor(F.col("n") * train)
    cuts = n.select(cut.alias("a"), (cut + F.floor((F.col("n") - cut) * validation)).alias("b"))
    r = ranked(df, key, salt).crossJoin(F.broadcast(cuts))
    part = F.when(F.col("rank") <= F.col("a"), "train").when(F.col("rank") <= F.col("b"), "validation").otherwise("test")
    return df.join(r.select(key, part.alias("split")), key)


def exactly(df: DataFrame, key: str, keep: int | float, salt: str = SALT) -> DataFrame:
    """``keep`` rows, or that share of them rounded down."""
    r = ranked(df, key, salt)
    if isinstance(keep, float):
        n = df.agg(F.floor(F.count("*") * keep).alias("k"))
        chosen = r.crossJoin(F.broadcast(n)).filter("rank <= k")
    else:
        chosen = r.filter(F.col("rank") <= keep)
    return df.join(chosen.select(key), key, "left_semi")


def per_group(df: DataFrame, group: str, key: str, k: int, salt: str = SALT) -> DataFrame:
    """k rows a group, or all of a smaller one; the engine limits each partition before the shuffle."""
    w = Window.partitionBy(group).orderBy(T.uniform(F.col(key), salt), key)
    return df.withColumn("__mr_k", F.row_number().over(w)).filter(F.col("__mr_k") <= k).drop("__mr_k")


def first_k(df: DataFrame, key: str, k: int, salt: str = SALT) -> DataFrame:
    """k rows of a seeded shuffle, in its order."""
    return df.orderBy(T.uniform(F.col(key), salt), key).limit(k)


def quotas(sizes: DataFrame, group: str, keep: int | float, priority: Sequence[str] = ()) -> DataFrame:
    """(group, n, quota) from (group, n): prioritised groups first, by min(1, keep / their total) of each, rounded down,
    then the others with what is left."""
    first = F.col(group).isin(*priority) if priority else F.lit(False)
    everything = Window.partitionBy()
    t = sizes.withColumn("first", first)
    total = F.sum("n").over(everything)
    t = t.withColumn("keep", F.floor(total * keep) if isinstance(keep, float) else F.lit(keep))
    share = lambda k, s: F.when(s > 0, F.least(F.lit(1.0), k / s)).otherwise(0.0)
    of = lambda flag: F.sum(F.when(flag, F.col("n")).otherwise(0)).over(everything)
    t = t.withColumn("q1", F.when(F.col("first"), F.floor(share(F.col("keep"), of(F.col("first"))) * F.col("n"))).otherwise(0))
    left = F.col("keep") - F.sum("q1").over(everything)
    q2 = F.floor(share(left, of(~F.col("first"))) * F.col("n"))
    return t.withColumn("quota", F.when(F.col("first"), F.col("q1")).otherwise(q2).cast("long")).select(group, "n", "quota")


def downsample(df: DataFrame, group: str, key: str, keep: int | float, priority: Sequence[str] = (), salt: str = SALT) -> DataFrame:
    """The quota of each group, by hash."""
    q = quotas(df.groupBy(group).agg(F.count("*").alias("n")), group, keep, priority)
    chosen = ranked(df, key, salt, by=[group]).join(q, group).filter("rank <= quota").select(key)
    return df.join(chosen, key, "left_semi")


def shuffled(df: DataFrame, key: str, salt: str = SALT) -> DataFrame:
    """All rows in a seeded random order: sources are interleaved in proportion to their sizes."""
    return df.orderBy(T.uniform(F.col(key), salt), key)


def stochastic_round(x: Column, key: str, salt: str = SALT) -> Column:
    """Down or up, up with the probability of the fraction."""
    return (F.floor(x) + F.when(T.uniform(F.col(key), salt) < x - F.floor(x), 1).otherwise(0)).cast("long")


def replicate(df: DataFrame, n: Column) -> DataFrame:
    """Each row n times; none of those with 0."""
    return df.withColumn("__mr_n", F.explode(F.array_repeat(F.lit(1), n.cast("int")))).drop("__mr_n")
