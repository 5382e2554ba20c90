"""Reproducible samples and splits. Members are chosen by the order of md5(seed:key), so any engine draws the same."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import bounded, materialize


def draw(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def keep_latest(df: DataFrame, key: str, time: str) -> DataFrame:
    """One row per key, the latest (ties: the larger in the other columns, in order); by aggregation, so hot keys combine before the shuffle."""
    rest = [c for c in df.columns if c not in (key, time)]
    flipped = F.struct(F.col(time), *(F.col(c) for c in rest))
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(flipped).alias("__r")).select(key, *(F.col(f"__r.{c}").alias(c) for c in [time, *rest]))


def stratified(df: DataFrame, key: str, quotas: dict[str, int], seed: int = 42, bucket: str = "bucket", year: str = "year") -> DataFrame:
    """Per bucket up to its quota, in proportion to the years.

    Each year gets max(1, round half even of its part); then the first rows in year order are kept up to the quota, so
    latest years give way when the floors add up to more, and nothing fills up when roundings add up to less.
    """
    n = F.create_map(*(F.lit(x) for b, q in quotas.items() for x in (b, q)))
    rows = df.filter(F.col(bucket).isin(*quotas) & F.col(year).isNotNull())
    sizes = rows.groupBy(bucket, year).agg(F.count("*").alias("__g"))
    whole = df.filter(F.col(bucket).isin(*quotas)).groupBy(bucket).agg(F.count("*").alias("__b"))
    actual = F.least(F.element_at(n, F.col(bucket)).cast("long"), F.col("__b"))
    take = F.greatest(F.lit(1), F.bround(actual * F.col("__g") / F.col("__b"))).cast("long")
    # a table of buckets and years, not of rows; the running sum says how far the earlier years fill the quota
    plan = sizes.join(whole, bucket).select(bucket, year, actual.alias("__n"), F.least(take, F.col("__g")).alias("__k"))
    before = F.coalesce(F.sum("__k").over(W.partitionBy(bucket).orderBy(year).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    plan = plan.withColumn("__k", F.greatest(F.lit(0), F.least(F.col("__k"), F.col("__n") - before))).drop("__n")
    drawn = rows.join(bounded(plan), [bucket, year]).withColumn("__d", draw(key, seed))
    return ranked(drawn, [bucket, year], "__d", key, F.col("__k")).select(*df.columns)


def ranked(df: DataFrame, groups: list[str], digest: str, key: str, limit: Column | None = None) -> DataFrame:
    """df with __rn, the rank in its group by digest (a hex text) and key; with a limit, only the rows up to it.

    Ranks come in two levels, counts per group and first three hex digits, then ranks inside such a bin, so no task
    sorts a whole group, and bins beyond the limit are left out before the sort.
    """
    binned = df.withColumn("__bin", F.substring(digest, 1, 3))
    counts = binned.groupBy(*groups, "__bin").agg(F.count("*").alias("__n"))
    w = W.partitionBy(*groups).orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)  # at most 4,096 rows a group
    same = [*groups, "__bin"]
    before = counts.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(same)), F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    rows = binned.join(before, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(same)]).select(*binned.columns, "__before")
    if limit is not None:
        rows = rows.filter(F.col("__before") < limit)
    rows = rows.withColumn("__rn", F.col("__before") + F.row_number().over(W.partitionBy(*groups, "__bin").orderBy(digest, key)))
    if limit is not None:
        rows = rows.filter(F.col("__rn") <= limit)
    return rows.drop("__bin", "__before")


def fraction(df: DataFrame, key: str, part: float, seed: int, bucket: str = "bucket") -> DataFrame:
    """Per bucket the round-half-even of part of its rows."""
    sizes = df.groupBy(bucket).agg(F.bround(F.count("*") * F.lit(part)).cast("long").alias("__k"))
    drawn = df.join(bounded(sizes), bucket).withColumn("__d", draw(key, seed))
    return ranked(drawn, [bucket], "__d", key, F.col("__k")).select(*df.columns)


def cap(df: DataFrame, key: str, most: int, seed: int = 42) -> DataFrame:
    """At most so many rows, drawn by the order of md5; each task sorts out its own first rows, so only these travel."""
    return df.withColumn("__d", draw(key, seed)).orderBy("__d", key).limit(most).drop("__d")


def enumerated(df: DataFrame, *order: str, name: str = "idx") -> DataFrame:
    """df with the place of each row, from 0, in an order (nulls first; order should tell all rows apart).

    Sorted by range over the cluster; rows count within their partition, and partitions after the rows of those before.
    """
    pid = F.spark_partition_id()
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", pid).withColumn("__i", F.monotonically_increasing_id() - F.shiftleft(pid.cast("bigint"), 33))
    parts = materialize(parts, "enumerated")
    before = parts.groupBy("__p").agg(F.count("*").alias("__n"))
    # a window over the partitions, not over the rows
    before = before.select("__p", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return parts.join(bounded(before), "__p").select(*df.columns, (F.col("__before") + F.col("__i")).alias(name))


def without(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in other; null keys stay."""
    return df.join(other.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def gold_and_pool(df: DataFrame, key: str, gold: dict[str, int], pool: dict[str, int], part: float = 0.15) -> DataFrame:
    """df's sampled rows with split: gold (seed 42), and of a second sample of the rest (seed 43) val (part of each bucket) and train."""
    # samples are small, and drawn from again: written once rather than planned anew for each use
    g = materialize(stratified(df, key, gold, 42), "gold")
    p = materialize(stratified(without(df, g, key), key, pool, 43), "pool")
    v = fraction(p, key, part, 43)
    tagged = lambda x, name: x.withColumn("split", F.lit(name))
    return tagged(g, "gold").unionByName(tagged(v, "val")).unionByName(tagged(without(p, v, key), "train"))


def split_sizes(n: int, train: float = 0.70, val: float = 0.15) -> tuple[int, int, int]:
    """Rows of train, val and test of n: what is held out is rounded up, as is test of that."""
    held = math.ceil((1.0 - train) * n)
    test = math.ceil((1.0 - val / (1.0 - train)) * held)
    return n - held, held - test, test


def three_way(df: DataFrame, key: str, label: str, seed: int = 42) -> DataFrame:
    """df with split (train, val, test), stratified by label: sizes by split_sizes, shared out by largest remainder."""
    counts = sorted((tuple(r) for r in df.groupBy(label).count().collect()), key=lambda r: str(r[0]))  # one row per label
    n = sum(c for _, c in counts)
    train_n, _, test_n = split_sizes(n)
    held_n = n - train_n
    held = _remainders([c for _, c in counts], held_n)
    test = _remainders(held, test_n)
    plan = df.sparkSession.createDataFrame([(x, h, t) for (x, _), h, t in zip(counts, held, test)], f"__label {df.schema[label].dataType.simpleString()}, __held long, __test long")
    drawn = ranked(df.withColumn("__d", draw(key, seed)), [label], "__d", key)
    rows = drawn.join(F.broadcast(plan), F.col(label).eqNullSafe(F.col("__label")))
    split = F.when(F.col("__rn") <= F.col("__test"), "test").when(F.col("__rn") <= F.col("__held"), "val").otherwise("train")
    return rows.withColumn("split", split).drop("__label", "__held", "__test", "__rn", "__d")


def _remainders(sizes: list[int], total: int) -> list[int]:
    """total shared out in proportion to sizes, the largest remainders rounded up (ties: the earlier)."""
    n = sum(sizes)
    if not n:
        return [0 for _ in sizes]
    exact = [s * total / n for s in sizes]
    out = [math.floor(x) for x in exact]
    for i in sorted(range(len(sizes)), key=lambda i: (out[i] - exact[i], i))[: total - sum(out)]:
        out[i] += 1
    return out
