"""Problem 3: a sample that follows target proportions per category.

Method: systematic unequal-probability sampling. Within categories sorted by name, papers stand in random (hash) order;
inclusion probabilities are prefix-summed across partitions, and from one random start every crossing of an integer
selects a paper. Floors are repaired afterwards. The prefix sums come in two levels: counts per category and hash bin
(bins are sized so that each holds few rows), then ranks inside a bin, so that no category is sorted in one task.

Keys with a null category, or one that isn't in the targets, are outside the pool. A key met several times counts once,
with its latest row (ties: the smaller category). Null shares and floors count as 0. An empty pool gives an empty sample
and a report in which every target with a share or floor falls short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize, small

#: Rows in a hash bin, about; what one task sorts.
BIN_ROWS = 20_000
#: Fixed value: hashes below this are kept as exact integers in a double.
SPAN = 2**40


def pool(df: DataFrame, key: str, cell: list[str], targets: DataFrame, latest: str | None) -> DataFrame:
    """Distinct keys with their category, as far as it stands in targets."""
    order = F.col(latest) if latest else F.lit(0)
    rows = df.filter(F.col(key).isNotNull()).select(key, *cell, order.alias("__t"))
    cells = targets.select(*cell).distinct()
    rows = rows.join(F.broadcast(cells) if small(cells) else cells, cell)
    return rows.groupBy(key).agg(F.max(F.struct("__t", *cell)).alias("c")).select(key, *(F.col(f"c.{c}").alias(c) for c in cell))


def _uniform(seed: int, key: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string")), F.lit(SPAN))


def plan(papers: DataFrame, cell: list[str], targets: DataFrame, fraction: float) -> DataFrame:
    """Per target: available, size (share of the sample, not rounded), floor, quota (what it can get of both), start (quotas before it).

    Surplus probability that some categories cannot use goes to no other one: the report shows it as a shortfall.
    """
    have = papers.groupBy(*cell).agg(F.count("*").alias("available"))
    t = targets.groupBy(*cell).agg(F.coalesce(F.sum("target_share"), F.lit(0.0)).alias("share"), F.coalesce(F.max("min_rows"), F.lit(0)).alias("floor"))
    one = papers.agg((F.count("*") * F.lit(fraction)).alias("wanted"))
    out = t.join(have, cell, "left").fillna(0, ["available"]).crossJoin(F.broadcast(one))  # one is a single row
    out = out.withColumn("size", F.col("share") * F.col("wanted")).withColumn("quota", F.least(F.col("size"), F.col("available").cast("double")))
    # a window over the categories of the target table, not over papers
    return out.withColumn("start", F.coalesce(F.sum("quota").over(W.orderBy(*cell).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))


def sample(df: DataFrame, key: str, cell: list[str], targets: DataFrame, fraction: float = 0.2, seed: int = 42, latest: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(sample, report). sample: key and category. report: a row per target with

    available, size, floor, selected, and short: the sample holds fewer than size, or than floor, and there are no more.
    targets has the category columns, target_share and min_rows; the sample is ``fraction`` of the pool.
    """
    papers = materialize(pool(df, key, cell, targets, latest).withColumn("__u", _uniform(seed, key)), "pool")
    cells = materialize(plan(papers, cell, targets, fraction), "cells")
    bins = max(1, papers.count() // BIN_ROWS)
    binned = papers.withColumn("__b", F.floor(F.col("__u") / F.lit(SPAN / bins)).cast("int"))
    counts = binned.groupBy(*cell, "__b").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(W.partitionBy(*cell).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    ranked = binned.withColumn("__r", F.row_number().over(W.partitionBy(*cell, "__b").orderBy("__u", key)))
    # the prefix sum of a paper: quotas of the categories before, and its rank's part of its own category's quota
    few = small(cells)
    ranked = ranked.join(before, [*cell, "__b"]).join(F.broadcast(cells) if few else cells, cell).withColumn("__rank", F.col("__before") + F.col("__r"))
    upto = lambda rank: F.floor(F.col("start") + F.col("quota") * (rank / F.col("available")) - F.lit(_start(seed)))
    hit = (upto(F.col("__rank")) > upto(F.col("__rank") - 1)).cast("int")
    marked = materialize(ranked.select(key, *cell, "__rank", hit.alias("hit")), "ranked")
    got = marked.groupBy(*cell).agg(F.sum("hit").alias("got"), F.collect_list(F.when((F.col("hit") == 0) & (F.col("__rank") <= 2 * F.lit(_most_floor(targets))), F.col("__rank").cast("long"))).alias("spare"))
    # repair: a category under its floor takes its first papers that the crossings left out
    lack = F.greatest(F.lit(0), F.least("floor", "available") - F.coalesce("got", F.lit(0)))
    fixed = materialize(cells.join(got, cell, "left").withColumn("lack", lack).withColumn("extra", F.slice(F.array_sort(F.coalesce("spare", F.array().cast("array<bigint>"))), F.lit(1), F.col("lack").cast("int"))), "repaired")
    extra = fixed.select(*cell, F.explode("extra").alias("__rank"))
    out = marked.join(F.broadcast(extra.withColumn("add", F.lit(1))) if few else extra.withColumn("add", F.lit(1)), [*cell, "__rank"], "left")
    chosen = out.filter((F.col("hit") == 1) | (F.col("add") == 1)).select(key, *cell)
    under = lambda c: (F.col(c) < F.col("size")) | (F.col(c) < F.col("floor"))
    report = fixed.select(*cell, "available", "size", "floor", (F.coalesce("got", F.lit(0)) + F.size("extra")).alias("selected"))
    report = report.withColumn("short", under("selected") & under("available"))
    return chosen, report


def _start(seed: int) -> float:
    """The one random start of the systematic sample, in [0, 1)."""
    return (seed * 2654435761 % 2**32) / 2**32


def _most_floor(targets: DataFrame) -> int:
    return int(targets.agg(F.coalesce(F.max("min_rows"), F.lit(0))).first()[0])
