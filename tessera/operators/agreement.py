"""Agreement between annotators: kappa, confusion, cross tables, majority vote, disagreements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kappa(df: DataFrame, a: str, b: str, weight: str | None = None) -> DataFrame:
    """(n, observed, expected, kappa) of two label columns over the rows that hold both; null where chance alone agrees fully.

    weight: a column that says how many rows a row stands for.

    One pass over the pairs' counts: the label table is small, the rows are only counted.
    """
    pairs = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg((F.sum(weight) if weight else F.count("*")).cast("double").alias("w"))
    margin = pairs.select(F.inline(F.array(
        F.struct(F.col("a").alias("x"), F.col("w").alias("r"), F.lit(0.0).alias("c"), F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0).alias("d")),
        F.struct(F.col("b").alias("x"), F.lit(0.0).alias("r"), F.col("w").alias("c"), F.lit(0.0).alias("d")),
    ))).groupBy("x").agg(F.sum("r").alias("r"), F.sum("c").alias("c"), F.sum("d").alias("d"))
    s = margin.agg(F.coalesce(F.sum("r"), F.lit(0.0)).alias("n"), F.sum("d").alias("d"), F.sum(F.col("r") * F.col("c")).alias("rc"))
    po, pe = F.try_divide(F.col("d"), "n"), F.try_divide("rc", F.col("n") * F.col("n"))
    return s.select(F.col("n").cast("long").alias("n"), po.alias("observed"), pe.alias("expected"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def confusion(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Long form: counts of (by..., a, b)."""
    return df.groupBy(*(by or []), a, b).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, a: str, b: str, labels: list[str]) -> DataFrame:
    """A row per label of a and a column per label of b, over a fixed list of labels; others are left out."""
    rows = df.filter(F.col(a).isin(labels) & F.col(b).isin(labels))
    found = rows.groupBy(a).agg(*(F.count_if(F.col(b) == x).alias(x) for x in labels))
    every = df.sparkSession.createDataFrame([(x,) for x in labels], f"{a} string")
    return every.join(found, a, "left").fillna(0)


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of both columns with margins, which are named All."""
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    name = lambda c: F.when(F.grouping(c) == 1, "All").otherwise(F.col(c)).alias(f"{c}_")
    return rows.cube(a, b).agg(F.count("*").alias("n"), name(a), name(b)).select(F.col(f"{a}_").alias(a), F.col(f"{b}_").alias(b), "n")


def disagreements(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows whose labels differ; a null differs from any label."""
    return df.filter(~F.col(a).eqNullSafe(F.col(b)))


def majority(votes: dict[str, Column]) -> tuple[Column, Column]:
    """(winner, dissenter) of three votes in order: ties go to the first; the dissenter is the first annotator who voted otherwise."""
    (na, a), (nb, b), (nc, c) = votes.items()
    win = F.when((a == b) | (a == c), a).when(b == c, b).otherwise(a)
    return win, F.when(a != win, na).when(b != win, nb).when(c != win, nc)


def with_total(counts: DataFrame, key: str) -> DataFrame:
    """Counts per key with a row Total of their sums; counts are all columns but key."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in counts.columns if c != key]
    return counts.select(key, *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts.columns if c != key)).unionByName(counts.agg(*sums).select(F.lit("Total").alias(key), "*"))
