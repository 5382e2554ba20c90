import random

import pytest
from pyspark.sql import functions as F

from tessera import session
from tessera.operators import corpus, sampling


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("t") / "t")
    spark.range(1000).withColumn("k", F.col("id") % 7).write.parquet(path)
    return spark.read.parquet(path)


def jobs(spark, work):
    """How many jobs work() runs."""
    before = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    work()
    return len(set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before)


def test_spread_runs_nothing(spark, table):
    joined = table.join(table.groupBy("k").count(), "k")
    for df in (table.filter("k > 1"), joined, joined.select("id").distinct()):
        assert jobs(spark, lambda df=df: session.spread(df, "id")) == 0
        assert session.spread(df, "id").count() == df.count()
    assert session.leaf_bytes(joined) > 0 and session.leaf_bytes(spark.createDataFrame([(1,)], "a int")) == 0


def test_join_hot_is_the_join(spark, monkeypatch):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.5 else rng.choice([None, *(f"k{i}" for i in range(300))]), i) for i in range(3000)]
    left = spark.createDataFrame(rows, "k string, i int")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), (None, 4), ("k2", 5)], "r string, v int")
    want = sorted(map(str, left.join(right, F.col("k") == F.col("r"), "left").collect()))
    assert sorted(map(str, session.join_hot(left, right, "k", "r").collect())) == want
    monkeypatch.setattr(session, "HOT_BYTES", 0)
    assert sorted(map(str, session.join_hot(left, right, "k", "r").collect())) == want
    assert session.join_hot(left.limit(0), right, "k", "r").count() == 0 and session.join_hot(left, right.limit(0), "k", "r").count() == 3000


def test_bounded_keeps_rows_and_types(spark, table):
    small = table.groupBy("k").agg(F.count("*").alias("n"), F.lit(None).cast("string").alias("s"))
    got = session.bounded(small)
    assert got.schema.simpleString() == small.schema.simpleString() and sorted(map(tuple, got.collect())) == sorted(map(tuple, small.collect()))
    assert session.bounded(table, 10) is table


def test_enumerated_over_any_partitioning(spark):
    rows = [(i * 37 % 500, "x") for i in range(500)] + [(None, "n")]
    for parts in (1, 6):
        got = sampling.enumerated(spark.createDataFrame(rows, "id int, v string").repartition(parts), "id").collect()
        assert [r["id"] for r in sorted(got, key=lambda r: r["idx"])] == [None, *range(500)] and sorted(r["idx"] for r in got) == list(range(501))
    assert sampling.enumerated(spark.createDataFrame([], "id int"), "id").count() == 0


def test_cap(spark):
    df = spark.range(100).withColumn("id", F.col("id").cast("string"))
    one, two = (sorted(r["id"] for r in sampling.cap(df.repartition(n), "id", 10, 1).collect()) for n in (1, 5))
    assert one == two and len(one) == 10 and sampling.cap(df, "id", 1000).count() == 100


def test_author_objects_become_names(spark):
    flat = "authors array<struct<first:string,last:string>>"
    nested = "authors array<struct<name:struct<first:string,last:string>,affiliation:string>>"
    assert corpus.project(spark.createDataFrame([([("Ada", "B"), (None, "C"), ("D", None)],), (None,), ([],)], flat)).select("authors").collect() == [(["Ada B", "C", "D"],), (None,), ([],)]
    assert corpus.project(spark.createDataFrame([([(("Ada", "B"), "x")],)], nested)).first()["authors"] == ["Ada B"]
    assert corpus.project(spark.createDataFrame([(["Ada B"],)], "authors array<string>")).first()["authors"] == ["Ada B"]
