import pytest
from pyspark.sql import functions as F

from tessera.operators import sampling


def papers(spark, parts=4):
    rows = [(f"k{i}", "ABC"[(i % 7) // 3], 2015 + i % 5) for i in range(600)] + [("n1", None, 2015), ("n2", "A", None)]
    return spark.createDataFrame(rows, "bibkey string, bucket string, year int").repartition(parts)


def reference(rows, quotas, seed):
    """The rule, in plain Python."""
    import hashlib

    out = []
    for b, q in quotas.items():
        own = [r for r in rows if r[1] == b]
        n, picked = min(q, len(own)), []
        for y in sorted({r[2] for r in own if r[2] is not None}):
            g = sorted((r for r in own if r[2] == y), key=lambda r: (hashlib.md5(f"{seed}:{r[0]}".encode()).hexdigest(), r[0]))
            picked += g[: max(1, round(n * len(g) / len(own)))]
        out += picked[:n]
    return sorted(r[0] for r in out)


@pytest.mark.parametrize("quotas", [{"A": 70, "B": 70, "C": 70}, {"A": 0, "B": 3, "C": 10_000}, {"A": 4, "D": 5}])
def test_stratified_follows_the_rule_for_any_partitioning(spark, quotas):
    df = papers(spark)
    want = reference([tuple(r) for r in df.collect()], quotas, 42)
    for parts in (1, 7):
        assert sorted(r[0] for r in sampling.stratified(papers(spark, parts), "bibkey", quotas, 42).collect()) == want


def test_empty_sample(spark):
    assert sampling.stratified(papers(spark).limit(0), "bibkey", {"A": 5}, 1).count() == 0


def test_gold_and_pool_are_disjoint(spark):
    got = sampling.gold_and_pool(papers(spark), "bibkey", {"A": 20, "B": 20, "C": 20}, {"A": 50, "B": 50, "C": 50})
    assert got.count() == got.select("bibkey").distinct().count()
    sizes = {(r["bucket"], r["split"]): r["count"] for r in got.groupBy("bucket", "split").count().collect()}
    assert all(sizes[b, "val"] == round(0.15 * (sizes[b, "val"] + sizes[b, "train"])) for b in "ABC")


@pytest.mark.parametrize(("n", "sizes"), [(100, (69, 15, 16)), (0, (0, 0, 0)), (1, (0, 0, 1)), (7, (4, 1, 2))])
def test_split_sizes(n, sizes):
    assert sampling.split_sizes(n) == sizes


def test_three_way_is_stratified_and_complete(spark):
    df = spark.createDataFrame([(i, i % 10 // 7) for i in range(200)] + [(1000, None)], "row_id int, label int")
    got = sampling.three_way(df, "row_id", "label")
    assert got.count() == 201 and got.select("row_id").distinct().count() == 201
    totals = {r["split"]: r["count"] for r in got.groupBy("split").count().collect()}
    assert (totals["train"], totals["val"], totals["test"]) == sampling.split_sizes(201)


def test_keep_latest_ties_nulls_and_repeats(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", None, "q"), ("b", None, "q"), (None, 5, "n")]
    got = sampling.keep_latest(spark.createDataFrame(rows, "k string, t int, v string"), "k", "t")
    assert sorted((r["k"], r["t"], r["v"]) for r in got.collect()) == [("a", 2, "z"), ("b", None, "q")]


def test_without_keeps_null_keys(spark):
    a = spark.createDataFrame([("x",), (None,), ("y",)], "k string")
    b = spark.createDataFrame([("x",), (None,)], "k string")
    assert sorted(str(r[0]) for r in sampling.without(a, b, "k").collect()) == ["None", "y"]


def test_ranked_equals_one_sort(spark):
    df = spark.createDataFrame([(i, "g" if i % 3 else None) for i in range(500)], "i int, g string").withColumn("d", F.md5(F.col("i").cast("string")))
    got = sampling.ranked(df, ["g"], "d", "i").collect()
    for g in ("g", None):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: r["d"])
        assert [r["__rn"] for r in own] == list(range(1, len(own) + 1))
