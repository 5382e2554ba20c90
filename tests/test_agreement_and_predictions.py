import itertools
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import agreement, predictions

L = ["POSITIVE", "NEGATIVE", "UNSURE"]


def test_majority_of_all_27_triples(spark):
    df = spark.createDataFrame(list(itertools.product(L, L, L)), "g string, d string, m string")
    win, other = agreement.majority({"G": F.col("g"), "D": F.col("d"), "M": F.col("m")})
    for r in df.select("g", "d", "m", win.alias("w"), other.alias("o")).collect():
        votes = [r["g"], r["d"], r["m"]]
        w = Counter(votes).most_common(1)[0][0]
        assert r["w"] == w and r["o"] == next((n for n, v in zip("GDM", votes) if v != w), None)


def test_kappa(spark):
    rows = [("A", "A")] * 20 + [("A", "B")] * 5 + [("B", "A")] * 10 + [("B", "B")] * 15 + [(None, "A")]
    r = agreement.kappa(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()
    assert (r["n"], round(r["kappa"], 6)) == (50, 0.4)
    assert agreement.kappa(spark.createDataFrame([("A", "A")] * 3, "a string, b string"), "a", "b").first()["kappa"] is None
    assert agreement.kappa(spark.createDataFrame([], "a string, b string"), "a", "b").first()["n"] == 0
    r = agreement.kappa(spark.createDataFrame([("A", "B"), ("C", "B")], "a string, b string"), "a", "b").first()
    assert r["kappa"] == 0


def test_confusion_matrix_crosstab_and_totals(spark):
    df = spark.createDataFrame([("A", "A"), ("A", "C"), ("B", "A"), (None, "A")], "a string, b string")
    assert sorted(map(tuple, agreement.confusion_matrix(df, "a", "b", ["A", "B"]).collect())) == [("A", 1, 0), ("B", 1, 0)]
    cells = {(r["a"], r["b"]): r["n"] for r in agreement.crosstab(df, "a", "b").collect()}
    assert cells["All", "All"] == 3 and cells["A", "All"] == 2 and cells["All", "A"] == 2
    counts = spark.createDataFrame([("A", 1, None), ("B", 2, 3)], "bucket string, x int, y int")
    assert sorted(map(tuple, agreement.with_total(counts, "bucket").collect())) == [("A", 1, 0), ("B", 2, 3), ("Total", 3, 3)]
    assert agreement.disagreements(df, "a", "b").count() == 3


def test_softmax_and_ties(spark):
    df = spark.createDataFrame([("t", 1, 0.0, 0.0), ("big", 1, 1000.0, -1000.0), ("p", 0, -1.0, 1.0)], "bibkey string, label int, l0 double, l1 double")
    got = {r["bibkey"]: r for r in predictions.predict(df, ["l0", "l1"], ["bibkey", "label", "bucket"]).collect()}
    assert got["t"]["predicted"] == 0 and got["t"]["confidence"] == 0.5
    assert got["big"]["confidence"] == 1.0 and got["big"]["prob_positive"] == 0.0
    assert math.isclose(got["p"]["prob_positive"], 1 / (1 + math.exp(-2)))


def test_metrics_and_degenerate_strata(spark):
    rows = [("a", 1, 1), ("a", 1, 0), ("a", 0, 1), ("a", 0, 0), ("b", 0, 0)]
    got = {r["bucket"]: r for r in predictions.metrics(spark.createDataFrame(rows, "bucket string, label int, predicted int"), ["bucket"]).collect()}
    assert (got["a"]["accuracy"], got["a"]["precision"], got["a"]["recall"], got["a"]["f1"]) == (0.5, 0.5, 0.5, 0.5)
    assert (got["b"]["accuracy"], got["b"]["precision"], got["b"]["f1"]) == (1.0, 0.0, 0.0)


def test_class_weights_and_loss(spark):
    df = spark.createDataFrame([(0, 0.2)] * 3 + [(1, 0.9)] + [(None, 0.5)], "label int, prob_positive double")
    w = {r["label"]: r["weight"] for r in predictions.class_weights(df).collect()}
    assert w[0] == pytest.approx(0.5 * 4 / 6 + 0.5) and w[1] == pytest.approx(0.5 * 4 / 2 + 0.5)
    loss = predictions.weighted_cross_entropy(df, predictions.class_weights(df)).first()["loss"]
    want = (3 * w[0] * -math.log(0.8) + w[1] * -math.log(0.9)) / (3 * w[0] + w[1])
    assert loss == pytest.approx(want)


def test_uncertain_is_sorted(spark):
    df = spark.createDataFrame([("a", 0.69), ("b", 0.5), ("c", 0.9), ("d", 0.5)], "bibkey string, confidence double")
    assert [r["bibkey"] for r in predictions.uncertain(df).collect()] == ["b", "d", "a"]
