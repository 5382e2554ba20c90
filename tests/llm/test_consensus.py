import random
from datetime import datetime

import numpy as np

from tessera.llm import consensus

S = "bibkey string, t timestamp_ntz, a string, b string, c string, extra string"


def frame(spark, rows):
    return spark.createDataFrame([(k, datetime(2020, 1, t) if t else None, a, b, c, "x") for k, t, a, b, c in rows], S)


def votes(spark, rows, more=()):
    return consensus.votes([(frame(spark, rows), "t", {x: x for x in "abc"}), (frame(spark, more), "t", {"a": "a", "d": "b"})], "bibkey")


def test_one_vote_each(spark):
    rows = [("x", 1, "Positive", "Label.NEGATIVE", "UNSURE"), ("x", 2, "negative\t", None, " unsure"), ("y", None, None, "??", None), (None, 1, "POSITIVE", "POSITIVE", None), ("z", 1, "POSITIVE", None, None), ("z", 1, "NEGATIVE", None, None)]
    got = {r["bibkey"]: tuple(r)[1:] for r in votes(spark, rows, [("x", 3, "POSITIVE", "NEGATIVE", None)]).collect()}
    assert got == {"x": (True, False, None, False), "y": (None,) * 4, "z": (True, None, None, None)}


def test_recovers_truth_and_reliability(spark):
    rng = random.Random(0)
    rows, truth = [], {}
    for i in range(3000):
        z = truth[f"k{i}"] = rng.random() < 0.55
        vote = lambda p, q: ("POSITIVE" if (rng.random() < (p if z else 1 - q)) else "NEGATIVE") if rng.random() < 0.9 else None  # noqa: E731, B023
        rows.append((f"k{i}", 1, vote(0.95, 0.95), vote(0.75, 0.75), vote(0.85, 0.45)))
    v = votes(spark, rows)
    got = consensus.consensus(v, "bibkey").collect()
    right = np.mean([(r["consensus"] == "POSITIVE") == truth[r["bibkey"]] for r in got])
    plain = np.mean([(sum(x == "POSITIVE" for x in r[2:]) * 2 > sum(x is not None for x in r[2:])) == truth[r[0]] for r in rows])
    assert right > plain and right > 0.92
    assert all(r["consensus"] in ("POSITIVE", "NEGATIVE") and 0 <= r["agreement"] <= 1 for r in got)
    by = {r["annotator"]: r for r in consensus.annotators(v, "bibkey").collect()}
    assert by["a"]["reliability"] > by["b"]["reliability"] > by["c"]["reliability"] > 0.5
    assert by["c"]["ability_negative"] < 0.3 and by["d"]["n_votes"] == 0 and by["d"]["reliability"] is None


def test_empty_and_single_votes(spark):
    assert consensus.consensus(votes(spark, []), "bibkey").count() == 0
    assert [r["n_votes"] for r in consensus.annotators(votes(spark, []), "bibkey").collect()] == [0] * 4
    got = consensus.consensus(votes(spark, [("x", 1, "POSITIVE", None, None), ("y", 1, None, None, None)]), "bibkey").collect()
    assert [(r["bibkey"], r["n_votes"], r["agreement"], r["kappa"], r["disputed"]) for r in got] == [("x", 1, 1.0, None, False)]


def test_annotators_follow_from_the_posteriors(spark):
    """Reliability and kappa, item by item."""
    import pytest

    rng = random.Random(4)
    rows = [(f"k{i}", 1, *(rng.choice(["POSITIVE", "NEGATIVE", None]) if rng.random() < 0.4 else ("POSITIVE" if i % 3 else "NEGATIVE") for _ in "abc")) for i in range(200)]
    v = votes(spark, rows)
    post = {r["bibkey"]: r["posterior"] for r in consensus.consensus(v, "bibkey").collect()}
    given = [r.asDict() for r in v.collect()]
    for r in consensus.annotators(v, "bibkey").collect():
        own = [(g[r["annotator"]], post[g["bibkey"]]) for g in given if g[r["annotator"]] is not None]
        if not own:
            assert r["n_votes"] == 0
            continue
        n, p = len(own), sum(x for x, _ in own)
        right, truly = sum(q if x else 1 - q for x, q in own), sum(q for _, q in own)
        chance = (p * truly + (n - p) * (n - truly)) / n**2
        assert (r["n_votes"], r["reliability"], r["kappa"]) == (n, pytest.approx(right / n), pytest.approx((right / n - chance) / (1 - chance)))
