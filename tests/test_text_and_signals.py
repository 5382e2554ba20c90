import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import signals
from tessera.functions.text import not_blank, strip
from tessera.operators import corpus

PHRASES = [
    "We introduce a new benchmark for sentiment analysis.", "an existing benchmark", "We present a framework for a corpus.", "Native language NLI", "NLI and native language identification",
    "language identification", "PAWS-X, AG's News, 20 Newsgroups", "Yelp and Amazon reviews", "state-of-the-art results on SST-2", "fine tuned on IMDb", "aspect-based\nsentiment", "contribution is\na dataset",
    "NLU and semantic similarity", "a new dataset", "Ünew dataset", "BENCHMARKING leaderboards", "", "dialog act and dialogue act",
]


def python_hits(text, patterns):
    return sum(1 for p in patterns if re.search(p, text, re.IGNORECASE))


def test_signals_agree_with_python(spark):
    df = spark.createDataFrame([(p,) for p in PHRASES], "t string").select("t", *(signals.hits(F.col("t"), p).alias(c) for c, p in signals.SIGNALS.items()))
    for r in df.collect():
        for c, p in signals.SIGNALS.items():
            assert r[c] == python_hits(r["t"], p), (r["t"], c)


def test_pattern_counts():
    assert [len(p) for p in signals.SIGNALS.values()] == [4, 2, 2, 5, 4, 31, 3, 24]


@pytest.mark.parametrize(
    ("title", "abstract", "bucket"),
    [
        ("x", "We introduce a dataset for hate speech.", "A"),
        ("x", "We introduce a dataset of recipes.", "B"),
        ("x", "We introduce a dataset. We propose a model for hate speech.", "B"),
        ("x", "We test on GLUE.", "B"),
        ("x", "A leaderboard for stance detection.", "B"),
        ("x", "Stance detection.", "C"),
        ("x", "Work on NLU.", "C"),
        ("x", "", "C"),
    ],
)
def test_bucket(spark, title, abstract, bucket):
    assert corpus.score(spark.createDataFrame([(title, abstract)], "title string, abstract string")).first()["bucket"] == bucket


def test_blank_and_strip(spark):
    rows = [(x,) for x in (None, "", " \t\n", "  ", "\x1c", "a", " a ")]
    got = spark.createDataFrame(rows, "t string").select(not_blank("t").alias("b"), strip("t").alias("s")).collect()
    assert [r["b"] for r in got] == [False] * 5 + [True] * 2
    assert [r["s"] for r in got] == [None, "", "", "", "", "a", "a"]


def test_venues_years_and_nulls(spark):
    rows = [("a", 2013, ["ws", "coling"]), ("b", 2026, ["lilt", "cl"]), ("c", 2012, ["acl"]), ("d", 2020, ["ws"]), ("e", 2020, []), ("f", None, ["acl"]), ("g", 2020, None), ("h", 2020, [None, "acl"])]
    got = {r["id"]: r["venue_type"] for r in corpus.clean(spark.createDataFrame(rows, "id string, year int, venues array<string>")).collect()}
    assert got == {"a": "non_acl_venue", "b": "non_acl_journal", "h": "acl_venue"}
    assert corpus.clean(spark.createDataFrame([], "id string, year int, venues array<string>")).count() == 0


def test_enrich_fills_nulls_not_blanks_and_multiplies(spark):
    left = spark.createDataFrame([("1", None, 9), ("2", " ", 9), ("3", "own", 9), (None, None, 9)], "id string, abstract string, numcitedby int")
    right = spark.createDataFrame([("1", "f", 1), ("2", "f", 2), ("3", "f", 3), ("3", "g", 4), (None, "n", 5)], "acl_id string, abstract string, numcitedby int")
    got = sorted(map(tuple, corpus.enrich(left, right, "id", "acl_id", ["numcitedby"]).select("id", "abstract", "numcitedby").collect()), key=str)
    assert got == sorted([("1", "f", 1), ("2", " ", 2), ("3", "own", 3), ("3", "own", 4), (None, None, None)], key=str)


def test_projection_of_incomplete_records(spark):
    got = corpus.project(spark.createDataFrame([("1", "2020", True), ("2", "x", False)], "id string, year string, is_deleted boolean")).collect()
    assert [(r["id"], r["year"], r["venues"]) for r in got] == [("2", None, None)]
