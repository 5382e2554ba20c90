import random

import numpy as np
import pytest

from tessera.llm import canonical
from tessera.llm.canonical import Tree, distances, encode, map_values

REF = [("t", "sentiment_analysis", ["opinion_mining"]), ("t", "stance_detection", None), ("t", "hate_speech_detection", []), ("d", "news", ["journalism"]), ("d", "social_media", ["microblogs"]), ("d", "legal", ["law"])]
CASES = {
    ("t", "Sentiment Analysis"): "sentiment_analysis", ("t", "sentiment_anaylsis"): "sentiment_analysis", ("t", "opinion mining"): "sentiment_analysis", ("t", "analysis of sentiment"): "sentiment_analysis",
    ("t", "detection (stance)"): "stance_detection", ("t", "StanceDetection"): "stance_detection", ("t", "stance_detect"): "stance_detection", ("t", "probably hate speech detection"): "hate_speech_detection",
    ("t", "ｓｔａｎｃｅ＿ｄｅｔｅｃｔｉｏｎ"): "stance_detection", ("t", "stáncé detection"): "stance_detection", ("t", "stance_detect10n"): "stance_detection", ("t", "machine translation"): "UNMATCHED",
    ("d", "nwes"): "news", ("d", "News texts"): "news", ("d", "legal texts"): "legal", ("d", "Social Media texts"): "social_media", ("d", "laws"): "legal", ("d", "origami"): "UNMATCHED", ("d", "n/a"): "UNMATCHED", ("d", "?"): "UNMATCHED", ("d", "stance_detection"): "UNMATCHED", ("d", "中文"): "UNMATCHED",
}


def ref(spark, rows=None):
    return spark.createDataFrame(REF if rows is None else rows, "field string, canonical string, also_known_as array<string>")


def table(spark, rows):
    return spark.createDataFrame(rows, "rec_id long, t string, d string, field string, value string, n long")


def brute(a, b):
    """Unrestricted Damerau-Levenshtein, by its definition as shortest path (small texts only)."""
    from functools import cache

    @cache
    def go(i, j):
        if not i or not j:
            return i + j
        best = min(go(i - 1, j) + 1, go(i, j - 1) + 1, go(i - 1, j - 1) + (a[i - 1] != b[j - 1]))
        for k in range(1, i):
            for m in range(1, j):
                if a[k - 1] == b[j - 1] and a[i - 1] == b[m - 1]:
                    best = min(best, go(k - 1, m - 1) + (i - k - 1) + 1 + (j - m - 1))
        return best

    return go(len(a), len(b))


def test_distance_is_the_metric():
    rng = random.Random(0)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    codes, lengths = encode(words)
    for w in words[:30]:
        got = distances(codes, lengths, np.frombuffer(w.encode("utf-32-le"), np.uint32))
        assert got.tolist() == [brute(x, w) for x in words]
    d = np.array([distances(codes, lengths, np.frombuffer(w.encode("utf-32-le"), np.uint32)) for w in words])
    assert (d == d.T).all() and (d[:, None, :] <= d[:, :, None] + d[None, :, :]).all()


def test_tree_finds_every_entry_within_the_threshold():
    rng = random.Random(1)
    entries = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(2, 9))) for _ in range(200)})
    queries = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(40)]
    most = np.array([rng.randint(0, 3) for _ in queries])
    tree = Tree(entries)
    got = {(int(i), tree.entries[at]) for nodes, hits, _ in tree.search(queries, most) for at, i in zip(nodes, hits)}
    codes, lengths = encode(queries)
    want = {(int(i), e) for e in entries for i in np.flatnonzero(distances(codes, lengths, np.frombuffer(e.encode("utf-32-le"), np.uint32)) <= most)}
    assert got == want and tree.compared < len(queries) * len(entries)


@pytest.mark.parametrize("shard", [canonical.SHARD, 2])
def test_values(spark, shard):
    rows = [(i, v if f == "t" else None, v if f == "d" else None, "x", "y", 3) for i, (f, v) in enumerate(CASES)]
    got = {r["rec_id"]: r["canonical"] for r in map_values(table(spark, rows), "rec_id", ["t", "d"], ref(spark), shard=shard).collect()}
    assert {k: got[i] for i, k in enumerate(CASES)} == CASES


def test_exact_null_blank_repeated_and_long(spark):
    rows = [(1, "stance_detection", None, None, None, None), (2, " ", "", None, None, None), (3, "stance detecton", "news", None, None, None), (3, "stance detecton", None, None, None, None), (4, "x" * 100_000, " ", None, None, None), (None, "opinion_mining", None, None, None, None)]
    got = sorted((str(r["rec_id"]), r["field"], r["canonical"]) for r in map_values(table(spark, rows), "rec_id", ["t", "d"], ref(spark)).collect())
    assert got == [("3", "t", "stance_detection"), ("3", "t", "stance_detection"), ("4", "t", "UNMATCHED"), ("None", "t", "sentiment_analysis")]


def test_empty_tables(spark):
    assert map_values(table(spark, []), "rec_id", ["t", "d"], ref(spark)).count() == 0
    got = map_values(table(spark, [(1, "a", None, None, None, None)]), "rec_id", ["t"], ref(spark, [])).collect()
    assert [r["canonical"] for r in got] == ["UNMATCHED"]
    bad = ref(spark, [(None, "a", None), ("t", None, ["abc"]), ("t", "abcdef", [None])])
    assert [r["canonical"] for r in map_values(table(spark, [(1, "abcdfe", None, None, None, None)]), "rec_id", ["t"], bad).collect()] == ["abcdef"]


def test_ties_go_to_the_smaller_entry(spark):
    got = map_values(table(spark, [(1, "aaaaax", None, None, None, None)]), "rec_id", ["t"], ref(spark, [("t", "aaaaac", None), ("t", "aaaaab", None)])).collect()
    assert got[0]["canonical"] == "aaaaab"


def test_hot_value(spark):
    rows = [(i, "stance detecton" if i % 3 else f"value{i}", None, None, None, None) for i in range(900)]
    got = map_values(table(spark, rows), "rec_id", ["t"], ref(spark))
    assert got.count() == 900 and got.filter("canonical = 'stance_detection'").count() == 600


def found(spark, values, entries, **how):
    df = spark.createDataFrame(list(enumerate(values)), "rec_id long, t string")
    return {values[r["rec_id"]]: (r["canonical"], r["score"]) for r in map_values(df, "rec_id", ["t"], ref(spark, [("t", e, None) for e in entries]), **how).collect()}


def test_long_entries(spark):
    entry = "x" + "abcdefghij" * 9
    assert found(spark, [entry.upper(), entry[:40] + "q" + entry[41:], "z" * 95], [entry, "short"]) == {entry.upper(): (entry, 0.0), entry[:40] + "q" + entry[41:]: (entry, 1.0), "z" * 95: ("UNMATCHED", None)}


def test_shards_and_one_tree_agree(spark):
    """Entries with a common beginning, and values near it, near either, and near none."""
    rng = random.Random(7)
    stems = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(5, 11))) for _ in range(8)]
    entries = sorted({s + "".join(rng.choice("klm") for _ in range(rng.randint(0, 3))) for s in stems for _ in range(4)} | {"abcdefghijk", "abcdefghijlm"})

    def slip(t):
        i = rng.randrange(len(t))
        return rng.choice([t[:i] + t[i + 1 :], t[:i] + "z" + t[i:], t[:i] + t[i + 1 : i + 2] + t[i : i + 1] + t[i + 2 :]])

    values = list({slip(slip(e)) if rng.random() < 0.6 else slip(e) for e in entries + stems for _ in range(6)} | {"abcdefgiy", "mainly " + entries[0]})
    one, many = found(spark, values, entries), found(spark, values, entries, shard=3)
    assert one == many and 20 < sum(c != "UNMATCHED" for c, _ in one.values())


def test_qualifiers_are_learned(spark):
    entries = ["harvest", "weather", "railway", "kitchen"]
    taught = [f"quite surely {e}" for e in entries[:3]] + [f"{e} matters" for e in entries[:3]]
    got = found(spark, [*taught, "quite surely kitchn", "kitchne matters", "odd queer kitchen"], entries)
    assert got["quite surely kitchn"] == ("kitchen", 1.1) and got["kitchne matters"] == ("kitchen", 1.1) and got["odd queer kitchen"][0] == "UNMATCHED"
    assert found(spark, ["quite surely kitchn"], entries)["quite surely kitchn"][0] == "UNMATCHED"
