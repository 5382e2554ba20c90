import random

import pytest

from tessera.llm import overlap
from tessera.llm.overlap import normalise, overlaps, same

RNG = random.Random(5)
WORDS = ["".join(RNG.choice("bdgklmnprst") + RNG.choice("aeiou") for _ in range(RNG.randint(2, 4))) for _ in range(400)]
SHARED = " ".join(RNG.choice(WORDS) for _ in range(12)).capitalize() + "."


def text(rng, n=5):
    return " ".join(" ".join(rng.choice(WORDS) for _ in range(rng.randint(7, 14))).capitalize() + "." for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, a, "b", "s", 1) for i, t, a in rows], "row_id long, title string, abstract string, content string, side string, rep int")


def pairs(spark, train, evaluation):
    return sorted(map(tuple, overlaps(frame(spark, train), frame(spark, evaluation)).collect()))


def changed(rng, t):
    w = t.split()
    for i in range(len(w)):
        if rng.random() < 0.04:
            w[i] = rng.choice(WORDS)
        elif rng.random() < 0.04 and len(w[i]) > 4:
            w[i] = w[i][:2] + w[i][3:]
    s = " ".join(w).split(". ")
    rng.shuffle(s) if rng.random() < 0.3 else None
    return rng.choice([str, str.upper, str.lower])(". ".join(s))


def test_agrees_with_brute_force(spark):
    rng = random.Random(3)
    train = [(i, text(rng, 1)[:50], SHARED + " " + text(rng)) for i in range(150)]
    evaluation = [(1000 + i, changed(rng, train[i][1]) if i % 4 else train[i][1], changed(rng, train[i][2])) for i in range(60)]
    evaluation += [(2000 + i, text(rng, 1)[:50], SHARED + " " + text(rng)) for i in range(40)] + [(3000 + i, train[i][1], text(rng)) for i in range(10)] + [(4000 + i, text(rng, 1)[:50], train[i][2]) for i in range(10)]
    n = lambda r: (r[0], normalise(r[1]), normalise(r[2]))
    brute = sorted((t[0], e[0]) for t in map(n, train) for e in map(n, evaluation) if same(t[1], t[2], e[1], e[2]))
    assert len(brute) >= 40
    assert pairs(spark, train, evaluation) == brute


def test_blank_abstracts_copies_and_nulls(spark):
    rng = random.Random(4)
    a = text(rng)
    train = [(1, "A Title: of Sorts", a), (2, "A Title: of Sorts", a), (3, "Another thing", None), (4, None, None), (5, "", ""), (None, "A Title: of Sorts", a), (6, "Long", a * 400)]
    evaluation = [(11, "a title of sorts", None), (12, "A TITLE OF SORTS!", a), (13, "another  Thing", "  "), (14, None, a), (15, None, None), (16, "A title of sort", None), (17, "Long", a * 400), (12_000, "A TITLE OF SORTS!", a)]
    assert pairs(spark, train, evaluation) == [(1, 11), (1, 12), (1, 12_000), (2, 11), (2, 12), (2, 12_000), (3, 13), (6, 17)]


def test_empty(spark):
    assert pairs(spark, [], []) == [] and pairs(spark, [(1, "a b", "c d")], []) == [] and pairs(spark, [], [(1, "a b", "c d")]) == []


def test_many_versions_of_one_paper(spark):
    rng = random.Random(6)
    base, title = text(rng, 6), "A paper about many versions of itself"
    train = [(i, title, base.replace(".", f" v{i}.", 1)) for i in range(12)]
    evaluation = [(100 + i, title, base.replace(".", f" w{i}.", 2)) for i in range(12)]
    assert len(pairs(spark, train, evaluation)) == 144


def test_many_papers_with_one_abstract(spark):
    rng = random.Random(7)
    abstract = text(rng, 6)
    titles = [text(rng, 1)[:40] for _ in range(60)]
    train = [(i, t, abstract) for i, t in enumerate(titles)]
    evaluation = [(100 + i, t[:9] + t[10:] if i % 2 else f"{t} (short paper)", abstract if i % 3 else abstract.replace(".", f" w{i}.", 1)) for i, t in enumerate(titles)]
    assert pairs(spark, train, evaluation) == [(i, 100 + i) for i in range(60)]


def listed(rows):
    import pandas as pd
    import pyarrow as pa

    out = pd.concat(b.to_pandas() for b in overlap._listed([pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["row_id", "side", "title", "abstract"]))]))
    return out[out["kind"] == overlap.RECORD], out[out["kind"] == overlap.SUFFIX], out[out["kind"] == overlap.PART]


def test_suffixes_hold_the_end_sign():
    of = lambda t, a: listed([(1, 0, t, a)])[1]
    assert of("one", "two")["n"].tolist()[:1] == [3] and of("", "two")["n"].tolist()[:1] == [2] and of("one", "").empty
    assert of("one two", "three").iloc[0]["k1"] != of("one", "two three").iloc[0]["k1"]


def test_records_of_two_words(spark):
    assert pairs(spark, [(1, "tides", "moon")], [(2, "tides", "moon"), (3, "tides moon", "")]) == [(1, 2)]


def test_hot_titles_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(overlap, "SALT_ROWS", 5)
    rng = random.Random(8)
    abstracts = [text(rng) for _ in range(30)]
    assert pairs(spark, [(i, "Introduction", a) for i, a in enumerate(abstracts)], [(100 + i, "Introduction", a + " More.") for i, a in enumerate(abstracts)]) == [(i, 100 + i) for i in range(30)]


def test_common_titles_need_a_shared_span(spark, monkeypatch):
    monkeypatch.setattr(overlap, "COMMON", 5)
    rng = random.Random(10)
    abstracts = [text(rng) for _ in range(40)]
    train = [(i, "Introduction" if i % 2 else "A title of its own", a) for i, a in enumerate(abstracts)]
    evaluation = [(100 + i, "INTRODUCTION" if i % 2 else "A title of it's own", a + " More.") for i, a in enumerate(abstracts[:30])] + [(200, "Introduction", "Short words")]
    assert pairs(spark, train + [(300, "Introdution", "Short words")], evaluation) == sorted([(i, 100 + i) for i in range(30)] + [(300, 200)])


def test_common_titles_without_a_shared_span(spark, monkeypatch):
    """Under a common title every third word has a slip, so that no three words in a row are the same on both sides."""
    monkeypatch.setattr(overlap, "COMMON", 5)
    monkeypatch.setattr(overlap, "BLOCK_ROWS", 7)
    rng = random.Random(13)
    words = ["".join(rng.choice("bdgklmnprst") + rng.choice("aeiou") for _ in range(7)) for _ in range(300)]
    abstracts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(40)]
    slip = lambda a: " ".join(w[:5] + "x" + w[6:] if i % 3 == 0 else w for i, w in enumerate(a.split()))
    train = [(i, "Introduction", a) for i, a in enumerate(abstracts)]
    evaluation = [(100 + i, "INTRODUCTION!" if i % 2 else "Introdution (v2)", slip(a)) for i, a in enumerate(abstracts[:30])]
    assert pairs(spark, train, evaluation) == [(i, 100 + i) for i in range(30)]


def test_pairs_of_two_lists_are_those_that_are_alike():
    rng = random.Random(14)
    first = [text(rng, 3).lower() for _ in range(25)] + ["a", "abc", "aaaaaaaa", "中文"]
    second = [changed(rng, t) for t in first[:25]] + [first[0] + " " + text(rng, 1), "a", "aaaa", "中文"]
    want = [(i, j) for i, a in enumerate(first) for j, b in enumerate(second) if overlap.alike([a], [b])[0]]
    assert [tuple(map(int, z)) for z in zip(*overlap.met(first, second))] == want and len(want) > 20


@pytest.mark.parametrize("n", [300, 4000])
def test_recall_under_one_template_abstract(spark, n):
    """Papers with one abstract but for their name, each with a twin whose title has two slips."""
    rng = random.Random(n)
    body = text(rng, 6)
    title = lambda i: f"{rng.choice(WORDS)} {WORDS[i % 400]} {WORDS[i // 400]} a resource of {rng.choice(WORDS)}{i} for {rng.choice(WORDS)}"
    titles = [title(i) for i in range(n)]

    def slips(t):
        for _ in range(2):
            i = rng.randrange(len(t))
            t = rng.choice([t[:i] + t[i + 1 :], t[:i] + "x" + t[i:], t[:i] + "q" + t[i + 1 :]])
        return t

    train, evaluation = [(i, t, body) for i, t in enumerate(titles)], [(n + i, slips(t), body) for i, t in enumerate(titles)]
    got = set(pairs(spark, train, evaluation))
    assert all((i, n + i) in got for i in range(n))


def test_near_titles_share_a_part():
    import numpy as np
    import pandas as pd

    rng = random.Random(9)
    keys = lambda v, titles: pd.DataFrame(overlap._parts(np.full(len(titles), v), np.arange(len(titles)), overlap.signs(titles), titles)).groupby("rep")["k1"].agg(set)
    first, second = [], []
    while len(first) < 3000:
        a = b = "".join(rng.choice("abc") for _ in range(rng.choice([1, 2, 5, 10, 11, 12, 13, 14, 20, 50])))
        for _ in range(2):
            i = rng.randint(0, len(b))
            b = rng.choice([b[:i] + "x" + b[i:], b[:i] + b[i + 1 :], b[:i] + b[i + 1 : i + 2] + b[i : i + 1] + b[i + 2 :], b[:i] + "y" + b[i + 1 :]])
        if overlap.distance(a, b, 2) <= overlap.edits(min(len(a), len(b))):
            first.append(a)
            second.append(b)
    for x, y in ((first, second), (second, first)):
        assert all(p & q for p, q in zip(keys(0, x), keys(1, y)))
    assert overlap.near_signs(overlap.signs(first), overlap.signs(second)).all()


def test_fingerprints_tell_words_and_parts_apart():
    import numpy as np

    texts = ["a b ab ba b", "ba", "中 a", "x" * 5000 + " " + "x" * 5001]
    words, h = " ".join(texts).split(" "), overlap.word_hashes(texts)
    assert len(h) == len(words) and len(set(h)) == len(set(words)) and all((h[i] == h[j]) == (words[i] == words[j]) for i in range(len(words)) for j in range(len(words)))
    part = lambda t: set(overlap._parts(np.zeros(1, int), np.zeros(1, int), np.zeros(1, int), [t])["k1"])
    assert len(part("abcdabcdabcdabcdabcd") & part("xxxxabcdabcdxxxxabcd")) == 3 and not part("abcdabcdabcdabcdabcd") & part("zabcdabcdabcdabcdabcd")


def test_signs_as_expression_and_array_agree(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh中文é") for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["a" * 20, "a" * 33, ""]
    x = overlap.signs(words)
    df = spark.createDataFrame([(i, j, int(x[i]), int(x[j])) for i in range(len(words)) for j in range(len(words))], "i int, j int, x long, y long")
    got = {(r["i"], r["j"]) for r in df.filter(overlap.signs_fit("x", "y")).collect()}
    assert got == {(i, j) for i in range(len(words)) for j in range(len(words)) if overlap.near_signs(x[i : i + 1], x[j : j + 1])[0]} and len(got) > len(words)


def test_alike_counts_common_strings_of_four():
    from collections import Counter

    rng = random.Random(12)
    grams = lambda t: Counter(t[i : i + 4] for i in range(max(1, len(t) - 3)))
    first = [text(rng, 3).lower() for _ in range(30)] + ["a", "abc", "中文", "aaaaaaaa"]
    second = [changed(rng, t) if i % 3 else text(rng, 3) for i, t in enumerate(first[:30])] + ["a", "abd", "中文", "aaaa"]
    want = []
    for a, b in zip(first, second):
        x, y = grams(a), grams(b)
        n, m, both = x.total(), y.total(), (x & y).total()
        want.append(2 * both >= overlap.ALIKE * (n + m) or (both >= overlap.WITHIN * min(n, m) and abs(n - m) <= overlap.SENTENCE))
    assert overlap.alike(first, second).tolist() == want and 3 < sum(want) < len(want)


@pytest.mark.parametrize(("a", "b", "is_same"), [
    (("a study of tides", "we look at tides and at the moon every day"), ("a study of tides short paper", "we look at tides and at the moon each day"), True),
    (("evidence from nanabigu", "annotators were recruited from the town"), ("evidence from rakudodu", "annotators were recruited from the town"), False),
    (("a study of tides", "we look at tides"), ("a study of tides", "cats and dogs like other things entirely"), False),
    (("a study", ""), ("a study", "anything"), True), (("", ""), ("", ""), False), (("a studdy", ""), ("a study", "x"), False),
])
def test_same(a, b, is_same):
    assert same(*a, *b) is is_same and same(*b, *a) is is_same


def test_normalise():
    assert normalise("<p>Ｃafé–Étude ﬁne​ly</p> Ã©tude") == normalise("cafe etude finely étude") == "cafe etude finely etude"
    assert normalise("研究A") == "研 究 a" and normalise(None) == ""


def test_distance_stops_early():
    assert overlap.distance("abcd", "abdc", 3) == 1 and overlap.distance("abc", "xyz", 1) == 2 and overlap.distance("", "ab", 5) == 2
