import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.operators.packed import split_packed

CASES = {
    "a, b": ["a", "b"], "a; b ;c": ["a", "b", "c"], '["x, y", "z"]': ["x, y", "z"], "['O\\'B, r', 'c']": ["O'B, r", "c"], '"The ""Small"" A","b"': ['The "Small" A', "b"],
    "- a\n- b": ["a", "b"], "(1) a (2) b-2": ["a", "b-2"], "{a; b}": ["a", "b"], "(a, b)": ["a", "b"], "a (dev), b": ["a (dev)", "b"], ", a,,a,": ["a", "a"], "R&D-a / b": ["R&D-a", "b"],
    "C++a & Yes/No-b": ["C++a", "Yes/No-b"], "a, b, and c": ["a", "b", "c"], "a、b": ["a", "b"], "a；b，c": ["a", "b", "c"], "a\tb\r\nc": ["a", "b", "c"], "1. a\n2. b": ["a", "b"], 'p | q; r, s': ["p", "q", "r", "s"],
    '["\\u00e9\\n1", "b"]': ["é\n1", "b"], '"a and b" and c': ["a and b", "c"],
    "a": [], "R&D-a": [], '"a, b"': [], '["a"]': [], "": [], "  ": [], ",,": [], "a (b)": [], "[]": [], "'": [], '"': [], "a Lite": [],
}


def run(spark, values, kind="name"):
    df = spark.createDataFrame(list(enumerate(values)), "rec_id long, v string")
    out: dict[int, list] = {i: [] for i in range(len(values))}
    for r in split_packed(df, "rec_id", {"v": kind}).orderBy("rec_id", "pos").collect():
        assert r["pos"] == len(out[r["rec_id"]]) + 1 and r["field"] == "v"
        out[r["rec_id"]].append(r["val"])
    return list(out.values())


def test_cases(spark):
    for value, want, got in zip(CASES, CASES.values(), run(spark, list(CASES))):
        assert got == want, value


def test_codes(spark):
    cases = {"en fr pt-BR": ["en", "fr", "pt-BR"], "en/fr+de&it": ["en", "fr", "de", "it"], "- en\n- fr": ["en", "fr"], "pt-BR": [], "['en', 'zh-Hans']": ["en", "zh-Hans"], "en and fr": ["en", "fr"], None: []}
    assert run(spark, list(cases), "code") == list(cases.values())


def test_no_packed_field_is_filtered_out(spark):
    cases = {"1) A 2) B": ["A", "B"], "1.) A 2.) B": ["A", "B"], "a AND b": ["a", "b"], "a And b": ["a", "b"], "a\u00a0and\u00a0b": ["a", "b"], "a\u3000and\u3000b": ["a", "b"], "a\u00a0b": [], "Band b": [], "GLUE (2018)": []}
    assert run(spark, list(cases)) == list(cases.values())
    codes = {"en\u00a0fr": ["en", "fr"], "en\u3000fr": ["en", "fr"], "\u00a0en\u00a0": [], " en ": []}
    assert run(spark, list(codes), "code") == list(codes.values())


def test_very_long_nulls_repeats_and_empty(spark):
    long = ",".join(f"v{i}" for i in range(20_000))
    a, b, c, d = run(spark, [long, None, "x, y", "x, y"])
    assert len(a) == 20_000 and b == [] and c == d == ["x", "y"]
    assert run(spark, []) == []


def test_other_columns_are_ignored(spark):
    df = spark.createDataFrame([(1, "a,b", "q", "w", [1])], "rec_id long, v string, field string, tokens string, spans array<int>")
    assert [(r["field"], r["val"]) for r in split_packed(df, "rec_id", {"v": "name"}).orderBy("pos").collect()] == [("v", "a"), ("v", "b")]


def test_many_skeletons_without_broadcast(spark, monkeypatch):
    from tessera.operators import packed

    monkeypatch.setattr(packed, "small", lambda df: False)
    got = run(spark, ["a,b", "a;b", "a|b"] * 50)
    assert got == [["a", "b"]] * 150


names = st.lists(st.text(st.sampled_from("abXY09 ,;|'\"\\é中"), min_size=1, max_size=8).map(str.strip).filter(bool), min_size=2, max_size=5)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(names, min_size=1, max_size=20))
def test_json_lists_round_trip(spark, rows):
    assert run(spark, [json.dumps(r) for r in rows]) == rows
