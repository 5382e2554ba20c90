import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="needs the public vocabulary")


@pytest.fixture(scope="module")
def both():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.VOCABULARY)
    t.encode_special_tokens = True
    return bpe.load(), t


def check(both, texts):
    v, t = both
    ids, n = bpe.encode(texts, v)
    upto = np.r_[0, np.cumsum(n)]
    for i, want in enumerate(t.encode_batch([x or "" for x in texts], add_special_tokens=False)):
        assert ids[upto[i] : upto[i + 1]].tolist() == want.ids


def test_odd_texts(both):
    check(both, [None, "", " ", "\n\n", "aaaa" * 1000, "<|endoftext|>", "I'll we've it's", "é中文😀​﻿", "a" * 100_000, "x  y   z ", "\x00\x1c\x85", "½ ² Ⅷ 12345"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=0x2FFFF, exclude_categories=["Cs"]), max_size=60), max_size=8))
def test_any_text(both, texts):
    check(both, texts)


def test_table(spark, both):
    rows = [(1, "a text", "x", 1), (2, None, "y", 2), (3, "", None, 3), (4, "a text", "x", 4), (5, "b " * 50_000, "z", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, out int")
    got = {r["doc_id"]: r for r in bpe.encode_corpus(df).collect()}
    assert got[2]["ids"] == got[3]["ids"] == [] and got[1]["ids"] == got[4]["ids"] == both[1].encode("a text").ids
    assert len(got[5]["ids"]) == 100_000 // 2 + 1 and got[5]["out"] == 5
    assert {r["doc_id"]: r["tokens"] for r in bpe.count_tokens(df).collect()} == {k: len(r["ids"]) for k, r in got.items()}
    assert bpe.encode_corpus(df.limit(0)).count() == 0


def test_round_trip(both):
    text = "Any text – with signs, naïve café 中文, emoji 😀 and\ttabs."
    assert both[1].decode(bpe.encode([text], both[0])[0].tolist()) == text


def test_slices_cover_all(monkeypatch):
    monkeypatch.setattr(bpe, "BATCH_CHARS", 10)
    for lengths in ([], [3, 3, 3, 3], [50, 1, 50], [0, 0]):
        s = bpe.slices(np.array(lengths, np.int64))
        assert [i for a, b in s for i in range(a, b)] == list(range(len(lengths)))
