import numpy as np
import pytest

from tessera.llm import language
from tessera.llm.language import Model, code, path, segments, sentences

TEXTS = {
    "en": "The quick brown fox jumps over the lazy dog and runs into the deep forest. We present the results of our work on the labels. These texts were collected from the archives of the museum. ",
    "fr": "Le renard brun saute par-dessus le chien paresseux et court dans la forêt. Nous présentons les résultats de notre travail sur les étiquettes. Ces textes ont été recueillis dans les archives du musée. ",
    "de": "Der schnelle braune Fuchs springt über den faulen Hund und läuft in den tiefen Wald. Wir zeigen die Ergebnisse unserer Arbeit an den Klassen. Diese Texte wurden aus den Archiven des Museums gesammelt. ",
    "zh": "敏捷的棕色狐狸跳过了懒狗，跑进了森林深处。我们介绍了标注工作的结果。这些文本来自博物馆的档案。",
}
LANGS = sorted(TEXTS)


def data(spark, rows):
    return spark.createDataFrame(rows, "id string, abstract string, language string, venues array<string>, key string, text string, label int")


def row(i, text, label, venues=None):
    return (i, text, label, venues, "k", "t", 1)


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(t, x) for x, t in TEXTS.items() for _ in range(3)] + [(TEXTS["en"], "fr"), (None, "en"), ("x", None)]
    return spark.createDataFrame(rows, "text string, lang string")


def run(spark, labelled, rows, venues="venues"):
    got = {}
    for r in segments(data(spark, rows), "id", "abstract", "language", labelled, LANGS, venues).orderBy("id", "seg").collect():
        assert r["seg"] == len(got.setdefault(r["id"], [])) + 1 and 0 < r["confidence"] <= 1
        got[r["id"]].append(r["lang"])
    return got


def test_whole_mixed_blank_and_repeated(spark, labelled):
    en, fr, de, zh = (TEXTS[x] for x in ("en", "fr", "de", "zh"))
    rows = [
        row("one", en, None), row("fr", fr, "en"), row("mixed", en + fr, "en"), row("three", f"{de}\n{zh} — {en}", ""), row("heads", f"Abstract. {en}\nRésumé. {fr}", "en"), row("null", None, "en"), row("blank", "\t ", "en"),
        row("quote", en.replace("the labels.", 'the labels (see "Le renard brun saute par-dessus le chien paresseux").'), "en"), row("long", en * 500, "en"), row("one", en, None), row("x", "?", None, ["v"]), row("damage", "Ces textes ont Ã©tÃ© recueillis dans les forÃªts et les musÃ©es.", "fr"),
    ]
    got = run(spark, labelled, rows[:9])
    assert got == {"one": ["en"], "fr": ["fr"], "mixed": ["en", "fr"], "three": ["de", "zh", "en"], "heads": ["en", "fr"], "quote": ["en"], "long": ["en"]}
    assert run(spark, labelled, [rows[-1]]) == {"damage": ["fr"]}
    assert len(run(spark, labelled, [rows[-2]])["x"]) == 1


def test_empty_tables(spark, labelled):
    assert run(spark, labelled, []) == {}
    assert run(spark, labelled.limit(0), [row("a", TEXTS["en"], "en")]) == {}
    assert run(spark, labelled, [row("a", TEXTS["en"], "en")], None) == {"a": ["en"]}


def test_codes(spark):
    cases = {"EN": "en", "en-GB": "en", " Français ": "fr", "zho": "zh", "pt_BR": "pt", "unk": None, "": None, None: None, "German": "de", "ja": "ja", "und": None}
    got = spark.createDataFrame([(x,) for x in cases], "l string").select(code(language.F.col("l")).alias("c")).collect()
    assert [r["c"] for r in got] == list(cases.values())


def test_code_lengths_equal_a_plain_reading():
    """Method C over contexts of up to ORDER bytes, symbol by symbol."""
    texts = {"a": ["abracadabra abra"], "b": ["banana bandana ban"]}
    model = Model.fit(texts)
    for probe in ("abba banana", "zzz", "cadabra ban"):
        got = model.lengths([probe])[0]
        for i, x in enumerate(model.languages):
            raw = b" " * language.ORDER + texts[x][0].encode()
            seen: dict[bytes, dict[int, int]] = {}
            for p in range(language.ORDER, len(raw)):
                for o in range(language.ORDER + 1):
                    c = seen.setdefault(raw[p - o : p], {})
                    c[raw[p]] = c.get(raw[p], 0) + 1
            bits, s = 0.0, b" " * language.ORDER + probe.encode()
            for p in range(language.ORDER, len(s)):
                for o in range(language.ORDER, -1, -1):
                    c = seen.get(s[p - o : p])
                    if not c:
                        continue
                    t, q = sum(c.values()), len(c)
                    if s[p] in c:
                        bits += np.log2((t + q) / c[s[p]])
                        break
                    bits += np.log2((t + q) / q)
                else:
                    bits += 8
            assert got[i] == pytest.approx(bits, rel=1e-4)


def test_path_switches_only_where_it_pays():
    bits = np.array([[10, 90], [40, 36], [10, 80], [90, 10], [80, 12]], float)
    assert path(bits, np.zeros(2)).tolist() == [0, 0, 0, 1, 1]


def test_sentences_keep_headings_with_what_follows():
    assert sentences("Abstract. We went home early today.\n\nRésumé\nNous sommes rentrés tôt ce soir. Oui.") == ["Abstract. We went home early today.", "Résumé Nous sommes rentrés tôt ce soir. Oui."]


def test_latest_row_per_key(spark):
    from datetime import datetime

    rows = [("a", 1, "old"), ("a", 3, "new"), ("b", None, "x"), ("b", 2, "y"), ("c", 1, "same"), ("c", 1, "same"), (None, 1, "n"), ("d", 1, "p"), ("d", 1, "q")]
    df = spark.createDataFrame([(k, datetime(2020, 1, t) if t else None, v) for k, t, v in rows], "id string, t timestamp_ntz, v string")
    got = sorted((r["id"], r["v"]) for r in language.latest(df, "id", "t", "v").collect())
    assert got[:3] == [("a", "new"), ("b", "y"), ("c", "same")] and got[3][0] == "d" and len(got) == 4


def test_broadcast_and_joined_venues_agree(spark, labelled, monkeypatch):
    rows = [row(f"k{i}", TEXTS["fr" if i % 2 else "de"], "fr" if i % 2 else "de", [f"v{i % 2}", f"w{i}"]) for i in range(40)]
    rows += [row("short0", "?!", None, ["v0", "v0", None]), row("short1", "?!", None, ["v1"]), row("none", "?!", None, []), row("null", "?!", None, None), row("new", "?!", None, ["unseen"])]
    near = run(spark, labelled, rows)
    assert near["short0"] == ["de"] and near["short1"] == ["fr"]
    monkeypatch.setattr(language, "VENUES", 2)
    assert run(spark, labelled, rows) == near


def test_confidence_is_calibrated():
    """On sentences that can't be told apart well, confidence is about the share of right ones."""
    rng = np.random.default_rng(3)
    make = lambda p: " ".join("".join(rng.choice(list("abcd"), 3, p=p)) for _ in range(6))
    a, b = [0.3, 0.3, 0.2, 0.2], [0.2, 0.2, 0.3, 0.3]
    texts = {"x": [make(a) for _ in range(1500)], "y": [make(b) for _ in range(1500)]}
    factor, model = language.calibrated(texts), Model.fit(texts)
    probe = [(make(p), i) for _ in range(400) for i, p in enumerate((a, b))]
    bits = model.lengths([t for t, _ in probe])
    z = np.exp2(-(bits - bits.min(1, keepdims=True)) * factor)
    sure, right = z.max(1) / z.sum(1), bits.argmin(1) == [i for _, i in probe]
    assert abs(sure.mean() - right.mean()) < 0.05 and 0.6 < right.mean() < 0.99


def test_copies_of_a_text_are_one_training_text(spark):
    df = spark.createDataFrame([(TEXTS["en"], "en")] * 50 + [(TEXTS["fr"] * 200, "fr")] + [(None, "en")], "text string, lang string")
    got = language.sample(df, LANGS)
    assert len(got["en"]) == len(sentences(TEXTS["en"])) and "fr" not in got
