import unicodedata

import pytest

from recitant.llm import canonical as C
from recitant.llm import queries

SCRIPTS = C.train({"en": ["The old ferryman opened the gate near the harbour."], "ru": ["Старый паромщик открыл ворота у гавани."], "el": ["Ο γέρος φύλακας άνοιξε την πόρτα."]})
SAME = [
    ("Ｔｈｅ ｇａｔｅ", "The gate"), ("The\u2007gate", "The gate"), ("The ga\u200bte", "The gate"), ("\ufeffThe gate", "The gate"), ("Тhе gаtе", "The gate"), ("cafe\u0301", "café"), ("mаnhа\u0303", "manhã"), ("ﬁrst", "first"),
    ("Ста\xadрую книгу", "Старую книгу"), ("Cтарую книгу", "Старую книгу"), ("άνoιξε", "άνοιξε"), ("ﾗﾝﾀﾝ", "ランタン"), ("a\r\nb", "a\nb"), ("Ｉ", "I"), ("І", "I"), ("ОН", "OH"), ("а\u2060b", "ab"), ("\u2f08", "人"), ("non\u2011stop", "non-stop"), ("a  b ", "a b"),
]
DIFFERENT = [("The gate?", "The gate"), ("The gate", "the gate"), ("naïve", "naive"), ("x²", "x2"), ("a\nb", "a b"), ("gate", "gates"), ("👩\u200d🔬", "👩🔬")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(a, b):
    assert C.canonical(a, SCRIPTS) == C.canonical(b, SCRIPTS)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_other_look(a, b):
    assert C.canonical(a, SCRIPTS) != C.canonical(b, SCRIPTS)


def test_script_of_the_result():
    mixed = "The gаte, Старый пaромщик и the lаmp"
    assert C.canonical(mixed, SCRIPTS) == "The gate, Старый паромщик и the lamp"
    assert C.canonical(None, SCRIPTS) is None and C.canonical("", SCRIPTS) == "" and C.canonical(" \n ", SCRIPTS) == ""


def test_every_writing_of_a_class_gives_one_form():
    import random

    chance = random.Random(9)
    for text in ("The copper lantern hangs above the harbour", "Старый паромщик открыл тяжёлую дверь", "Ο γέρος φύλακας άνοιξε", "The Старый άνοιξε copper"):
        base = C.canonical(text, SCRIPTS)
        for _ in range(40):
            other = "".join(next((chance.choice(cls.replace(".", "")) for cls in C.CLASSES if c in cls), c) for c in unicodedata.normalize("NFD", text))
            assert C.canonical(other, SCRIPTS) == base


def test_pairs(spark):
    rows = [
        (1, 5, "Gate", "The old gate"), (2, 5, "Gate", "The old gate"), (3, 5, "Ｇate", "The old gate"), (4, 5, "Gate", "The\xa0old gate"), (5, 6, "Gate", "The\u2007old gate"), (6, 5, "Gate?", "The old gate"),
        (7, 5, None, None), (8, 5, "", None), (9, 7, "x", None), (10, 7, "x", ""), (11, 7, "x", " "), (12, None, "y", "z"), (13, None, "y", "z "),
    ]
    df = spark.createDataFrame(rows, "chapter_id bigint, source_id bigint, title string, text string").withColumnRenamed("nothing", "form")
    got = sorted(map(tuple, C.look_alike_pairs(df, "chapter_id", "source_id", ["title", "text"], SCRIPTS).collect()))
    assert got == [(1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (9, 11), (10, 11)]
    assert C.look_alike_pairs(df.where("false"), "chapter_id", "source_id", ["title", "text"], SCRIPTS).count() == 0
    plain = {r.chapter_id: r.title for r in C.canonical_texts(df, ["chapter_id"], ["title", "text"], SCRIPTS).collect()}
    assert plain[3] == "Gate" and plain[7] is None


def test_undecided_tokens_are_counted():
    assert C.undecided("сор РОТ") == 2 and C.undecided("Старый сор") == 0 and C.undecided("cop") == 0 and C.undecided(None) == 0


def test_letters_follow_bigrams():
    assert C.canonical("ржa gate дом", SCRIPTS).startswith("ржа")


def test_bigrams_are_counted_in_all_labelled_chapters(spark, tmp_path, monkeypatch):
    sources = [(1, "en"), (2, "Русский"), (3, "Ελληνικά"), (4, None)]
    texts = {1: "The old ferryman opened the gate near the harbour.", 2: "Старый паромщик открыл ворота у гавани.", 3: "Ο γέρος φύλακας άνοιξε την πόρτα."}
    rows = [(k, 1 + k % 3, texts[1 + k % 3] * 6) for k in range(300)] + [(300 + k, s, "Short " + t) for k, (s, t) in enumerate([(1, "mqzv words here."), (4, "xqjw words there.")])] + [(400, 1, None), (401, 1, "")]
    spark.createDataFrame(rows, "chapter_id bigint, source_id bigint, text string").write.parquet(f"{tmp_path}/chapters.parquet")
    spark.createDataFrame(sources, "source_id bigint, language_tag string").write.parquet(f"{tmp_path}/sources.parquet")
    got = queries._scripts(spark, str(tmp_path)).tables
    assert "qz" in got[0] and "xq" not in got[0]
    whole = {C.LATIN[0]: [t for _, s, t in rows if s == 1 and t], "ru": [t for _, s, t in rows if s == 2], "el": [t for _, s, t in rows if s == 3]}
    assert got == C.train(whole).tables
    monkeypatch.setattr(C, "COUNTED_CHARS", 1)
    assert got == C.train(whole).tables
