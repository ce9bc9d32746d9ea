import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from recitant.llm import encoding as E
from recitant.llm import language as L
from recitant.llm import samples

TEXT = {
    "en": "The ferryman opened the gate in the morning because nobody else had the key. She would never leave the old lamp under the stairs.",
    "de": "Der Fährmann öffnete am Morgen das Tor, weil niemand sonst den Schlüssel hatte. Sie wollte die alte Lampe nicht unter der Treppe lassen.",
    "fr": "Le passeur ouvrit la porte le matin parce que personne n’avait la clé. Elle ne voulait pas laisser la vieille lampe sous l’escalier.",
    "es": "El barquero abrió la puerta por la mañana porque nadie tenía la llave. Ella no quería dejar la lámpara vieja debajo de la escalera.",
    "pt": "O barqueiro abriu a porta de manhã porque ninguém tinha a chave. Ela não queria deixar a lâmpada velha debaixo da escada.",
    "it": "Il traghettatore aprì la porta al mattino perché nessuno aveva la chiave. Lei non voleva lasciare la vecchia lampada sotto la scala.",
    "nl": "De veerman opende in de ochtend de poort omdat niemand anders de sleutel had. Zij wilde de oude lamp niet onder de trap laten.",
    "tr": "Kayıkçı sabahleyin kapıyı açtı çünkü başka kimsede anahtar yoktu. Eski lambayı merdivenin altında bırakmak istemedi.",
    "ru": "Паромщик утром открыл ворота, потому что ни у кого не было ключа.",
    "el": "Ο βαρκάρης άνοιξε την πύλη το πρωί γιατί κανείς δεν είχε το κλειδί.",
    "zh": "摆渡人早上打开了门，因为没有人有钥匙。",
    "ja": "渡し守は朝に門を開けた、誰も鍵を持っていなかったからだ。",
    "ko": "뱃사공은 아침에 문을 열었다 왜냐하면 아무도 열쇠가 없었기 때문이다.",
    "th": "คนพายเรือเปิดประตูในตอนเช้า เพราะไม่มีใครมีกุญแจ",
    "ar": "فتح صاحب القارب الباب في الصباح.",
    "hi": "नाविक ने सुबह दरवाज़ा खोला।",
}


@pytest.fixture(scope="module")
def model():
    return L.train({k: [v] * 3 for k, v in TEXT.items()}, {})


def test_labels_in_any_spelling(spark):
    rows = [("en-GB", "en"), ("EN", "en"), ("deu", "de"), ("ger", "de"), ("Français", "fr"), ("zh-Hans", "zh"), ("日本語", "ja"), ("en_US", "en"), ("  ", None), (None, None), ("und", None), ("mul", None), ("xx", None), ("?", None), ("default", None), ("Ελληνικά", "el")]
    df = spark.createDataFrame(rows, "tag string, lang string").select("lang", samples.labelled(F.col("tag")).alias("got"))
    assert all(r.got == r.lang for r in df.collect())


def test_each_language(model):
    assert L.languages_of(list(TEXT.values()), model) == [{k} for k in TEXT]


def test_mixed_text(model):
    mixed = f"{TEXT['en']}\n\n{TEXT['de']} {TEXT['ru']}\n\nHe said “très bien” and left the old gate open."
    assert L.languages_of([mixed, "", "123 ???", TEXT["fr"]], model) == [{"en", "de", "ru"}, set(), set(), {"fr"}]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    for length in (1, 2, 4):
        vectors = -rng.random((5, 3)).astype(np.float32) * 12
        rows = rng.integers(0, 5, length * 2)
        got = L.viterbi(rows, np.array([0, length, 2 * length]), vectors)
        for a in (0, length):
            own = rows[a : a + length]
            score = lambda p: sum(vectors[r, x] for r, x in zip(own, p)) - L.SWITCH * sum(x != y for x, y in zip(p, p[1:]))  # noqa: E731, B023
            best = max(itertools.product(range(3), repeat=length), key=score)
            assert score(tuple(got[a : a + length])) == pytest.approx(score(best), abs=1e-4)


def test_batches_change_nothing(model, monkeypatch):
    texts = [*TEXT.values(), f"{TEXT['it']} {TEXT['tr']}", ""] * 3
    expected = [x.tolist() for _, x, _, _ in L.label_words(texts, model)]
    monkeypatch.setattr(L, "BATCH_WORDS", 10)
    assert [x.tolist() for _, x, _, _ in L.label_words(texts, model)] == expected


def test_frames(spark, model):
    rows = [(1, 9, TEXT["en"] + " " + TEXT["el"], "x"), (1, 9, TEXT["en"] + " " + TEXT["el"], "x"), (2, 9, None, "x"), (3, None, "", None)]
    df = spark.createDataFrame(rows, "k bigint, s bigint, text string, lang string")
    assert sorted((r.k, r.s, r.lang) for r in L.sentence_languages(df, ["k", "s"], "text", model).collect()) == [(1, 9, "el"), (1, 9, "el"), (1, 9, "en"), (1, 9, "en")]
    parts = L.segments(df.limit(1), "k", "text", model).orderBy("seg_no").collect()
    assert [(r.seg_no, r.lang) for r in parts] == [(1, "en"), (2, "el")] and all(0.5 < r.confidence <= 1 for r in parts)
    assert rows[0][2][parts[1].seg_start : parts[1].seg_end] == TEXT["el"].rstrip(".")
    assert L.segments(df.where("false"), "k", "text", model).count() == 0


def test_texts_with_few_suspicious_places_are_restored(model):
    repairer = E.train({k: [v] * 3 for k, v in TEXT.items()})
    at = {b: c for c, b in E.byte_of("cp1251").items()}
    garbled = "".join(at[b] for b in "Ο βαρκάρης άνοιξε την πύλη το πρωί.".encode("cp1253"))
    assert 1 <= E.suspicious([garbled])[0] <= 4
    assert L.languages_of([garbled], model) == [{"ru"}]  # what it counts as unrestored
    assert L.languages_of(L._restored([garbled], repairer), model) == [{"el"}]


def test_segments_of_garbled_text_lie_in_the_text_as_it_is(spark, model):
    repairer = E.train({k: [v] * 3 for k, v in TEXT.items()})
    at = {b: c for c, b in E.byte_of("cp1252").items()}
    garbled = "".join(at[b] for b in TEXT["ru"].encode("utf-8"))
    text = f"{TEXT['en']} {garbled} {TEXT['en']}"
    rows = L.segments(spark.createDataFrame([(1, text)], "k bigint, text string"), "k", "text", model, repairer).orderBy("seg_no").collect()
    assert [r.lang for r in rows] == ["en", "ru", "en"]
    assert garbled.rstrip(". ") in text[rows[1].seg_start : rows[1].seg_end] and text[rows[2].seg_start :] == TEXT["en"]
    assert all(a.seg_end <= b.seg_start for a, b in zip(rows, rows[1:]))
