import pytest

from recitant.llm import encoding as E
from recitant.llm import queries
from tests.llm.test_language import TEXT

MORE = {k: [v] * 3 for k, v in TEXT.items()}
REPAIRER = E.train(MORE)
CHAINS = [
    ("de", "utf-8", "cp1252"), ("fr", "utf-8", "latin-1"), ("es", "utf-8", "cp1250"), ("ru", "utf-8", "cp1251"), ("fr", "utf-8", "mac_roman"), ("de", "utf-8", "cp437"), ("hi", "utf-8", "latin-1"), ("zh", "utf-8", "latin-1"),
    ("ru", "cp1251", "latin-1"), ("ru", "koi8-r", "cp1251"), ("ru", "cp866", "cp1251"), ("el", "cp1253", "latin-1"), ("tr", "cp1254", "latin-1"), ("ar", "cp1256", "latin-1"), ("zh", "gbk", "latin-1"), ("ja", "euc_jp", "latin-1"), ("ko", "cp949", "latin-1"), ("fr", "cp1252", "cp1251"),
]


def read_as(text, right, wrong):
    table = {b: c for c, b in E.byte_of(wrong).items()}
    return "".join(table[b] for b in text.encode(right))


@pytest.mark.parametrize("lang,right,wrong", CHAINS)
def test_round_trip(lang, right, wrong):
    text = TEXT[lang].replace("’", "'") if right != "utf-8" else TEXT[lang]
    garbled = read_as(text, right, wrong)
    fixed, chains = REPAIRER.text(garbled)
    assert fixed == text and chains


def test_twice_and_in_places():
    once = read_as("naïve café", "utf-8", "cp1252")
    assert REPAIRER.text(f"The lamp in the {read_as(once, 'utf-8', 'cp1252')} was old.")[0] == "The lamp in the naïve café was old."
    text = f"{TEXT['de']} {read_as(TEXT['de'], 'utf-8', 'cp1252')}"
    assert REPAIRER.text(text)[0] == f"{TEXT['de']} {TEXT['de']}"


@pytest.mark.parametrize("lang", sorted(TEXT))
def test_sound_text_stays(lang):
    assert REPAIRER.text(TEXT[lang]) == (TEXT[lang], [])
    assert not E.is_broken(TEXT[lang])


def test_other_oddities_stay():
    for text in ("Тhе gаtе wаs ореn.", "The ｏｌｄ gate", "Ста\xadрую книгу", "El cartel decía ¡AÑO Ñandú!, nada más.", "A ¶ sign and a ☞ hand"):
        assert REPAIRER.text(text)[0] == text


def test_prefilter_misses_nothing():
    texts = [read_as(TEXT[a].replace("’", "'"), b, c) for a, b, c in CHAINS] + list(TEXT.values()) + ["", "plain", "caf�"]
    places = E.suspicious(texts)
    assert all(n > 0 for t, n in zip(texts, places) if E.SUSPICIOUS.search(t))


def test_frame(spark):
    bad = read_as(TEXT["fr"], "utf-8", "cp1252")
    rows = [(1, bad, "x"), (1, bad, "x"), (2, None, "x"), (3, "", None), (4, "caf� noir", None), (5, TEXT["fr"] * 300, None), (6, bad * 200, None)]
    df = spark.createDataFrame(rows, "k bigint, text string, chains string")
    got = {r.k: r for r in E.repair(df, ["k"], "text", REPAIRER).collect()}
    assert got[1].garbled and got[1].restored == TEXT["fr"] and got[1].chains == ["cp1252>utf-8"]
    assert (got[2].restored, got[2].garbled, got[3].restored, got[3].garbled) == (None, False, "", False)
    assert got[4].garbled and got[4].restored == "caf� noir" and not got[5].garbled and got[6].restored == TEXT["fr"] * 200
    assert E.repair(df.where("false"), ["k"], "text", REPAIRER).count() == 0


def test_names():
    names = ["João Fenwell", "João Belson", "Renée Pel", "Renée Lor", "Štěpán Mor", "Štěpán Zin"] * 3
    r = E.train_names(names)
    assert r.text("JoÃ£o Fenwell")[0] == "João Fenwell"
    assert E.is_broken_name("Grikulstršm, Jo‹o") and not any(E.is_broken_name(n) for n in names + ["ÇELIK TANZIIĆ"])


def test_names_are_learnt_alike_at_any_size():
    rare, others = ["Renée Pel"] * 3, [f"Ann{k} Bel{k}" for k in range(6000)]
    for size in (10, 6000):
        learnt = E.train_names(rare + ["João Lor"] * 4 + others[:size])
        assert "é" not in learnt.alphabet and "ã" in learnt.alphabet


def test_every_candidate_is_described(monkeypatch):
    text = f"√2 ≤ ∞ ≠ ≈ 3 in the {read_as('café', 'utf-8', 'cp1252')} by the gate."
    assert REPAIRER.candidates(text).get("√2 ≤ ∞ ≠ ≈ 3 in the café by the gate.") == "cp1252>utf-8"
    found, described = {f"candidate {k}": "latin-1>cp1252" for k in range(30)}, []
    monkeypatch.setattr(REPAIRER, "candidates", lambda text: found)
    monkeypatch.setattr(REPAIRER, "size", lambda text: described.append(text) or 9)
    REPAIRER.segment("Ã©")
    assert set(found) <= set(described)


def test_quotation_marks_read_as_letters_and_signs_in_words():
    for text in ("ôThe keeper counted a mill. It was old.", "It was a brass promise?Æ her brother replied.", "A na•ve little poem was read."):
        assert E.SUSPICIOUS.search(text) and E.suspicious([text])[0] and (REPAIRER.text(text)[1] or E.is_broken(text))
    for text in ("HÔTEL DE LA MER", "Ó senhor, venha cá.", "È VIETATO entrare.", "¿Quién es? ¡Nadie!", "« Ô temps ! » dit-il.", "Dans l’Île, öfter."):
        assert not E.SUSPICIOUS.search(text)
    assert E.is_broken_name("S¿ren Quoder") and E.is_broken_name("A•cha Mor") and not E.is_broken_name("Søren Ôte")


def test_dictionaries_hold_pieces_of_all_labelled_chapters(spark, tmp_path, monkeypatch):
    letters = "abcdefghijklmnopqrst"
    own = [f"{a}{b}omber" for a in letters for b in letters[:15]]
    rows = [(k, 1, f"The old {w} lamp was under the stairs. " * 6) for k, w in enumerate(own)] + [(1000, 2, TEXT["ja"]), (1001, 2, None), (1002, 3, "Nobody labelled this qqomber lamp at all."), (1003, 1, "")]
    spark.createDataFrame(rows, "chapter_id bigint, source_id bigint, text string").write.parquet(f"{tmp_path}/chapters.parquet")
    spark.createDataFrame([(1, "English"), (2, "ja"), (3, "und")], "source_id bigint, language_tag string").write.parquet(f"{tmp_path}/sources.parquet")
    got = queries._text_repairer(spark, str(tmp_path)).dictionaries
    text = got["en"].decode()
    assert sorted(got) == ["en", "ja"] and all(f"old {w}" in text and f"{w} lamp" in text for w in own) and "qqomber" not in text
    assert all(TEXT["ja"][k : k + 3] in got["ja"].decode() for k in range(len(TEXT["ja"]) - 2))
    monkeypatch.setattr(E, "COUNTED_UNITS", 1)
    assert queries._text_repairer(spark, str(tmp_path)).dictionaries == got
    monkeypatch.setattr(E, "DICTIONARY_BYTES", 60)
    for lang, small in queries._text_repairer(spark, str(tmp_path)).dictionaries.items():
        assert 30 < len(small) <= 60 and (lang == "ja" or "under the stairs." in small.decode())


def test_pieces_are_joined_where_they_overlap():
    assert E.joined([("b", "c"), ("a", "b"), ("c", "d"), ("x", "y"), ("c", "b")], " ") == b"c b x y a b b c d"
    assert E.joined([tuple("abc"), tuple("bcd"), tuple("cda")], "") == b"abcda" and E.dictionary([], " ") == b""


def test_names_are_learnt_from_all_authors(spark, tmp_path):
    from pyspark.sql import functions as F

    author = F.when(F.col("id") % 15000 == 7, "Renée Pel").when(F.col("id") % 20000 == 7, "Søren Lor").otherwise("Ann Bel")
    spark.range(60000).select(F.col("id").alias("source_id"), author.alias("author")).write.parquet(f"{tmp_path}/sources.parquet")
    got = queries._name_repairer(spark, str(tmp_path))
    assert got.dictionaries == E.train_names(["Renée Pel"] * 4 + ["Søren Lor"] * 2 + ["Ann Bel"] * 59994).dictionaries and "é" in got.alphabet and "ø" not in got.alphabet
