import random

import numpy as np
import pytest

from recitant.llm import queries
from recitant.llm import sentences as S

CASES = [
    "The ferryman met Dr. Lorgri at 8 p.m.|The bell rang.",
    "They met on Jan. 3 and again on Feb. 11.|Her brother left.",
    "It cost 3.50, not 35.0.|Version 2.3.1 is out!",
    "“Not now. Not here,” she said.|He left.",
    "“Who is it?” he asked.|“No one.”|The end",
    "‘A map?’ they shouted.|It was.",
    "J. K. Halfen and Mr. and Mrs. Lorder live at 14 Mill St. near the quay.|The lane is long.",
    "Candles, ropes, etc. were sold.|Candles, ropes, etc.|The end.",
    "And then… nothing.|The night came.",
    "The answer was no.|No. 210 is missing.",
    "A heading\n\n|A paragraph that is\nhard wrapped here.|Next one.",
    "Am 17. Juni kam Hr. Ostquo um 8.30 Uhr an.|Das war z. B. in Sarzi.|»Wer?« fragte er.|Ende.",
    "„Nicht jetzt. Nicht hier“, flüsterte sie.|Niemand kam.",
    "« Âme », dit-il.|Le matin, M. Tanzi partit.|« Oui! »|Fin.",
    "¿Quién es?|¡Nadie!|La Sra. Pel vive aquí.",
    "他说：“快走。别回头！”然后关上了门。|「完。」她说。|没有人。",
    "「行くな。戻れ！」と彼は叫んだ。|船長は扉を開けた。",
    "그는 갔다.|“어디로?” 그녀가 말했다.|끝.",
    "वह गया।|“कौन?” उसने कहा।|अंत।",
    "ذهب الرجل.|“من؟” سأل الطفل.|انتهى.",
    "คนแปลกหน้าเปิดกล่อง |ในห้อง 58 ของอาคารมีหมา |จบ",
    "В 1897 г. он ушёл и т. д.|Никто не знал.",
    "Πού πήγε;|Δεν ξέρω.",
]


@pytest.mark.parametrize("case", CASES)
def test_cases(case):
    text = case.replace("|", "" if any("　" < c < "ꀀ" for c in case) else " ") if "\n\n" not in case and "ค" not in case else case.replace("\n\n|", "\n\n").replace(" |", " ").replace("|", " ")
    expected = [p.strip() for p in case.replace("\n\n|", "|").replace(" |", "|").split("|")]
    got, last = [], 0
    for end in S.sentence_ends([text])[0]:
        got.append(text[last:end].strip())
        last = end
    assert got == expected


def test_look_alikes_and_unseen_characters():
    for text in ("He met Мr. Lorgri, еtс. at noon.\u200b The bell rang.", "The p\u200b. 113 of it.\ufeff Next one."):
        assert len(S.sentence_ends([text])[0]) == 2


def test_abbreviations_that_no_table_holds():
    for case in ("Approx. Sen. Jones spoke.", "Gov. Lee and Pres. Obama came.", "See Eq. 4 for it.", "Maj. Vell met Rep. Dorn at noon."):
        assert S.sentence_ends([case]) == [[len(case)]]
    sample = ["He kept vgt. three, and vgt. four of them. The lamp is old. It is red."] * 12 + ["It is sold. The lamp is sold. Then it was sold."] * 12
    learned = S.learned_abbreviations(sample)
    assert learned == {"vgt"}
    assert S.sentence_ends(["She bought vgt. Lamps."]) == [[15, 22]] and S.sentence_ends(["She bought vgt. Lamps."], learned) == [[22]]


def test_letters_are_the_steps_of_their_symbols():
    for place, k in list(S.LETTERS.items())[::7]:
        for start in range(S.N_STATES):
            state, out = start, False
            for symbol in S.SPELLED[place]:
                out |= bool(S.EMIT[state, symbol])
                state = int(S.STEP[state, symbol])
            assert (state, out) == (S.TO[start, k], S.OUT[start, k]) and state < S.N_STATES


def test_scan_equals_one_step_at_a_time():
    chance = random.Random(1)
    for n in (0, 1, 5, 63, 64, 65, 1000):
        letters = np.array([chance.randrange(len(S.LETTERS)) for _ in range(n)], dtype=np.uint16)
        state, expected = 0, []
        for x in letters:
            expected.append(state)
            state = int(S.TO[state, x])
        for block in (3, 64):
            assert S.prefix_states(letters, block).tolist() == expected


def test_texts_do_not_touch_each_other():
    texts = ["“Open quote. Never closed", None, "", "  \n ", "One. Two.", "“A b. C d.” E f."]
    together = S.sentence_ends(texts)
    assert together == [S.sentence_ends([t])[0] for t in texts]
    assert together[1:4] == [[], [], []] and len(together[0]) == 2


def test_frames(spark):
    df = spark.createDataFrame([(1, "One. Two.", 5), (1, "One. Two.", 5), (2, None, 6), (3, "", 7)], "k bigint, text string, sent_end int")
    assert sorted((r.k, r.sent_end) for r in S.sentence_ends_of(df, "k", "text").collect()) == [(1, 4), (1, 4), (1, 9), (1, 9)]
    rows = S.sentences_of(df.where("k = 1"), ["k"], "text", unique=True).orderBy("sent_no").collect()
    assert [(r.sent_no, r.sent_start, r.sent_end, r.sentence) for r in rows] == [(1, 0, 4, "One."), (2, 5, 9, "Two.")]
    assert S.sentence_ends_of(df.where("false"), "k", "text").count() == 0


@pytest.mark.parametrize("window,halo", [(700, 300), (1 << 20, 1 << 12)])
def test_windows_of_long_texts(spark, window, halo):
    chance = random.Random(3)
    pieces = ["The ferryman met Dr. Lorgri at 8 p.m. ", "“Not now. Not here,” she said. ", "“Open and never closed. Then more. ", "A heading\n\n", "他说：“快走。别回头！”然后关上了门。", "Candles, ropes, etc. were sold. ", " " * 9, "\n\n"]
    rows = [(k, "".join(chance.choice(pieces) for _ in range(chance.randint(1, 120)))) for k in range(30)] + [(98, None), (99, "")]
    df = spark.createDataFrame(rows, "k bigint, text string")
    whole = sorted(map(tuple, S.sentence_ends_of(df, "k", "text").collect()))
    assert sorted(map(tuple, S.long_sentence_ends_of(df, "k", "text", window=window, halo=halo).collect())) == whole


def test_very_long_text():
    text = "A word here. " * 20000
    assert len(S.sentence_ends([text])[0]) == 20000


def test_abbreviations_are_counted_in_all_chapters(spark, tmp_path):
    plain, rare = "The lamp is old and it is red. She kept it all the same. " * 5, "He kept vgt. three of them. She kept it vgt. longer. "
    rows = [(k, 1 + k % 2, plain + rare * (k % 25 == 0)) for k in range(300)] + [(300, None, None), (301, 1, ""), (302, 2, "Kept xq. here. " * 9)]
    spark.createDataFrame(rows, "chapter_id bigint, source_id bigint, text string").write.parquet(f"{tmp_path}/chapters.parquet")
    spark.createDataFrame([(1, "en"), (2, None)], "source_id bigint, language_tag string").write.parquet(f"{tmp_path}/sources.parquet")
    assert queries._abbreviations(spark, str(tmp_path)) == {"vgt"} == S.learned_abbreviations(t for _, _, t in rows if t)


def test_settling_changes_no_count(monkeypatch):
    texts = ["He kept vgt. three, (vgt.) and vgt.\n four. A.b. No.", "vgt. 3 “ca. five”", "no. no.. no"] * 4
    whole = S.StopCounts()
    for t in texts:
        whole.add(t)
    whole.settle()
    monkeypatch.setattr(S, "COUNTED_CHARS", 1)
    parts = S.StopCounts()
    for t in texts:
        parts.add(t)
    assert (parts.whole, parts.stopped, parts.inside) == (whole.whole, whole.stopped, whole.inside)
    assert (whole.whole["vgt"], whole.stopped["vgt"], whole.inside["vgt"]) == (16, 16, 12)
