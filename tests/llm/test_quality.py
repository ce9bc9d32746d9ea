import os
import random

import pytest

from recitant.llm import quality as Q

DATA = "/root/testdata/sf0.01"


def kind(text):
    return Q.kind_of(text, Q.measured([text])[0])


def test_kinds():
    assert kind("The ferryman opened the gate. Nobody saw it, and nobody asked.") == "prose"
    assert kind("- one gate\n- two lamps\n- a map\n- the key") == "list"
    assert kind("The gate ........ 4\nThe lamp ...... 9\nThe map ..... 12\nThe key ... 30") == "list"
    assert kind("a\tb\tc\n1\t2\t3\n4\t5\t6\n7\t8\t9") == "table"
    assert kind("| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |") == "table"
    assert kind("Home Next Previous Menu Login Share Home Top Skip Menu Next Page Home Login") == "junk"
    assert kind("qcf jhrckn wbngj gcd hcmrt vdnn nczh wczcl xtmbs bmfq zmgt fkqth") == "junk"
    assert kind("— Where is it?\n— In the lane behind the old mill, I believe.\n— Then let us go there before the rain begins.") == "prose"
    assert kind("") is None and kind(" \n\t ") is None


def test_repeats_are_junk_at_any_size():
    words = ("the ferryman opened an old gate near our harbour before seven lamps were lit while nobody from that quiet village "
             "came down with any letters for him so he waited under a roof and then the old gate was shut").split()  # fmt: skip
    passage = " ".join(words[:20]) + "\n" + " ".join(words[20:])
    assert kind(passage) == "prose"
    for times in (3, 9, 12, 40, 200):
        assert kind("\n".join([passage] * times)) == "junk"
        assert kind("\n\n".join([passage] * times)) == "junk"
        assert kind(" ".join(words * times)) == "junk"
    for unit in ("渡し守は朝に古い門を開けた", "摆渡人早上打开了旧门因为没有人有钥匙", "คนพายเรือเปิดประตูในตอนเช้า"):
        assert kind(unit) == "prose" and kind(unit * 5) == "junk" and kind(unit * 80) == "junk"
    chance = random.Random(5)
    assert kind(" ".join(chance.choice(words[:31]) for _ in range(3000))) == "junk"


def test_one_phrase_or_equal_paragraphs():
    chance = random.Random(2)
    word = lambda: "".join(chance.choice("aeiourstlnmd") for _ in range(chance.randint(3, 8)))
    phrase, fresh = " ".join(word() for _ in range(14)), [" ".join(word() for _ in range(7)) for _ in range(20)]
    text = ". ".join(x for k in range(20) for x in (phrase.capitalize(), fresh[k].capitalize())) + "."
    assert kind(text) == "junk"  # two thirds of it is one phrase of 14 words
    same = " ".join(word() for _ in range(40)).capitalize() + "."
    other = [" ".join(word() for _ in range(40)).capitalize() + "." for _ in range(9)]
    assert kind("\n\n".join([same] * 9 + other)) == "junk" and kind("\n\n".join([same] * 2 + other)) == "prose"


def test_repetition_against_a_loop():
    def loop(words):
        run, seen, covered = min(Q.RUN, len(words) // 3), set(), set()
        for k in range(len(words) - run + 1):
            if (gram := tuple(words[k : k + run])) in seen:
                covered.update(range(k, k + run))
            seen.add(gram)
        return len(covered) / len(words)

    chance, texts = random.Random(1), []
    for _ in range(300):
        unit = [chance.choice("abcdefghij") + str(chance.randint(0, chance.choice([1, 9]))) for _ in range(chance.randint(1, 40))]
        texts.append((unit * chance.randint(1, 12))[: chance.randint(12, 400)] + [str(k) for k in range(chance.choice([0, 0, 5, 20, 60]))])
    texts += [[], ["a"], ["a"] * 11, ["a"] * 500]
    coverage, repeated = Q.repetition(texts)
    for k, words in enumerate(texts):
        assert repeated[k] == pytest.approx(loop(words) if len(words) >= 12 else 0.0)
        for n in (2, 3, 7, 10):
            assert coverage[k][n - 2] == pytest.approx(most_covered(words, n))


def test_counts_against_a_loop():
    import unicodedata

    texts = ["a b-c 3 !!", "", "汉字 mixed 的", "นี่ ok", "  ", "हिन्दी है", "$ # x@y"]
    got = Q.counts(texts)
    for k, t in enumerate(texts):
        assert got["words"][k] == len(Q.word_list(t))
        assert got["letters"][k] == sum(unicodedata.category(c)[0] in "LMN" for c in t)
        assert got["solid"][k] == sum(not c.isspace() for c in t)


def most_covered(words, n):
    total, best = sum(map(len, words)), 0
    places = {}
    for k in range(len(words) - n + 1):
        places.setdefault(tuple(words[k : k + n]), []).append(k)
    for at in places.values():
        if len(at) > 1:
            best = max(best, sum(len(words[i]) for i in {k + j for k in at for j in range(n)}))
    return best / total if total else 0.0


def test_frame(spark):
    df = spark.createDataFrame([(1, "The gate. The gate.\nThe gate."), (2, None), (3, ""), (1, "The gate. The gate.\nThe gate.")], "doc_id bigint, text string")
    rows = Q.statistics(df, "doc_id", "text", ["the"]).orderBy("doc_id").collect()
    assert (rows[0].word_count, rows[0].common_word_share, rows[0].punct_line_share) == (6, 0.5, 1.0) and rows[0] == rows[1]
    assert (rows[2].word_count, rows[2].doc_kind, rows[2].symbol_ratio) == (0, None, 0.0)
    assert Q.statistics(df.where("false"), "doc_id", "text", []).count() == 0
    clash = df.withColumn("doc_kind", df.text)
    assert Q.statistics(clash, "doc_id", "text", []).columns == rows[0].__fields__


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_hand_labels(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/doc_kind_labels.parquet").withColumnRenamed("doc_kind", "label")
    rows = Q.statistics(docs, "doc_id", "text", []).join(labels, "doc_id").collect()
    assert len(rows) > 50 and sum(r.doc_kind == r.label for r in rows) >= 0.97 * len(rows)
