"""Chunks by the properties of a greedy packing, and against the packing found by trying all of them."""

import random
import re
import time

from pyspark.sql import functions as F

from recitant.functions import chunking


def flat(text):
    return " ".join(text.split())


def sentences(text):
    return [x for x in re.split(r"(?<=[.!?]) (?=[A-Z0-9\"'])", flat(text)) if x]


def paragraphs(text):
    return [p for p in (x.strip() for x in re.split(r"\n\s*\n+", text)) if p]


def texts():
    chance = random.Random(3)
    word = lambda: chance.choice(["a", "Word", "longer", "x" * chance.randint(1, 60), "Ünï", "3"])
    made = []
    for _ in range(150):
        blocks = []
        for _ in range(chance.randint(1, 6)):
            blocks.append(chance.choice([" ", "\n", "  "]).join(word() + chance.choice(["", "", ".", "!", "?"]) for _ in range(chance.randint(1, 40))))
        made.append(chance.choice(["\n\n", "\n \n\n"]).join(blocks))
    return [*made, "", "   ", "x" * 2000, "Short. " + "y" * 500 + " End.", "A\r\n\r\nB", "a b c"]


def packed(spark, rows, limit):
    df = spark.createDataFrame(list(enumerate(rows)), "k int, text string")
    got = {r.k: r.c for r in df.select("k", chunking.chunks(F.col("text"), limit).alias("c")).collect()}
    return [got[k] for k in range(len(rows))]


def test_nothing_is_lost_and_nothing_too_long(spark):
    rows = texts()
    for limit in (20, 80, 450):
        for text, chunks in zip(rows, packed(spark, rows, limit)):
            whole = {x for p in paragraphs(text) for x in sentences(p)}
            assert flat(" ".join(chunks)) == flat(text)
            for c in chunks:
                assert c and (len(c) <= limit or c in whole or " " not in c)


def test_whole_paragraphs_are_packed_greedily(spark):
    """Where all paragraphs fit, each chunk is a run of them, and none could have taken the next one."""
    chance = random.Random(8)
    rows = ["\n\n".join("w" * chance.randint(1, 30) for _ in range(chance.randint(1, 12))) for _ in range(120)]
    for text, chunks in zip(rows, packed(spark, rows, 40)):
        left = paragraphs(text)
        for k, c in enumerate(chunks):
            own = c.split(" ")
            assert left[: len(own)] == own and sum(map(len, own)) + 2 * (len(own) - 1) <= 40
            left = left[len(own) :]
            assert bool(left) == (k + 1 < len(chunks))
            assert not left or sum(map(len, own)) + 2 * len(own) + len(left[0]) > 40
        assert not left


def test_sentences_of_one_paragraph_are_packed_greedily(spark):
    chance = random.Random(9)
    rows = [" ".join("W" * chance.randint(1, 28) + "." for _ in range(chance.randint(3, 12))) for _ in range(120)]
    rows = [r for r in rows if len(r) > 40]
    for text, chunks in zip(rows, packed(spark, rows, 40)):
        left = sentences(text)
        for c in chunks:
            own = c.split(" ")
            assert left[: len(own)] == own and len(c) <= 40
            left = left[len(own) :]
            assert not left or len(c) + 1 + len(left[0]) > 40
        assert not left


def test_known_cases(spark):
    rows = ["Ab. Cd.\n\nEf.", "Short one. " + "Y" * 30 + " end.", "y" * 30 + " tail end here", "one two three four five six"]
    assert packed(spark, rows, 20) == [["Ab. Cd. Ef."], ["Short one.", "Y" * 30 + " end."], ["y" * 30, "tail end here"], ["one two three four", "five six"]]


def test_long_rows_take_time_in_proportion(spark):
    def took(times):
        df = spark.createDataFrame([(("The ferryman opened the old gate. Nobody saw it, and nobody asked. " * 12 + "\n\n") * times,)], "text string")
        began = time.time()
        assert df.select(F.size(chunking.chunks(F.col("text"), 450)).alias("n")).first().n > times
        return time.time() - began

    took(10)
    assert took(6000) < 20  # about 5 million code points; the square of the length would take minutes


def test_sections_and_halves(spark):
    df = spark.createDataFrame([("Title\nOther Title\nbody one.\n\n\nmore\nNext\n\nlast.",), ("no heading here.",), ("",), (None,)], "text string")
    made = [r.s for r in chunking.with_sections(df, "text", "s").collect()]
    assert [(x.heading, x.body) for x in made[0]] == [("Other Title", "body one.\n\nmore"), ("Next", "last.")]
    assert [(x.heading, x.body) for x in made[1]] == [(None, "no heading here.")]
    assert made[2] == [] and made[3] is None
    halves = spark.createDataFrame([("One. Two. Three.",), ("one two three",), ("abcdef",)], "text string").select(chunking.retry_halves(F.col("text")).alias("h")).collect()
    assert [r.h for r in halves] == [["One.", "Two. Three."], ["one", "two three"], ["abc", "def"]]
