"""Sentences, paragraphs, sections and size-bounded chunks inside one row.

Packing folds over lengths alone: its state is where the pieces begin and how full the open one is, so no text is
copied while a text is packed, and each piece is put together once. Paragraphs count two code points for each joint
(JOINT) while they are packed and are joined by one space. Nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import LINE_END, WS, collapse, strip

JOINT = 2


def sentences(c: Column) -> Column:
    """Parts between a closing mark and a capital letter, digit or quotation mark, blanks collapsed."""
    return F.filter(F.split(collapse(c), "(?<=[.!?]) (?=[A-Z0-9\"'])"), lambda x: x != "")


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, rf"\n[{WS}]*\n+"), strip), lambda x: x != "")


def bound(value: Column, body) -> Column:
    """``body`` over a value that is computed once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _begins(items: Column, limit: int, joint: int, alone) -> Column:
    """array<struct<at, alone>>: where the pieces of a greedy packing begin, from 0. ``alone`` says of (length, room
    taken) whether an item is a piece of its own; after such a piece a new one opens."""
    state = F.struct(F.array().cast("array<struct<at: int, alone: boolean>>").alias("begins"), F.lit(0).alias("used"))
    numbered = F.transform(items, lambda x, k: F.struct(k.alias("at"), F.length(x).alias("size")))

    def step(s: Column, x: Column) -> Column:
        opened = lambda flag: F.concat(s["begins"], F.array(F.struct(x["at"].alias("at"), F.lit(flag).alias("alone"))))
        return (
            F.when(alone(x["size"], s["used"]), F.struct(opened(True).alias("begins"), F.lit(0).alias("used")))
            .when((s["used"] == 0) | (s["used"] + joint + x["size"] > limit), F.struct(opened(False).alias("begins"), x["size"].alias("used")))
            .otherwise(F.struct(s["begins"].alias("begins"), (s["used"] + joint + x["size"]).alias("used")))
        )

    return F.aggregate(numbered, state, step, lambda s: s["begins"])


def _packed(items: Column, limit: int, joint: int, alone, apart) -> Column:
    """The pieces of ``items``: those alone through ``apart`` (text to array), the others joined by one space."""

    def pieces(texts: Column) -> Column:
        def one(begins: Column) -> Column:
            end = lambda k: F.coalesce(F.get(begins, k + 1)["at"], F.size(texts))
            return F.transform(begins, lambda b, k: F.when(b["alone"], apart(F.get(texts, b["at"]))).otherwise(F.array(F.array_join(F.slice(texts, b["at"] + 1, end(k) - b["at"]), " "))))

        return bound(_begins(texts, limit, joint, alone), one)

    return F.flatten(bound(items, pieces))


def pack_words(sentence: Column, limit: int) -> Column:
    return _packed(F.split(sentence, " "), limit, 1, lambda size, used: F.lit(False), lambda word: F.array(word))


def pack_sentences(paragraph: Column, limit: int) -> Column:
    """Sentences in chunks; a sentence over the limit is cut at words where no buffer is open, and stands whole
    where one was, as it then opens the next buffer itself."""
    return _packed(sentences(paragraph), limit, 1, lambda size, used: (used == 0) & (size > limit), lambda sentence: pack_words(sentence, limit))


def chunks(text: Column, limit: int) -> Column:
    """Chunks of a section: whole paragraphs packed together, longer paragraphs packed by sentences. An empty
    list for blank texts, null for null."""
    return _packed(paragraphs(text), limit, JOINT, lambda size, used: size > limit, lambda paragraph: pack_sentences(paragraph, limit))


def with_sections(df: DataFrame, text: str, name: str = "sections") -> DataFrame:
    """Adds array<struct<heading, body>>: short lines of plain words are headings; a heading without body gives
    way to the next one; blank runs become one blank line. Null for null.

    Arrays that a later step reads by position are columns of their own, computed once a row."""
    lines, marks = F.col("_lines"), F.col("_marks")
    cut = df.withColumn("_lines", F.transform(F.transform(F.split(text, LINE_END), lambda x: F.struct(x.alias("x"), strip(x).alias("y"))), lambda s: F.when(s["y"] == "", F.lit("")).otherwise(s["x"])))
    found = F.filter(F.transform(lines, lambda x, k: F.when((F.length(x) < 120) & x.rlike(r"^[A-Z0-9][A-Za-z0-9 ,:'\"()/-]{0,118}\z"), k)), lambda k: k.isNotNull())
    marked = cut.withColumn("_marks", F.concat(F.array(F.lit(-1)), found))
    bodies = F.transform(
        marks,
        lambda at, k: F.struct(
            F.when(at >= 0, F.get(lines, at)).alias("heading"),
            strip(F.regexp_replace(F.array_join(F.slice(lines, at + 2, F.greatest(F.lit(0), F.coalesce(F.get(marks, k + 1), F.size(lines)) - at - 1)), "\n"), r"\n{3,}", "\n\n")).alias("body"),
        ),
    )
    return marked.withColumn(name, F.filter(bodies, lambda s: s["body"] != "")).drop("_lines", "_marks")


def retry_halves(text: Column) -> Column:
    """Two halves of a text that failed: by sentences, else by words, else by code points."""
    parts, words = sentences(text), F.filter(F.split(collapse(text), " "), lambda x: x != "")

    def halves(items: Column) -> Column:
        middle = F.greatest(F.lit(1), F.floor(F.size(items) / 2).cast("int"))
        return F.array(F.array_join(F.slice(items, F.lit(1), middle), " "), F.array_join(F.slice(items, middle + 1, F.size(items)), " "))

    middle = F.greatest(F.lit(1), F.floor(F.length(text) / 2).cast("int"))
    return F.when(F.size(parts) > 1, halves(parts)).when(F.size(words) > 1, halves(words)).otherwise(F.array(strip(F.substring(text, F.lit(1), middle)), strip(F.substring(text, middle + 1, F.length(text)))))
