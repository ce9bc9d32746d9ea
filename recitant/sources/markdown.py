"""Markdown documents to chapters, inside one row: no line is shuffled."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from ..functions.text import LINE_END, WS, clean_markdown, strip
from ..tables import importable, spread

SUFFIXES = [".md", ".markdown"]
MAX_LEVEL = 4
_heading = rf"^(#{{1,6}})[{WS}]+(.+)$"


def _marked(df: DataFrame, text: str, wanted: int) -> DataFrame:
    """Adds the lines, their heading levels (0 for none) and the level that divides chapters: the wanted one,
    else the first of 1 to 4 with more than one heading, else 4. Each is a column, computed once a row."""
    if not 0 <= wanted <= MAX_LEVEL:
        raise ValueError(f"heading level must be 0 to {MAX_LEVEL}")
    lines = df.withColumn("_lines", F.split(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), LINE_END))
    levels = lines.withColumn("_levels", F.transform(F.transform("_lines", strip), lambda x: F.when(F.startswith(x, F.lit("#")), F.length(F.regexp_extract(x, _heading, 1))).otherwise(F.lit(0))))
    count = lambda level: F.size(F.filter("_levels", lambda x: x == level))
    auto = F.coalesce(*(F.when(count(level) > 1, F.lit(level)) for level in range(1, MAX_LEVEL + 1)), F.lit(MAX_LEVEL))
    return levels.withColumn("_level", F.lit(wanted) if wanted else auto)


def heading_levels(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, level long): the heading level that would divide each text."""
    return _marked(df.where(F.col(text).isNotNull()), text, 0).select(key, F.col("_level").cast("long").alias("level"))


def _whole(df: DataFrame, keys: list[str], text: str, fallback: str, limit: int) -> DataFrame:
    one = df.where(F.col(text).isNotNull()).select(*keys, F.col(fallback).alias("title"), clean_markdown(F.col(text)).alias("text"))
    if limit <= 0:
        return one.select(*keys, F.lit(1).cast("long").alias("part_no"), "title", "text")
    return _in_parts(one, keys, limit, True)


def _in_parts(made: DataFrame, keys: list[str], limit: int, first_plain: bool, order: str | None = None) -> DataFrame:
    """Chapters (a row each) cut to the limit, numbered over their document."""
    parts = made.select(*keys, *([order] if order else []), "title", _parts_of(F.col("text"), F.lit(limit)).alias("_texts")).withColumn("_n", F.size("_texts"))
    rows = parts.select(*keys, *([order] if order else []), "title", "_n", F.posexplode("_texts").alias("_k", "text"))
    bare = (F.col("_n") == 1) | F.lit(first_plain) & (F.col("_k") == 0)
    named = rows.withColumn("title", F.when(bare, F.col("title")).otherwise(F.concat_ws(" ", "title", (F.col("_k") + 1).cast("string"))))
    if not order:
        return named.select(*keys, (F.col("_k") + 1).cast("long").alias("part_no"), "title", "text")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order, "_k")).cast("long")
    return named.withColumn("_place", place).select(*keys, F.col("_place").alias("part_no"), "title", "text")


def chapters(df: DataFrame, keys: list[str], text: str, fallback: str, level: int = 0, single: bool = False, max_chars: int = 0) -> DataFrame:
    """(*keys, part_no long from 1, title, text). Headings of the dividing level or above begin a chapter;
    chapters without text go; a document without any is one chapter under the title in column ``fallback``.
    Null texts have no chapter. ``single`` takes each document as one chapter. Chapters of more than ``max_chars`` are cut
    into numbered parts (0 for no limit); the first part of a ``single`` document keeps the bare title."""
    if single:
        return _whole(df, keys, text, fallback, max_chars)
    lines, starts = F.col("_lines"), F.col("_starts")
    marked = _marked(df.where(F.col(text).isNotNull()).select(*keys, text, F.col(fallback).alias("_fallback")), text, level)
    heads = F.filter(F.transform("_levels", lambda x, k: F.when((x > 0) & (x <= F.col("_level")), k)), lambda k: k.isNotNull())
    cut = marked.withColumn("_starts", F.concat(F.array(F.lit(-1)), heads)).select(
        *keys,
        text,
        "_fallback",
        F.transform(
            starts,
            lambda at, k: F.struct(
                F.when(at >= 0, strip(F.regexp_extract(strip(F.get(lines, at)), _heading, 2))).alias("title"),
                F.array_join(F.slice(lines, at + 2, F.greatest(F.lit(0), F.coalesce(F.get(starts, k + 1), F.size(lines)) - at - 1)), "\n").alias("raw"),
            ),
        ).alias("_parts"),
    )
    made = cut.withColumn("_made", F.filter(F.transform("_parts", lambda s: F.struct(F.coalesce(s["title"], F.col("_fallback")).alias("title"), clean_markdown(s["raw"]).alias("text"))), lambda s: s["text"] != ""))
    kept = F.when(F.size("_made") > 0, F.col("_made")).otherwise(F.array(F.struct(F.col("_fallback").alias("title"), clean_markdown(F.col(text)).alias("text"))))
    divided = made.select(*keys, F.posexplode(kept).alias("_pos", "_c")).select(*keys, (F.col("_pos") + 1).cast("long").alias("part_no"), "_c.title", "_c.text")
    return _in_parts(divided, keys, max_chars, False, "part_no") if max_chars > 0 else divided


_solid = re.compile(r"\S")


def length_spans(text: str, limit: int) -> list[tuple[int, int]]:
    """Spans of at most ``limit`` code points. A span ends behind the last blank line that lies whole within its window,
    without one behind the last space, without either at the limit; the next begins at the next code point that is
    no blank. The places where a span may end are listed once and searched by bisection."""
    after_lines = [m.start() + 2 for m in re.finditer(r"\n(?=\n)", text)]
    after_spaces = [m.end() for m in re.finditer(" ", text)]
    spans, begin = [], 0
    while begin < len(text):
        end = min(len(text), begin + limit)
        if end < len(text):
            found = (places[k - 1] for places, least in ((after_lines, begin + 2), (after_spaces, begin + 1)) if (k := bisect_right(places, end)) and places[k - 1] > least)
            end = next(found, end)
        spans.append((begin, end))
        solid = _solid.search(text, end)
        begin = solid.start() if solid else len(text)
    return spans


def split_by_length(text: str, limit: int) -> list[str]:
    """The texts of ``length_spans`` without outer blanks; the text as it is where it fits, where there is no limit or
    where it is blank."""
    if limit <= 0 or len(text) <= limit:
        return [text]
    return list(filter(None, (text[a:b].strip() for a, b in length_spans(text, limit)))) or [text]


@pandas_udf(ArrayType(StringType()))
def _parts_of(values: pd.Series, limits: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else split_by_length(t, int(n)) for t, n in zip(values, limits)])


def limited_parts(df: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """(key, part_no, part) by an Arrow function: the cut depends on the data behind it."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, no, part) for k, t in enumerate(batch.column(1).to_pylist()) if t is not None for no, part in enumerate(split_by_length(t, limit), 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r[0] for r in rows], pa.int32())), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], [key, "part_no", "part"])

    return spread(df.select(key, text), key).mapInArrow(run, f"`{key}` {kind}, part_no int, part string")


def read(spark: SparkSession, paths: list[str], level: int = 0, single: bool = False, max_chars: int = 0) -> DataFrame:
    """(source_path, chapter_index, title, text, group_path) of Markdown files, each read whole as UTF-8; the
    fallback title is the file's name without suffix."""
    importable(spark)
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("source_path"), "value", F.regexp_replace(F.url_decode(name), r"\.[^.]*$", "").alias("stem"))
    return chapters(files, ["source_path"], "value", "stem", level, single, max_chars).select("source_path", F.col("part_no").alias("chapter_index"), "title", "text", F.lit(None).cast("string").alias("group_path"))
