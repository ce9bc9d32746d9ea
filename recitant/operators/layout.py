"""Numbers, groups and output folders of chapters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, file_component, group_parts, group_path, is_blank, slug
from .ranks import with_rank, with_sum_before


def summaries(chapters: DataFrame) -> DataFrame:
    """Per chapter: characters, words and the first 20 words. Null texts count as empty."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(collapse(text), " "), lambda x: x != "")
    return chapters.select("chapter_id", "title", "group_path", F.length(text).cast("long").alias("chars"), F.size(words).cast("long").alias("words"), F.array_join(F.slice(words, 1, 20), " ").alias("preview"))


def spoken(chapters: DataFrame) -> DataFrame:
    """Chapters that have text."""
    return chapters.where(F.col("text").isNotNull() & ~is_blank(F.col("text")))


def numbered(chapters: DataFrame) -> DataFrame:
    """The chapters that have text with their 1-based place within the source and within the source's group (null is a group
    of its own); chapters without text are dropped before they are counted.

    Keys only are sorted, not texts: callers join the numbers to the texts where they need both.
    """
    keys = spoken(chapters).select("chapter_id", "source_id", "chapter_index", "group_path")
    placed = with_rank(keys, ["source_id"], "chapter_index", "chapter_id", "place")
    return with_rank(placed, ["source_id", "group_path"], "chapter_index", "chapter_id", "number_in_group")


def group_directories(chapters: DataFrame) -> DataFrame:
    """(source_id, group_path, directory): each level's place among its siblings, by first appearance, and its
    slug.

    Groups are first reduced to one row each, so the windows over siblings see groups, not chapters; the path
    is put together again from its levels without a join on text.
    """
    first = chapters.where("group_path IS NOT NULL AND group_path <> ''").groupBy("source_id", "group_path").agg(F.min(F.struct("chapter_index", "chapter_id")).alias("seen"))
    levels = first.select("source_id", "group_path", "seen", group_parts(F.col("group_path")).alias("parts")).where(F.size("parts") > 0)
    nodes = levels.select("source_id", "group_path", "seen", "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth")).select(
        "source_id", "group_path", "seen", "depth", F.array_join(F.slice("parts", F.lit(1), F.col("depth") - 1), " / ").alias("parent"), F.element_at("parts", F.col("depth")).alias("name")
    )
    siblings = nodes.groupBy("source_id", "parent", "depth", "name").agg(F.min("seen").alias("seen"))
    placed = siblings.withColumn("place", F.row_number().over(Window.partitionBy("source_id", "parent", "depth").orderBy("seen"))).drop("seen")
    named = nodes.join(placed, ["source_id", "parent", "depth", "name"]).withColumn("folder", F.format_string("%02d-%s", "place", slug(F.col("name"))))
    return named.groupBy("source_id", "group_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "folder"))), lambda s: s["folder"]), "/").alias("directory"))


def grouped_titles(chapters: DataFrame) -> DataFrame:
    """(source_id, group_path, n_titles, first_titles): the first ten titles of each group in order."""
    ranked = with_rank(chapters.select("source_id", "group_path", "chapter_index", "chapter_id", "title"), ["source_id", "group_path"], "chapter_index", "chapter_id", "rank")
    kept = F.when(F.col("rank") <= 10, F.struct("rank", F.coalesce("title", F.lit("")).alias("title")))
    return ranked.groupBy("source_id", "group_path").agg(
        F.count("*").alias("n_titles"), F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda s: s["title"]), "; ").alias("first_titles")
    )


def chunk_offsets(chunks: DataFrame) -> DataFrame:
    """(source_id, chapter_id, n_chunks, first_chunk): exclusive prefix sums over a source's chapters. Chunks
    delivered twice count once."""
    own = chunks.select("chunk_id", "source_id", "chapter_id", "chunk_index").dropDuplicates(["chunk_id"])
    per = own.groupBy("source_id", "chapter_id").agg(F.count("*").alias("n_chunks"), F.min("chunk_index").alias("at"))
    placed = with_sum_before(per, ["source_id"], "at", "chapter_id", "n_chunks", "before")
    return placed.select("source_id", "chapter_id", "n_chunks", (F.col("before") + 1).alias("first_chunk"))


def navigation_directories(nodes: DataFrame, selected: DataFrame) -> DataFrame:
    """(group_path, directory) of the selected groups in a navigation tree. ``nodes`` has path array<string>,
    places array<int> and has_children; a leaf's group lies in its parent's folder."""
    levels = nodes.join(selected.select("group_path").distinct(), group_path(F.col("path")) == F.col("group_path"), "left_semi").select(
        group_path(F.col("path")).alias("group_path"), "has_children", F.posexplode(F.arrays_zip("places", "path")).alias("depth", "level")
    )
    named = levels.select("group_path", "has_children", "depth", F.format_string("%02d-%s", F.col("level.places"), file_component(F.col("level.path"))).alias("folder"))
    folders = named.groupBy("group_path", "has_children").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "folder"))), lambda s: s["folder"]).alias("f"))
    return folders.select("group_path", F.array_join(F.when(F.col("has_children"), F.col("f")).otherwise(F.slice("f", F.lit(1), F.size("f") - 1)), "/").alias("directory"))
