"""Queries of the training-data problems, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import table
from . import canonical, encoding, language, markup, packing, quality, samples, sentences, splitting, tokenizing


def chapters_and_chunks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Chapters and chunks as (rec_table, rec_id, *columns)."""
    parts = [table(spark, sf_dir, name).select(F.lit(name).alias("rec_table"), F.col(key).alias("rec_id"), *columns) for name, key in (("chapters", "chapter_id"), ("chunks", "chunk_id"))]
    return parts[0].unionByName(parts[1])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.find(chapters_and_chunks(spark, sf_dir, "text"), ["rec_table", "rec_id"], "text").distinct()


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean text and blocks of every chapter and chunk; a chunk delivered twice appears once."""
    return markup.convert(chapters_and_chunks(spark, sf_dir, "text"), ["rec_table", "rec_id"], "text", unique=True)


def _pieces(spark: SparkSession, sf_dir: str, with_text: bool) -> DataFrame:
    items = chapters_and_chunks(spark, sf_dir, "text", "limit_id")
    return splitting.split_rows(items, table(spark, sf_dir, "size_limits"), ["rec_table", "rec_id"], with_text=with_text)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that come out in more than one piece."""
    return _pieces(spark, sf_dir, False).where("piece_no = 2").select("rec_table", "rec_id")


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of oversized chapters and chunks; a chunk delivered twice gives them once."""
    return _pieces(spark, sf_dir, True)


def p2_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oversized texts put together again from their pieces, without what consecutive pieces share: the round trip that SQL
    can check."""
    each = p2_pieces(spark, sf_dir)
    before = F.lag("piece_end", 1, 0).over(Window.partitionBy("rec_table", "rec_id").orderBy("piece_no"))
    own = each.withColumn("_shared", (before - F.col("piece_start")).cast("int"))
    fresh = own.withColumn("_new", F.substring("piece", F.col("_shared") + 1, F.length("piece")))
    texts = fresh.groupBy("rec_table", "rec_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "_new"))), lambda s: s["_new"]), "").alias("text"), F.max(F.length("piece")).cast("long").alias("longest"))
    return texts.join(_limits_of(spark, sf_dir), ["rec_table", "rec_id"]).select("rec_table", "rec_id", "text", (F.col("longest") <= F.col("max_chars")).alias("within"))


def _limits_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapters_and_chunks(spark, sf_dir, "limit_id").distinct().join(table(spark, sf_dir, "size_limits"), "limit_id").select("rec_table", "rec_id", "max_chars")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "chapters").join(table(spark, sf_dir, "sentence_checks"), "chapter_id", "left_semi")
    return sentences.sentence_ends_of(asked, "chapter_id", "text", _abbreviations(spark, sf_dir))


def _abbreviations(spark: SparkSession, sf_dir: str) -> frozenset[str]:
    """Abbreviations that all chapters show; what a chunk holds is in its chapter."""
    return sentences.learned_abbreviations_of(table(spark, sf_dir, "chapters"), "chapter_id", "text")


def p3_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of every chapter and chunk; chunks delivered twice appear once."""
    return sentences.sentences_of(chapters_and_chunks(spark, sf_dir, "text"), ["rec_table", "rec_id"], "text", unique=True, learned=_abbreviations(spark, sf_dir))


def _language_models(spark: SparkSession, sf_dir: str) -> tuple[language.Model, encoding.Repairer]:
    texts = samples.training_texts(table(spark, sf_dir, "chapters"), table(spark, sf_dir, "sources"))
    common: dict[str, list[str]] = {}
    for lang, word in _common_words(spark, sf_dir):
        common.setdefault(lang, []).append(word)
    return language.train(texts, common), encoding.train(texts)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the narrow result meets the labels, so no text is shuffled and source 417 is no hot group."""
    model, repairer = _language_models(spark, sf_dir)
    spoken = language.sentence_languages(table(spark, sf_dir, "chapters"), ["chapter_id", "source_id"], "text", model, repairer)
    labels = table(spark, sf_dir, "sources").select("source_id", samples.labelled(F.col("language_tag")).alias("named"))
    return spoken.join(labels, "source_id", "left").where("named IS NULL OR named <> lang").select("chapter_id", "lang").distinct()


def p4_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of one language in every chapter."""
    model, repairer = _language_models(spark, sf_dir)
    return language.segments(table(spark, sf_dir, "chapters"), "chapter_id", "text", model, repairer)


def p4_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every source by the words of its chapters: confidence is the words' confidence times their
    share. A source without words has null and 0.0; ties go to the code that sorts first."""
    words = p4_segments(spark, sf_dir).groupBy("chapter_id", "lang").agg(F.sum("n_words").alias("n"), F.sum(F.col("n_words") * F.col("confidence")).alias("c"))
    of = table(spark, sf_dir, "chapters").select("chapter_id", "source_id")
    by = words.join(of, "chapter_id").groupBy("source_id", "lang").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    best = by.groupBy("source_id").agg(F.max_by(F.struct("lang", "c"), F.struct("n", F.expr("-ascii(lang)"), F.expr("-ascii(substr(lang, 2))"))).alias("b"), F.sum("n").alias("total"))
    out = best.select("source_id", F.col("b.lang").alias("lang"), F.round(F.col("b.c") / F.col("total"), 4).alias("confidence"))
    return table(spark, sf_dir, "sources").select("source_id", "language_tag").join(out, "source_id", "left").select("source_id", "language_tag", "lang", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def _scripts(spark: SparkSession, sf_dir: str) -> canonical.Scripts:
    """Bigram scores from all labelled chapters."""
    return canonical.train_on(samples.labelled_texts(table(spark, sf_dir, "chapters"), table(spark, sf_dir, "sources")), "chapter_id", "lang", "text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.look_alike_pairs(table(spark, sf_dir, "chapters"), "chapter_id", "source_id", ["title", "text"], _scripts(spark, sf_dir))


def p5_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and text of every chapter in their one form."""
    return canonical.canonical_texts(table(spark, sf_dir, "chapters"), ["chapter_id"], ["title", "text"], _scripts(spark, sf_dir))


def _text_repairer(spark: SparkSession, sf_dir: str) -> encoding.Repairer:
    """Dictionaries from all labelled chapters."""
    return encoding.train_on(samples.labelled_texts(table(spark, sf_dir, "chapters"), table(spark, sf_dir, "sources")), "chapter_id", "lang", "text")


def _name_repairer(spark: SparkSession, sf_dir: str) -> encoding.Repairer:
    """A dictionary from all authors."""
    return encoding.train_names_on(table(spark, sf_dir, "sources"), "source_id", "author")


def _restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_table, rec_id, restored, chains, garbled) of chapters' texts and sources' authors."""
    chapters = encoding.repair(table(spark, sf_dir, "chapters"), ["chapter_id"], "text", _text_repairer(spark, sf_dir))
    authors = encoding.repair(table(spark, sf_dir, "sources"), ["source_id"], "author", _name_repairer(spark, sf_dir), encoding.is_broken_name)
    return chapters.select(F.lit("chapters").alias("rec_table"), F.col("chapter_id").alias("rec_id"), "restored", "chains", "garbled").unionByName(
        authors.select(F.lit("sources").alias("rec_table"), F.col("source_id").alias("rec_id"), "restored", "chains", "garbled")
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _restored(spark, sf_dir).where("garbled").select("rec_table", "rec_id")


def p6_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The original text of every garbled record, as far as it can be restored, with the chains undone."""
    return _restored(spark, sf_dir).where("garbled").drop("garbled")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizing.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts again, from their ids alone."""
    return tokenizing.decode(p7_ids(spark, sf_dir), "doc_id", "ids")


def p7_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the spans of each text's tokens reach, and whether each begins where the one before ends, or within the
    character that both share."""
    coded = tokenizing.encode_with_offsets(table(spark, sf_dir, "documents"), "doc_id", "text")
    joined = F.zip_with(F.slice("starts", F.lit(2), F.greatest(F.size("starts") - 1, F.lit(0))), F.slice("ends", F.lit(1), F.greatest(F.size("ends") - 1, F.lit(0))), lambda a, b: (a == b) | (a == b - 1))
    return coded.select("doc_id", F.when(F.size("ends") > 0, F.element_at("ends", -1)).otherwise(F.lit(0)).cast("long").alias("chars"), (F.forall(joined, lambda x: x) & (F.coalesce(F.get("starts", F.lit(0)), F.lit(0)) == 0)).alias("gapless"))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizing.count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in containers of every kind."""
    return packing.pack(_sizes(spark, sf_dir), "doc_id", "n_tokens", table(spark, sf_dir, "containers"))


def p8_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document once, in containers of whichever kind wastes least."""
    return packing.pack(_sizes(spark, sf_dir), "doc_id", "n_tokens", table(spark, sf_dir, "containers"), joint=True)


def p8_room(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.unused_room(p8_containers(spark, sf_dir))


#: Rows that the fixed table of common words may have.
COMMON_WORDS = 100_000


def _common_words(spark: SparkSession, sf_dir: str) -> list[tuple[str, str]]:
    """(language, word) of the fixed table, a few hundred rows; a table above the bound is an error."""
    rows = table(spark, sf_dir, "common_words").where("word IS NOT NULL").select("lang", "word").distinct().limit(COMMON_WORDS + 1).collect()
    if len(rows) > COMMON_WORDS:
        raise ValueError(f"more than {COMMON_WORDS} common words")
    return [(r[0], r[1]) for r in rows]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_report(spark, sf_dir).where("doc_kind <> 'prose'").select("doc_id", "doc_kind")


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statistics and the kind of every document."""
    return quality.statistics(table(spark, sf_dir, "documents"), "doc_id", "text", [w for _, w in _common_words(spark, sf_dir)])


def p9_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics that SQL can express too."""
    return p9_report(spark, sf_dir).drop("ngram_coverage", "repeated_share", "doc_kind")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_clean": p1_clean,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p2_joined": p2_joined,
    "p3_found": p3_found,
    "p3_sentences": p3_sentences,
    "p4_found": p4_found,
    "p4_segments": p4_segments,
    "p4_sources": p4_sources,
    "p5_found": p5_found,
    "p5_normalized": p5_normalized,
    "p6_found": p6_found,
    "p6_restored": p6_restored,
    "p7_ids": p7_ids,
    "p7_decoded": p7_decoded,
    "p7_offsets": p7_offsets,
    "p8_containers": p8_containers,
    "p8_mixed": p8_mixed,
    "p8_room": p8_room,
    "p9_found": p9_found,
    "p9_report": p9_report,
    "p9_stats": p9_stats,
}
