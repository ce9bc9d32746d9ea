from pyspark.sql import functions as F

from recitant.functions import text


def values(spark, expression, *rows, schema="v string"):
    return [r[0] for r in spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema).select(expression).collect()]


def test_names(spark):
    v = F.col("v")
    assert values(spark, text.slug(v), " The Café’s Menu! ", "???", None) == ["the-caf-s-menu", "document", None]
    assert values(spark, text.file_component(v), "A: b/c  d &amp; e.", "...", "x-y", None) == ["A - b - c d & e", "Document", "x - y", None]
    assert values(spark, text.group_leaf(v), "Book / Part", None, "") == ["Part", "Chapter", "Chapter"]
    assert values(spark, text.group_path(text.group_parts(v)), " a /  / b ", None) == ["a / b", None]
    assert values(spark, text.repair_title(v), "12 - Chapter One: The “End”", "Title Page - X") == ["theend", "x"]
    assert values(spark, text.is_short_section(v), "Table of Contents", "The Mapmaker", "Prose") == [True, True, False]


def test_cleaning(spark):
    v = F.col("v")
    assert values(spark, text.clean_plain(v), "a&amp;b\r\n\r\n\r\n\r\nc \t d ") == ["a&b\n\nc d"]
    md = "---\ntitle: x\n---\n# Head *one*\n\n- item `code`\n| a | b |\n|---|---|\n![i](u) [l](u) <b>t</b>\n```\nx\n```\n> q_r\n1. n"
    assert values(spark, text.clean_markdown(v), md) == ["Head one\n\nitem code\na b\nl t\n\nq r\nn"]


def test_numbers(spark):
    assert values(spark, text.clock(F.col("v")), 59.9, 3600.0, 3725.0, -5.0, schema="v double") == ["0m59s", "1h00m", "1h02m", "0m00s"]
    assert values(spark, text.track_number(F.col("v"), F.lit(7)), "04-x", "x") == [4, 7]


def test_part_names(spark):
    schema = "base string, part int, multi boolean, stem string, leaf string, numbered boolean"
    e = text.part_name(F.col("base"), F.col("part"), F.col("multi"), F.col("stem"), F.col("leaf"), F.col("numbered"))
    rows = [
        ("b", 1, False, None, "leaf", False),
        ("b", 1, False, "04 - Section Alpha", "leaf", True),
        ("04-Section Alpha", 2, True, "04-Section Alpha", "leaf", False),
        ("book", 3, True, None, "leaf", False),
    ]
    assert values(spark, e, *rows, schema=schema) == ["leaf", "04-01 - Section Alpha", "04-02 - Section Alpha", "03-book"]


def test_providers(spark):
    available, wanted = F.split("v", ","), text.provider_list(F.col("w"))
    rows = [("CPUExecutionProvider", "CUDAExecutionProvider"), ("CUDAExecutionProvider,CPUExecutionProvider", ""), ("Other", "Missing")]
    assert values(spark, text.resolve_provider(available, wanted), *rows, schema="v string, w string") == ["CPUExecutionProvider", "CUDAExecutionProvider", "Other"]
