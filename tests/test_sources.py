import io
import zipfile

import pytest

from recitant.sources import epub, markdown


def chapters(spark, text, level=0):
    df = spark.createDataFrame([(1, text, "Fallback")], "k int, v string, f string")
    return [(r.title, r.text) for r in markdown.chapters(df, ["k"], "v", "f", level).orderBy("part_no").collect()]


def test_markdown_levels(spark):
    assert chapters(spark, "# One\nA\n\n# Two\nB\n\n# Three\nC") == [("One", "A"), ("Two", "B"), ("Three", "C")]
    assert [t for t, _ in chapters(spark, "# Book\nintro\n## A\nx\n## B\ny")] == ["Book", "A", "B"]
    assert [t for t, _ in chapters(spark, "# P\n## C1\na\n### s\nb\n## C2\nc", 1)] == ["P"]
    assert chapters(spark, "no heading") == [("Fallback", "no heading")]
    assert chapters(spark, "# only a heading") == [("Fallback", "only a heading")]
    with pytest.raises(ValueError):
        chapters(spark, "x", 5)


def test_limit_split():
    text = ("Sentence. " * 20 + "\n\n") * 5
    parts = markdown.split_by_length(text, 300)
    assert all(len(p) <= 300 for p in parts) and "".join("".join(parts).split()) == "".join(text.split())
    assert markdown.split_by_length("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]
    assert markdown.split_by_length("", 10) == [""]


def test_markdown_files(spark, tmp_path):
    (tmp_path / "my book.md").write_text("# One\nA\n\n# Two\nB", encoding="utf-8")
    rows = markdown.read(spark, [str(tmp_path)]).orderBy("chapter_index").collect()
    assert [(r.chapter_index, r.title, r.text) for r in rows] == [(1, "One", "A"), (2, "Two", "B")]


def test_epub_round_trip(spark, tmp_path):
    (tmp_path / "b.epub").write_bytes(epub.archive("Book", [("First & last", "One < two"), ("Second", "Text")]))
    book = epub.read(spark, [str(tmp_path)])
    rows = epub.chapters(book).orderBy("chapter_index").collect()
    assert [(r.title, r.text, r.group_path) for r in rows] == [("First & last", "First & last\nOne < two", "Book"), ("Second", "Second\nText", "Book")]
    head = book.first()
    assert head.source_title == "Book" and head.author is None
    assert [(n.titles, n.has_children) for n in head.navigation] == [(["Book"], True), (["Book", "First & last"], False), (["Book", "Second"], False)]


def test_broken_pages_are_passed_over():
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(epub.archive("Book", [("A", "a"), ("B", "b")]))) as old, zipfile.ZipFile(out, "w") as new:
        for name in old.namelist():
            new.writestr(name, b"<html><body>" if name.endswith("p0.xhtml") else old.read(name))
    assert [c["title"] for c in epub.Book(out.getvalue(), "x").chapters()] == ["B"]
