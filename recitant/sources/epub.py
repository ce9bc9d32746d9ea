"""EPUB books to metadata, navigation and chapters.

Zip and XML have no built-in reader, so each book's bytes go through one Arrow function that emits flat rows;
joins of spine, manifest and contents happen inside a book, which is one row of the input.
"""

from __future__ import annotations

import html
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import GROUP_SEPARATOR
from ..tables import importable

SUFFIXES = [".epub"]
READABLE = (".xhtml", ".html", ".htm", ".xml")


_rules = [(re.compile("\r\n"), "\n"), (re.compile("[ \t]+"), " "), (re.compile("\n{3,}"), "\n\n")]


def plain(text: str | None) -> str:
    """Text by the rules of ``functions.text.clean_plain``."""
    out = html.unescape(text or "")
    for rule, put in _rules:
        out = rule.sub(put, out)
    return out.strip()


def _local(node: ET.Element, *names: str) -> ET.Element | None:
    """The first descendant with one of the names, the earlier name first, whatever its namespace."""
    for name in names:
        for found in node.iter():
            if isinstance(found.tag, str) and found is not node and found.tag.rpartition("}")[2] == name:
                return found
    return None


def _children(node: ET.Element, name: str) -> list[ET.Element]:
    return [x for x in node if isinstance(x.tag, str) and x.tag.rpartition("}")[2] == name]


class Book:
    """One EPUB file. ``stem`` is its title where it names none."""

    def __init__(self, content: bytes, stem: str):
        self.zip, self.stem = zipfile.ZipFile(io.BytesIO(content)), stem
        root = _local(ET.fromstring(self.zip.read("META-INF/container.xml")), "rootfile")
        if root is None:
            raise ValueError(f"no package in {stem}")
        self.package = root.attrib["full-path"]
        self.xml = ET.fromstring(self.zip.read(self.package))
        manifest = _local(self.xml, "manifest")
        self.items = _children(manifest, "item") if manifest is not None else []

    def path(self, href: str) -> str:
        return posixpath.normpath(posixpath.join(posixpath.dirname(self.package), href))

    @classmethod
    def metadata_of(cls, content: bytes, stem: str) -> dict[str, str | None]:
        """Metadata of a file, whose stem is the title where the package can't be found."""
        try:
            return cls(content, stem).metadata()
        except (ValueError, KeyError, ET.ParseError, zipfile.BadZipFile):
            return dict.fromkeys(("author", "publisher", "published_date", "language")) | {"source_title": stem}

    def metadata(self) -> dict[str, str | None]:
        node = _local(self.xml, "metadata")
        value = lambda name: next((plain(x.text) or None for x in _children(node, name)[:1]), None) if node is not None else None
        return {"source_title": value("title") or self.stem, "author": value("creator"), "publisher": value("publisher"), "published_date": value("date"), "language": value("language")}

    def navigation(self) -> list[dict]:
        """The contents, depth first: titles and places from the root, target file, whether it has children."""
        ncx = next((x for x in self.items if x.attrib.get("media-type") == "application/x-dtbncx+xml"), None)
        tree = _local(ET.fromstring(self.zip.read(self.path(ncx.attrib["href"]))), "navMap") if ncx is not None else None
        rows: list[dict] = []

        def walk(points: list[ET.Element], titles: list[str], places: list[int]) -> None:
            for place, point in enumerate(points, 1):
                label, target = _local(point, "text"), next(iter(_children(point, "content")), None)
                inner = _children(point, "navPoint")
                title = plain("".join(label.itertext())) if label is not None else "Untitled"
                href = self.path(target.attrib["src"].split("#", 1)[0]) if target is not None and "src" in target.attrib else None
                rows.append({"titles": [*titles, title], "places": [*places, place], "href": href, "has_children": bool(inner)})
                walk(inner, [*titles, title], [*places, place])

        if tree is not None:
            walk(_children(tree, "navPoint"), [], [])
        return rows

    def spine(self) -> list[str]:
        """Files of the readable spine items, in order."""
        files = {x.attrib["id"]: self.path(x.attrib["href"]) for x in self.items if {"id", "href"} <= x.attrib.keys()}
        spine = _local(self.xml, "spine")
        listed = [files.get(x.attrib.get("idref", "")) for x in _children(spine, "itemref")] if spine is not None else []
        return [x for x in listed if x and x.lower().endswith(READABLE)]

    def page(self, path: str) -> tuple[str, str] | None:
        """(own title or the file's stem, text) of a page; None for a broken one, one without body or without text."""
        try:
            page = ET.fromstring(self.zip.read(path))
        except (ET.ParseError, KeyError):
            return None
        body = _local(page, "body")
        text = plain("\n".join(body.itertext())) if body is not None else ""
        heads = (x for x in (_local(body, "h1", "h2"), _local(page, "title")) if x is not None) if text else ()
        own = next((plain(" ".join(x.itertext())) for x in heads), "")
        return (own or posixpath.splitext(posixpath.basename(path))[0], text) if text else None

    def chapters(self) -> Iterator[dict]:
        """Pages of the spine joined with the contents by file: the contents' title and group win over the page's own title,
        the last entry of a file over earlier ones."""
        entries = {row["href"]: row for row in self.navigation() if row["href"]}
        pages = ((path, self.page(path)) for path in self.spine())
        for path, title, text in ((path, *made) for path, made in pages if made):
            entry = entries.get(path, {"titles": [title], "has_children": False})
            above = entry["titles"] if entry["has_children"] else entry["titles"][:-1]
            yield {"title": entry["titles"][-1], "text": text, "group_path": GROUP_SEPARATOR.join(filter(None, map(str.strip, above))) or None}


_book = pa.schema(
    [(x, pa.string()) for x in ("source_path", "source_title", "author", "publisher", "published_date", "language")]
    + [
        ("chapters", pa.list_(pa.struct([("title", pa.string()), ("text", pa.string()), ("group_path", pa.string())]))),
        ("navigation", pa.list_(pa.struct([("titles", pa.list_(pa.string())), ("places", pa.list_(pa.int32())), ("href", pa.string()), ("has_children", pa.bool_())]))),
    ]
)
SCHEMA = (
    "source_path string, source_title string, author string, publisher string, published_date string, language string, "
    "chapters array<struct<title: string, text: string, group_path: string>>, navigation array<struct<titles: array<string>, places: array<int>, href: string, has_children: boolean>>"
)


def books(files: DataFrame) -> DataFrame:
    """One row per book from (path, content): metadata, chapters and navigation. A file that is no EPUB or
    has no readable chapter raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                book = Book(content, posixpath.splitext(posixpath.basename(path))[0])
                chapters = list(book.chapters())
                if not chapters:
                    raise ValueError(f"no readable chapter in {path}")
                yield pa.RecordBatch.from_pylist([{"source_path": path, **book.metadata(), "chapters": chapters, "navigation": book.navigation()}], schema=_book)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def chapters(read: DataFrame) -> DataFrame:
    return read.select("source_path", F.posexplode("chapters").alias("pos", "c")).select("source_path", (F.col("pos") + 1).alias("chapter_index"), "c.title", "c.text", "c.group_path")


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Books of EPUB files or folders (not their subfolders)."""
    importable(spark)
    return books(spark.read.format("binaryFile").option("pathGlobFilter", "*.{epub,EPUB}").load(paths))


def archive(title: str, pages: list[tuple[str, str]]) -> bytes:
    """A small valid EPUB of (title, text) pages, for round trips."""
    escape = html.escape
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>')
        items = "".join(f'<item id="p{k}" href="p{k}.xhtml" media-type="application/xhtml+xml"/>' for k in range(len(pages)))
        spine = "".join(f'<itemref idref="p{k}"/>' for k in range(len(pages)))
        points = "".join(f"<navPoint><navLabel><text>{escape(t)}</text></navLabel><content src='p{k}.xhtml#top'/></navPoint>" for k, (t, _) in enumerate(pages))
        z.writestr("OPS/book.opf", f'<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>{escape(title)}</dc:title></metadata><manifest><item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/>{items}</manifest><spine>{spine}</spine></package>')
        z.writestr("OPS/toc.ncx", f"<ncx><navMap><navPoint><navLabel><text>{escape(title)}</text></navLabel>{points}</navPoint></navMap></ncx>")
        for k, (t, text) in enumerate(pages):
            z.writestr(f"OPS/p{k}.xhtml", f"<html><body><h1>{escape(t)}</h1><p>{escape(text)}</p></body></html>")
    return out.getvalue()


def archives(books: DataFrame) -> DataFrame:
    """(path, content) of books made from (title, pages array<struct<title, text>>), whatever the two columns' names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(f"{title}.epub", archive(title, [(p["title"], p["text"]) for p in pages])) for title, pages in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in made], pa.string()), pa.array([x for _, x in made], pa.binary())], ["path", "content"])

    return books.mapInArrow(run, "path string, content binary")
