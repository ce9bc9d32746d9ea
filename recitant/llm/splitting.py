"""Problem 2: items above a size limit as ordered, overlapping pieces, cut at natural boundaries.

The unit of work is a range of bytes, never a text. Oversized texts are written once, end to end, to files in the folder
that all executors share; from there on only narrow rows are shuffled. A worker reads a range with halos, finds the
range's anchor (the first natural boundary from its start on) and the next range's anchor, and lists the pieces between
the two as offsets. Both neighbours find the same anchor from the same bytes, so ranges need nothing from each other. The
boundary tables of a text are stitched by prefix sums over its ranges, which give numbers and offsets over the whole
text, and pieces are then read by their byte offsets. No task holds more than a range, its halos and one piece.

A piece has at most ``max_chars`` code points. A cut is the last paragraph end in the second half of the
window, else the last sentence end, line end, blank, else ``max_chars`` itself (moved so as not to part a
combining mark from its letter). Each piece after the first begins ``overlap_chars`` before the last one's
end, so a text is its first piece plus all others without their first ``overlap_chars``. The halo in which an anchor is
looked for is doubled until it holds a boundary; where a whole range holds none, the anchor is the range's start, moved off
combining marks.

Defined results: null texts, unknown or null limits and texts at the limit give no piece; rows delivered
twice give their pieces once; an overlap of half the limit or more is taken as just under half of it; bytes that are no
UTF-8 count as one code point each and come out as U+FFFD.
"""

from __future__ import annotations

import atexit
import re
import unicodedata
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import bounded_broadcast, cut, shared_folder
from .sentences import sentence_ends

#: Bytes of a range, and of the first halo in which an anchor is looked for.
RANGE = 1 << 20
HALO = 1 << 14
#: Bytes that lie side by side in a file and are worked on by one task.
SIDE_BY_SIDE = 1 << 22

_paragraph = re.compile(r"\n[^\S\n]*\n\s*")
_line = re.compile(r"\r\n|[\r\n]")
_blank = re.compile(r"\s+")


def off_marks(text: str, at: int, least: int = 0) -> int:
    """The last place from ``at`` backwards, not before ``least``, that parts no combining mark or joiner from its letter."""
    while at > least and at < len(text) and (unicodedata.combining(text[at]) or unicodedata.category(text[at]) in ("Mn", "Mc", "Me") or text[at] in "\u200d\ufe0f"):
        at -= 1
    return at


def anchor(halo: str) -> int | None:
    """Offset of the first natural boundary in a halo: paragraph, else line, else blank; None without any."""
    for rule in (_paragraph, _line, _blank):
        if (found := rule.search(halo)) and found.end() < len(halo):
            return found.end()
    return None


def cut_points(text: str, size: int, overlap: int, lead: int = 0) -> list[int]:
    """Ends of the pieces of ``text``. The first piece begins ``lead`` code points before the text."""
    overlap = max(0, min(overlap, (size - 1) // 2))
    ranks = [[m.start() for m in _paragraph.finditer(text)], None, None, None]
    ends, begin, n = [], -lead, len(text)
    while n - begin > size:
        low, high, cut = max(begin + size // 2, begin + overlap, 0), begin + size, 0
        for rank in range(4):
            if ranks[rank] is None:
                ranks[rank] = sentence_ends([text])[0] if rank == 1 else [m.end() if rank == 3 else m.start() for m in (_line if rank == 2 else _blank).finditer(text)]
            at = bisect_right(ranks[rank], high) - 1
            if at >= 0 and ranks[rank][at] > low:
                cut = ranks[rank][at]
                break
        else:
            cut = off_marks(text, high, low + 1)
        ends.append(cut)
        begin = cut - overlap
    if n > (ends[-1] if ends else 0):
        ends.append(n)
    return ends


def decoded(raw: bytes) -> str:
    """Bytes as text; each byte that is no UTF-8 is a code point of its own, which ``encoded`` turns back."""
    return raw.decode("utf-8", "surrogateescape")


def encoded(text: str) -> bytes:
    return text.encode("utf-8", "surrogateescape")


class Item:
    """A text of ``size`` bytes that lies in an open file from byte ``at`` on."""

    def __init__(self, file, at: int, size: int, span: int, halo: int):
        self.file, self.at, self.size, self.span, self.halo = file, at, size, span, halo

    def read(self, begin: int, end: int) -> bytes:
        begin, end = max(0, begin), min(self.size, end)
        return self.file.read_at(end - begin, self.at + begin) if end > begin else b""

    def aligned(self, begin: int) -> int:
        """The byte where a range that begins at ``begin`` really begins."""
        if begin <= 0 or begin >= self.size:
            return max(0, min(begin, self.size))
        window = min(self.halo, self.span)
        while True:
            raw = self.read(begin, begin + window)
            skip = 0
            while skip < min(4, len(raw)) and raw[skip] & 0xC0 == 0x80:
                skip += 1
            halo = raw[skip:].decode("utf-8", "ignore") if begin + window < self.size else decoded(raw[skip:])
            if (found := anchor(halo)) is not None:
                return begin + skip + len(encoded(halo[:found]))
            if window >= self.span or begin + window >= self.size:
                back = decoded(self.read(begin + skip - 64, begin + skip + 64)[4:])  # whole characters around the start
                before = len(decoded(self.read(begin + skip - 60, begin + skip))) if begin + skip >= 64 else 0
                return begin + skip - (len(encoded(back[off_marks(back, before) : before])) if before else 0)
            window = min(self.span, window * 2)

    def range(self, number: int, size: int, overlap: int) -> tuple[int, list[dict[str, int]]]:
        """(code points of a range, its pieces): a piece is its begin and end in code points from the range's begin and in
        bytes of the file. The first piece of all but the first range begins in the range before."""
        begin, end = self.aligned(number * self.span), self.aligned((number + 1) * self.span)
        if end <= begin:
            return 0, []
        text = decoded(self.read(begin, end))
        raw = self.read(begin - 4 * overlap, begin)
        skip = next((k for k in range(min(4, len(raw))) if raw[k] & 0xC0 != 0x80), 0) if begin > 4 * overlap else 0
        before = decoded(raw[skip:])
        before = before[len(before) - min(overlap, len(before)) :] if overlap else ""
        joined, lead = before + text, len(before)
        spans, last = [], -lead
        for stop in cut_points(text, size, overlap, lead):
            spans.append((last, stop))
            last = stop - overlap
        places = sorted({x for pair in spans for x in pair})
        byte, done, at = {}, -lead, self.at + begin - len(encoded(before))
        for place in places:
            at += len(encoded(joined[done + lead : place + lead]))
            byte[place], done = at, place
        return len(text), [{"a": a, "b": b, "from": byte[a], "to": byte[b]} for a, b in spans]


def located(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or address, and the path there. Local names are taken as they are, without escapes."""
    if path.startswith(("file:", "/")):
        return arrow_fs.LocalFileSystem(), re.sub("^(?:file:)?/+", "/", path)
    return arrow_fs.FileSystem.from_uri(path)


class Files:
    """Opens files by their address once in a row."""

    def __init__(self):
        self.path, self.file = None, None

    def __call__(self, path: str):
        if path != self.path:
            self.close()
            where, name = located(path)
            self.path, self.file = path, where.open_input_file(name)
        return self.file

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def written(df: DataFrame, keys: list[str], text: str, more: list[str]) -> DataFrame:
    """(*keys, *more, path, at long, bytes long): texts written end to end to files of the shared folder, one a task. The
    rows are checkpointed, so that the files are written once; a repeated task writes a file of its own. The folder is
    removed when the driver ends."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/texts-{uuid.uuid4().hex}"
    kinds, width = dict(df.dtypes), len(keys) + len(more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = located(folder)
        name, out, at = f"{uuid.uuid4().hex}.txt", None, 0
        try:
            for batch in batches:
                starts, sizes = [], []
                for value in batch.column(width).cast(pa.binary()).to_pylist():
                    if out is None:
                        where.create_dir(base, recursive=True)
                        out = where.open_output_stream(f"{base}/{name}")
                    out.write(value)
                    starts.append(at)
                    sizes.append(len(value))
                    at += len(value)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(width)), pa.array([f"{folder}/{name}"] * len(starts), pa.string()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], [*keys, *more, "path", "at", "bytes"])
        finally:
            if out is not None:
                out.close()

    def remove() -> None:
        try:
            where, base = located(folder)
            where.delete_dir(base)
        except (OSError, pa.ArrowException):
            pass

    atexit.register(remove)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, *more]) + ", path string, at long, bytes long"
    return cut(df.select(*keys, *more, text).mapInArrow(run, schema))


def side_by_side(df: DataFrame, at: str, tasks: int) -> DataFrame:
    """Rows that point into files, such that a task reads what lies together, in order."""
    return df.repartition(tasks, "path", F.floor(F.col(at) / SIDE_BY_SIDE)).sortWithinPartitions("path", at)


def pieces(items: DataFrame, keys: list[str], with_text: bool, span: int = RANGE, halo: int = HALO) -> DataFrame:
    """(*keys, piece_no long, n_pieces long, piece_start long, piece_end long[, piece]) of texts in files that all executors
    share: ``items`` has *keys, path, at, bytes, _max, _overlap. Texts at their limit give none."""
    spark, kinds = items.sparkSession, dict(items.dtypes)
    total = items.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // (1 << 27)))
    ranges = items.select(*keys, "path", "at", "bytes", "_max", "_overlap", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("bytes") - 1) / span)).cast("int"))).alias("range_no"))
    ranges = side_by_side(ranges.withColumn("_from", F.col("at") + F.col("range_no").cast("long") * span), "_from", tasks)
    width = len(keys)
    piece = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("from", pa.int64()), ("to", pa.int64())])

    def tabled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files()
        for batch in batches:
            chars, found = [], []
            for path, at, size, most, overlap, no in zip(*(batch.column(width + c).to_pylist() for c in range(6))):
                n, spans = Item(files(path), at, size, span, halo).range(no, most, max(0, min(overlap, (most - 1) // 2)))
                chars.append(n)
                found.append(spans)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in range(width)), batch.column(width), batch.column(width + 3), batch.column(width + 5), pa.array(chars, pa.int64()), pa.array(found, pa.list_(piece))],
                [*keys, "path", "_max", "range_no", "chars", "spans"],
            )
        files.close()

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    tables = ranges.select(*keys, "path", "at", "bytes", F.col("_max").cast("int"), F.col("_overlap").cast("int"), "range_no").mapInArrow(
        tabled, schema + ", path string, _max int, range_no int, chars long, spans array<struct<a: long, b: long, `from`: long, `to`: long>>"
    )
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    stitched = tables.select(
        *keys, "path", "_max", "spans", F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("_base"), F.coalesce(F.sum(F.size("spans")).over(before), F.lit(0)).alias("_before"),
        F.sum("chars").over(whole).alias("_total"), F.sum(F.size("spans")).over(whole).alias("n_pieces"),
    ).where("_total > _max")
    numbered = stitched.select(*keys, "path", "n_pieces", "_base", "_before", F.posexplode("spans").alias("_pos", "_p")).select(
        *keys, (F.col("_before") + F.col("_pos") + 1).alias("piece_no"), "n_pieces", (F.col("_base") + F.col("_p.a")).alias("piece_start"), (F.col("_base") + F.col("_p.b")).alias("piece_end"),
        "path", F.col("_p.from").alias("_from"), F.col("_p.to").alias("_to"),
    )
    names = [*keys, "piece_no", "n_pieces", "piece_start", "piece_end"]
    if not with_text:
        return numbered.select(*names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files()
        for batch in batches:
            texts = []
            for path, begin, end in zip(*(batch.column(len(names) + c).to_pylist() for c in range(3))):
                texts.append(re.sub("[\ud800-\udfff]", "\ufffd", decoded(files(path).read_at(end - begin, begin))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(names))), pa.array(texts, pa.string())], [*names, "piece"])
        files.close()

    return side_by_side(numbered, "_from", tasks).select(*names, "path", "_from", "_to").mapInArrow(read, schema + ", piece_no long, n_pieces long, piece_start long, piece_end long, piece string")


def split_rows(df: DataFrame, limits: DataFrame, keys: list[str], text: str = "text", limit: str = "limit_id", with_text: bool = True) -> DataFrame:
    """``pieces`` of all rows longer than their limit, each key once. ``limits`` has limit_id, max_chars, overlap_chars."""
    small = limits.select(F.col("limit_id").alias(limit), F.col("max_chars").alias("_max"), F.col("overlap_chars").alias("_overlap")).where("_max > 0").dropDuplicates([limit])
    oversized = (
        df.select(*keys, text, limit)
        .join(bounded_broadcast(small, 10_000), limit)
        .where(F.length(text) > F.col("_max"))
        .select(*keys, F.col(text).alias("_text"), "_max", F.coalesce("_overlap", F.lit(0)).alias("_overlap"))
    )
    return pieces(written(oversized, keys, "_text", ["_max", "_overlap"]).dropDuplicates(keys), keys, with_text)


def split_files(spark: SparkSession, paths: list[str], size: int, overlap: int, span: int = RANGE, halo: int = HALO) -> DataFrame:
    """``pieces`` of UTF-8 files on a file system that all executors share, by path."""
    files = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file"), "path", F.col("length").alias("bytes"))
    items = files.select("file", "path", F.lit(0).cast("long").alias("at"), "bytes", F.lit(size).alias("_max"), F.lit(overlap).alias("_overlap"))
    return pieces(items, ["file"], True, span, halo).withColumnRenamed("file", "path")
