"""From chunks to sounding parts: samples, silence, packing into parts, manifests."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import group_leaf
from ..tables import spread

# Default sample rate, silence and part length.
RATE, SILENCE_MS, PART_MINUTES = 24_000, 250, 30


def padded(samples: Column, last: Column, rate: int = RATE, silence_ms: int = SILENCE_MS) -> Column:
    """Samples of a chunk with the silence that follows all but a chapter's last."""
    return samples + F.when(last, F.lit(0)).otherwise(F.lit(int(rate * silence_ms / 1000)))


def part_limit(rate: int = RATE, minutes: float = PART_MINUTES) -> int:
    return max(1, int(rate * minutes * 60))


def packed_parts(chunks: DataFrame, keys: list[str], limit: int, group: str | None = None, title: str | None = None) -> DataFrame:
    """(*keys, part_no, start_chunk, end_chunk, samples[, group][, chapter_titles]): chunks in order, a part closed once
    it has reached the limit. With ``group`` a part is closed, too, where the group changes, and its parts are numbered
    from 1 anew; else a part may go on into the next chapter. ``title`` is listed in runs.

    ``chunks`` has *keys, chunk_index and samples. The fold over a key value sees numbers and group names alone and
    keeps where parts begin; a key is one chapter's job or one book, whose length does not grow with the corpus.
    """
    held = [F.col("chunk_index").cast("long").alias("c"), F.col("samples").cast("long").alias("n"), (F.col(group) if group else F.lit(None)).cast("string").alias("g"), (F.col(title) if title else F.lit(None)).cast("string").alias("t")]
    ordered = chunks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*held))).alias("_all"))
    start = F.struct(F.array().cast("array<struct<at: int, no: bigint>>").alias("begins"), F.lit(0).cast("long").alias("no"), F.lit(limit).cast("long").alias("used"), F.lit(None).cast("string").alias("g"))

    def step(s: Column, x: Column) -> Column:
        changed = ~s["g"].eqNullSafe(x["x"]["g"])
        no = F.when(changed, F.lit(1).cast("long")).otherwise(s["no"] + 1)
        opened = F.struct(F.concat(s["begins"], F.array(F.struct(x["at"].alias("at"), no.alias("no")))).alias("begins"), no.alias("no"), x["x"]["n"].alias("used"), x["x"]["g"].alias("g"))
        return F.when((s["used"] >= limit) | changed, opened).otherwise(F.struct(s["begins"].alias("begins"), s["no"].alias("no"), (s["used"] + x["x"]["n"]).alias("used"), s["g"].alias("g")))

    begun = ordered.withColumn("_begins", F.aggregate(F.transform("_all", lambda x, k: F.struct(k.alias("at"), x.alias("x"))), start, step, lambda s: s["begins"]))
    end = lambda k: F.coalesce(F.get(F.col("_begins"), k + 1)["at"], F.size("_all"))
    parts = begun.select(*keys, F.explode(F.transform("_begins", lambda b, k: F.struct(b["no"].alias("no"), F.slice("_all", b["at"] + 1, end(k) - b["at"]).alias("own")))).alias("_p")).select(*keys, F.col("_p.no").alias("part_no"), F.col("_p.own").alias("_own"))
    own = F.col("_own")
    more = [F.get(own, F.lit(0))["g"].alias("group")] if group else []
    made = parts.withColumn("_titles", F.transform(own, lambda x: x["t"])) if title else parts
    return made.select(
        *keys, "part_no", F.get(own, F.lit(0))["c"].alias("start_chunk"), F.element_at(own, -1)["c"].alias("end_chunk"), F.aggregate(own, F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("samples"),
        *more, *([title_runs(F.col("_titles")).alias("chapter_titles")] if title else []),
    )


def title_runs(titles: Column) -> Column:
    """Titles in order, each run of the same title once. ``titles`` must be a column, as it is read by place."""
    return F.filter(titles, lambda x, k: (k == 0) | ~x.eqNullSafe(F.get(titles, k - 1)))


def heading_runs(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, headings array<string>): the headings of a job's chunks in order, runs once; null counts as none."""
    own = chunks.select("chunk_id", *keys, "chunk_index", F.coalesce("heading", F.lit("")).alias("heading")).dropDuplicates(["chunk_id"])
    listed = own.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "heading"))), lambda s: s["heading"]).alias("_all"))
    return listed.select(*keys, title_runs(F.col("_all")).alias("headings"))


def manifests(parts: DataFrame) -> DataFrame:
    """(job_id, part_count, chunk_count, duration_seconds, parts array<struct>): one nested row per job."""
    part = F.struct(F.col("part_no").alias("part"), "wav_path", "mp3_path", "duration_seconds", F.col("group_path").alias("group"), "start_chunk", "end_chunk")
    return parts.groupBy("job_id").agg(
        F.count("*").alias("part_count"), (F.max("end_chunk") - F.min("start_chunk") + 1).cast("long").alias("chunk_count"),
        F.sum("duration_seconds").alias("duration_seconds"), F.array_sort(F.collect_list(part)).alias("parts"),
    )


def manifest_chunks(chunks: DataFrame, keys: list[str], title: str) -> DataFrame:
    """(*keys, chunks array<struct<index, heading, chapter, chars, text>>): the chunks of a manifest in order; a chunk delivered
    twice counts once. One row holds the text of one chapter or book, as its manifest does."""
    own = chunks.select("chunk_id", *keys, "chunk_index", "heading", title, "text").dropDuplicates(["chunk_id"])
    chunk = F.struct(F.col("chunk_index").cast("long").alias("index"), F.col("chunk_id").alias("_id"), "heading", F.col(title).alias("chapter"), F.length("text").cast("long").alias("chars"), "text")
    return own.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(chunk)), lambda c: c.dropFields("_id")).alias("chunks"))


def tags(title: Column, track: Column, source_title: Column, author: Column, publisher: Column, date: Column, group: Column) -> Column:
    """The tags of a sound file: the album is the last level of the group, without one the source; empty values give none."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.struct(
        title.alias("title"), track.cast("string").alias("tracknumber"), F.when(some(group).isNotNull(), group_leaf(group)).otherwise(source_title).alias("album"), some(author).alias("artist"), some(author).alias("albumartist"),
        some(date).alias("date"), some(source_title).alias("comment"), some(publisher).alias("publisher"),
    )


def interleaved(channels: Column) -> Column:
    """array<array<double>> of equally long channels as one 16-bit array, sample by sample."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.size(F.get(channels, F.lit(0))), F.lit(1)) - 1), lambda k: F.filter(F.transform(channels, lambda c: F.get(pcm16(c), k)), lambda x: x.isNotNull())))


def chunk_files(chunks: DataFrame) -> DataFrame:
    """(name, samples, sample_rate) of chunks that are kept as files of their own, named by their number; ``audio.write`` writes
    them. ``chunks`` has chunk_index, samples and sample_rate."""
    return chunks.select(F.format_string("chunks/%04d", "chunk_index").alias("name"), "samples", "sample_rate")


def write_manifests(manifest: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, one manifest each; an existing target is an error unless overwriting is asked for."""
    manifest.write.mode(mode).json(path)


def pcm16(samples: Column) -> Column:
    """Floats in -1 to 1, clipped, as 16-bit integers cut towards zero."""
    return F.transform(samples, lambda x: (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) * 32767).cast("int"))


def trimmed(samples: Column, rate: int, threshold: float = 0.003, padding_ms: int = 40) -> Column:
    """From the first to the last sample louder than the threshold, with padding; silence stays whole."""
    loud = F.filter(F.transform(samples, lambda x, k: F.when(F.abs(x) > threshold, k)), lambda k: k.isNotNull())
    pad = int(rate * padding_ms / 1000)
    first, last = F.greatest(F.get(loud, F.lit(0)) - pad, F.lit(0)), F.least(F.element_at(loud, -1) + pad + 1, F.size(samples))
    return F.when(F.size(loud) == 0, samples).otherwise(F.slice(samples, first + 1, last - first))


Synthesis = Callable[[str], tuple[np.ndarray, int]]


def stub(text: str) -> tuple[np.ndarray, int]:
    """Stands in for a voice: silence as long as the text."""
    return np.zeros(1600 * len(text), dtype=np.float32), RATE


#: A text that fails is halved so often, and no further below this length.
HALVINGS, LEAST_CHARS = 8, 20
_between = re.compile(r"(?<=[.!?]) (?=[A-Z0-9\"'])")


def halves_of(text: str) -> list[str]:
    """Both halves of a text that failed: by sentences, else by words, else by code points; empty ones go. The column
    form is ``chunking.retry_halves``."""
    flat = " ".join(text.split())
    units, joint = next(((u, " ") for u in (_between.split(flat), flat.split(" ")) if len(u) > 1), (list(text), ""))
    middle = max(1, len(units) // 2)
    return [h for h in (joint.join(units[:middle]).strip(), joint.join(units[middle:]).strip()) if h]


def is_too_large(error: Exception) -> bool:
    """Whether a voice failed for a text's size, so that halves may do."""
    # What such errors say.
    said = f"{type(error).__name__} {error}".lower()
    return isinstance(error, IndexError) or any(x in said for x in ("bad allocation", "onnxruntimeerror", "arraymemoryerror", "unable to allocate"))


def synthesize(voice: Synthesis, text: str) -> tuple[np.ndarray, int]:
    """Samples of a text. Texts wait in reading order; one that is too large for the voice gives way to its halves."""
    waiting, sounds, rates = [(text, HALVINGS)], [], set()
    while waiting:
        part, halvings = waiting.pop()
        try:
            samples, rate = voice(part)
        except Exception as error:  # noqa: BLE001
            smaller = halves_of(part) if is_too_large(error) and halvings and len(part.strip()) >= LEAST_CHARS else []
            if len(smaller) < 2:
                raise
            waiting += [(half, halvings - 1) for half in reversed(smaller)]
            continue
        sounds.append(samples)
        rates.add(rate)
    if len(rates) > 1:
        raise ValueError("sample rates differ")
    return (sounds[0] if len(sounds) == 1 else np.concatenate(sounds)), rates.pop()


def rendered(chunks: DataFrame, keys: list[str], text: str, voice: Synthesis = stub, unique: bool = False) -> DataFrame:
    """(*keys, n_samples long, sample_rate int): runs the voice over Arrow batches and keeps the lengths; a
    null text gives none. With ``unique`` a chunk delivered twice is spoken once. The samples of one text go before the
    next is spoken, so a worker holds one text's sound and not a batch's."""
    kinds, width = dict(chunks.dtypes), len(keys)

    def measured(said: str | None) -> tuple[int, int]:
        samples, rate = synthesize(voice, said) if said else (np.zeros(0), RATE)
        return len(samples), rate

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [measured(t) for t in batch.column(width).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(width)), pa.array([n for n, _ in made], pa.int64()), pa.array([r for _, r in made], pa.int32())], [*keys, "n_samples", "sample_rate"])

    return spread(chunks.select(*keys, text), *keys, unique=unique).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", n_samples long, sample_rate int")
