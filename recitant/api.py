"""The engine's front door: options, reading of sources, caches, manifests, resuming and the environment."""

from __future__ import annotations

import importlib.util
import os
import platform
import shutil
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import events, jobs, layout, render, resume
from .sources import epub, markdown

CHAPTER = "title string, text string, `group` string"
MANIFEST = (
    "source string, voice string, lang string, speed double, sample_rate int, chapter_count long, chunk_count long, max_part_minutes double, "
    "parts array<struct<part: int, wav_path: string, mp3_path: string, duration_seconds: double, group: string, chapter_titles: array<string>, start_chunk: long, end_chunk: long>>, "
    "chunks array<struct<index: long, heading: string, chapter: string, chars: long, text: string>>"
)


@dataclass(frozen=True)
class Options:
    """What a run may be told; defaults are those of a single run."""

    output_dir: str = "out"
    voice: str = "af_bella"
    lang: str = "en-us"
    speed: float = 0.9
    max_chars: int = jobs.MAX_CHARS
    max_phonemes: int = jobs.MAX_PHONEMES
    silence_ms: int = render.SILENCE_MS
    part_minutes: float = render.PART_MINUTES
    trim: str = "off"  # full, light or off
    mp3_only: bool = True
    mp3_kbps: int = 192
    keep_chunks: bool = False
    force: bool = False
    fresh: bool = False
    # which chapters
    heading_level: int = 0
    single_chapter: bool = False
    max_chapter_chars: int = 0
    chapter_index: int | None = None
    chapter_cache: str | None = None
    output_subdir: str | None = None
    output_name: str | None = None
    # workers
    gpus: int = 2
    cpus: int = 1
    short_first: bool = False
    providers: list[str] = field(default_factory=list)
    cpu_limit: int = jobs.CPU_LIMIT
    cpu_chars: int = jobs.CPU_CHARS
    gpu_large_chars: int = jobs.GPU_LARGE
    gpu_small_chars: int = jobs.GPU_SMALL
    warmup_text: str = "Warmup run."
    # failures
    max_retries: int = 2
    silence_seconds: float = events.SILENCE
    bootstrap_silence_seconds: float = events.BOOTSTRAP_SILENCE
    rest_seconds: float = events.REST
    aggressive_recovery: bool = False
    parts_per_run: int = 0
    heartbeat_seconds: float = 30.0
    debug: bool = False

    def __post_init__(self):
        if not 0 <= self.heading_level <= markdown.MAX_LEVEL:
            raise ValueError(f"heading_level must be 0 to {markdown.MAX_LEVEL}")
        if self.trim not in ("full", "light", "off"):
            raise ValueError("trim must be full, light or off")

    @property
    def chunk_chars(self) -> int:
        return jobs.effective_chars(self.max_chars, self.max_phonemes)

    @property
    def debugging(self) -> bool:
        """As the option says, or the environment variable RECITANT_DEBUG."""
        return self.debug or os.environ.get("RECITANT_DEBUG", "").strip().lower() in ("1", "true", "yes", "on", "debug")


Reader = Callable[[SparkSession, list[str], Options], DataFrame]


def _read_markdown(spark: SparkSession, paths: list[str], options: Options) -> DataFrame:
    read = markdown.read(spark, paths, options.heading_level, options.single_chapter, options.max_chapter_chars)
    return read.withColumn("chapter_index", F.col("chapter_index").cast("int"))


def _read_epub(spark: SparkSession, paths: list[str], options: Options) -> DataFrame:
    return epub.chapters(epub.read(spark, paths))


#: Readers by suffix. A reader gives source_path, chapter_index int, title, text and group_path.
READERS: dict[str, Reader] = {**dict.fromkeys(markdown.SUFFIXES, _read_markdown), **dict.fromkeys(epub.SUFFIXES, _read_epub)}


def register_reader(suffixes: list[str], reader: Reader) -> None:
    """Lets files with these suffixes (with their dot, in small letters) be read; a later reader takes the place of an earlier."""
    READERS.update(dict.fromkeys(suffixes, reader))


def supported_suffixes() -> list[str]:
    return sorted(READERS)


def expand_inputs(spark: SparkSession, items: list[str]) -> DataFrame:
    """(path, item, ord) of the files that paths, patterns and folders (not their subfolders) name, each once at its
    first place: the number of the item that names it first, and the place among that item's files by path; only supported
    suffixes, in any case."""
    found = None
    for k, item in enumerate(items):
        own = spark.read.format("binaryFile").load(item).select("path", F.lit(k).alias("item"))
        found = own if found is None else found.unionByName(own)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    first = found.where(suffix.isin(supported_suffixes())).groupBy("path").agg(F.min("item").alias("item"))
    return first.select("path", "item", F.row_number().over(Window.partitionBy("item").orderBy("path")).alias("ord"))


def load_sources(spark: SparkSession, paths: list[str], options: Options = Options()) -> DataFrame:
    """(source_path, chapter_index, title, text, group_path) of source files by their readers; a path with another
    suffix is an error. ``options.chapter_index`` selects one chapter of each source; where a source has fewer, the plan
    fails when it runs."""
    by_reader: dict[Reader, list[str]] = {}
    for path in paths:
        reader = next((r for suffix, r in READERS.items() if path.lower().endswith(suffix)), None)
        if reader is None:
            raise ValueError(f"no reader takes {path}")
        by_reader.setdefault(reader, []).append(path)
    made = None
    for reader, own in by_reader.items():
        read = reader(spark, own, options)
        made = read if made is None else made.unionByName(read)
    wanted = options.chapter_index
    if wanted is None:
        return made
    if wanted < 1:
        raise ValueError("chapter_index counts from 1")
    chapter = F.struct("chapter_index", "title", "text", "group_path")
    picked = made.groupBy("source_path").agg(F.max(F.when(F.col("chapter_index") == wanted, chapter)).alias("c"))
    return picked.select("source_path", F.coalesce("c", F.raise_error(F.concat(F.lit(f"no chapter {wanted} in "), "source_path"))).alias("c")).select("source_path", "c.*")


def load_chapters(spark: SparkSession, path: str, **options) -> DataFrame:
    """The chapters of one source that have text, in order: the short form of ``load_sources``."""
    return layout.spoken(load_sources(spark, [path], Options(**options))).orderBy("chapter_index")


def source_metadata(content: bytes, stem: str) -> dict[str, str | None]:
    """Title, author, publisher, date and language of an EPUB file; of what is none, the stem as the title."""
    return epub.Book.metadata_of(content, stem)


def audio_metadata(sources: DataFrame) -> DataFrame:
    """(source_id, source_title, author, publisher, published_date, language): what of a source goes into its sound files."""
    return sources.select("source_id", "source_title", "author", "publisher", "published_date", F.col("language_tag").alias("language"))


def read_chapter_cache(spark: SparkSession, path: str) -> DataFrame:
    """Cached chapters of one source; a missing title is ``Untitled``, a missing text empty, rows that are no
    objects are passed over."""
    rows = spark.read.schema(CHAPTER + ", _corrupt_record string").option("multiLine", "true").json(path)
    kept = rows.where("_corrupt_record IS NULL")
    return kept.select(F.coalesce("title", F.lit("Untitled")).alias("title"), F.coalesce("text", F.lit("")).alias("text"), F.col("group").alias("group_path"))


def write_chapter_cache(chapters: DataFrame, path: str) -> None:
    """Chapters as JSON lines, a folder for each source."""
    chapters.select("source_path", "chapter_index", "title", "text", F.col("group_path").alias("group")).write.mode("overwrite").partitionBy("source_path").json(path)


def append_events(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifests with a fixed schema; files that are no JSON give no row."""
    return spark.read.schema(MANIFEST + ", _corrupt_record string").json(path).where("_corrupt_record IS NULL").drop("_corrupt_record")


remaining = resume.remaining


def environment(spark: SparkSession, options: Options = Options()) -> DataFrame:
    """(check, good, found): what a run needs from its environment, and what was found."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    rows = [
        ("python", True, platform.python_version()),
        ("spark", True, spark.version),
        ("master", True, spark.sparkContext.master),
        ("cores", spark.sparkContext.defaultParallelism > 0, str(spark.sparkContext.defaultParallelism)),
        ("shared folder", bool(shared) or spark.sparkContext.master.startswith("local"), shared or ""),
        ("temporary folder", os.access(os.environ.get("TMPDIR", "/tmp"), os.W_OK), os.environ.get("TMPDIR", "/tmp")),
        *((f"module {m}", importlib.util.find_spec(m) is not None, m) for m in ("pyarrow", "pandas", "numpy", "tokenizers", "zstandard")),
        ("room", shutil.disk_usage("/").free > 1 << 30, str(shutil.disk_usage("/").free)),
        ("options", True, str(asdict(options))),
    ]
    return spark.createDataFrame(rows, "check string, good boolean, found string")


def warm_up(voice: render.Synthesis, options: Options = Options()) -> int:
    """Speaks the warm-up text once, so that the first job finds the voice loaded; the number of samples, 0 without a text."""
    return len(voice(options.warmup_text)[0]) if options.warmup_text.strip() else 0
