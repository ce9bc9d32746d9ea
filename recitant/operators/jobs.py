"""Rendering jobs: sizes, names, completeness, and which job a worker takes next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_component, is_short_section, slug, stem
from .layout import group_directories, spoken
from .ranks import with_rank

# Default sizes.
MAX_CHARS, MAX_PHONEMES = 850, 450
CPU_CHARS, CPU_LIMIT, GPU_LARGE, GPU_SMALL, GPU_LEAST, CPU_LEAST, LARGE_CHUNKS = 900, 12000, 950, 1350, 450, 350, 12
CPU, GPU = "CPUExecutionProvider", "CUDAExecutionProvider"


def effective_chars(max_chars: int = MAX_CHARS, max_phonemes: int = MAX_PHONEMES) -> int:
    return min(max_chars, max_phonemes) if max_phonemes > 0 else max_chars


def estimated_chunks(chars: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.floor((chars + size - 1) / size)).cast("long")


def estimates(chapters: DataFrame, size: int | None = None) -> DataFrame:
    size = size or effective_chars()
    chars = F.length("text").cast("long")
    return chapters.select("chapter_id", "source_id", "title", chars.alias("estimated_chars"), estimated_chunks(chars, size).alias("estimated_chunks"))


def worker_chars(provider: Column, title: Column, chunks: Column, chars: Column, attempt: Column, aggressive: bool = False) -> Column:
    """Chunk size that a worker uses: smaller with every attempt, larger for short sections on a CPU."""
    shrink = F.pow(F.lit(0.7 if aggressive else 0.8), F.greatest(attempt - 1, F.lit(0)))
    base = F.when(is_short_section(title), F.lit(int(CPU_CHARS * 1.2))).otherwise(F.lit(CPU_CHARS))
    cpu = F.greatest(F.lit(CPU_LEAST), (base * shrink).cast("int"))
    large = F.when((chunks >= LARGE_CHUNKS) | (chars >= CPU_LIMIT), F.lit(GPU_LARGE)).otherwise(F.lit(GPU_SMALL))
    return F.when(provider == CPU, cpu).otherwise(F.greatest(F.lit(GPU_LEAST), (large * shrink).cast("int"))).cast("long")


def output_names(chapters: DataFrame, sources: DataFrame, navigation: DataFrame | None = None) -> DataFrame:
    """(chapter_id, chapter_index, output_subdir, output_name) of the chapters that have text, which alone are counted.

    A chapter of a group lies in the group's folder and is counted there; others lie in the source's folder, where one
    whose title heads the navigation has that entry's place and the rest are counted by themselves. A name that its folder
    has already gets the chapter's index. ``sources`` has source_id and source_path; ``navigation`` (source_id, title,
    place) has the entries at the top, the first of a title counting."""
    kept = spoken(chapters).select("chapter_id", "source_id", F.col("chapter_index").alias("_at"), F.nullif("group_path", F.lit("")).alias("group_path"), file_component(F.coalesce("title", F.lit(""))).alias("title"))
    placed = with_rank(kept, ["source_id"], "_at", "chapter_id", "chapter_index")
    folders = group_directories(spoken(chapters)).withColumnRenamed("directory", "_folder")
    roots = sources.select("source_id", slug(stem(F.col("source_path"))).alias("_root"))
    named = placed.join(folders, ["source_id", "group_path"], "left").join(roots, "source_id", "left")
    subdir = F.when(F.col("group_path").isNull(), F.col("_root")).otherwise(F.concat_ws("/", "_root", F.coalesce("_folder", file_component(F.col("group_path")))))
    lying = named.select("chapter_id", "source_id", "chapter_index", "title", "group_path", subdir.alias("output_subdir"))
    if navigation is None:
        entered = lying.withColumn("_entry", F.lit(None).cast("long"))
    else:
        entries = navigation.select("source_id", file_component(F.col("title")).alias("title"), F.col("place").cast("long").alias("_entry")).groupBy("source_id", "title").agg(F.min("_entry").alias("_entry"))
        entered = lying.join(entries, ["source_id", "title"], "left").withColumn("_entry", F.when(F.col("group_path").isNull(), F.col("_entry")))
    way = F.when(F.col("group_path").isNotNull(), 0).when(F.col("_entry").isNull(), 1).otherwise(2)
    counted = with_rank(entered.withColumn("_way", way), ["source_id", "output_subdir", "_way"], "chapter_index", "chapter_id", "_count")
    titled = counted.withColumn("_name", F.format_string("%02d-%s", F.coalesce("_entry", "_count"), "title"))
    ranked = with_rank(titled, ["source_id", "output_subdir", "_name"], "chapter_index", "chapter_id", "_same")
    name = F.when(F.col("_same") > 1, F.format_string("%s-c%03d", "_name", "chapter_index")).otherwise(F.col("_name"))
    return ranked.select("chapter_id", "chapter_index", "output_subdir", name.alias("output_name"))


def unique_names(df: DataFrame, scope: list[str], name: str, key: str) -> DataFrame:
    """(key, unique_name): the first row by its integer key keeps its name, later ones get -cNNN with their rank."""
    return with_rank(df.select(key, name, *scope), [*scope, name], key, key, "rank").select(key, F.when(F.col("rank") > 1, F.format_string("%s-c%03d", F.col(name), F.col("rank"))).otherwise(F.col(name)).alias("unique_name"))


def complete(parts: DataFrame, files: DataFrame) -> DataFrame:
    """(job_id) of jobs that have parts, all of whose MP3 files, and WAV files where one is named, are there and not empty.
    ``files`` has path and length."""
    there = files.where("length > 0").select("path").distinct()
    named = parts.select("job_id", F.nullif("mp3_path", F.lit("")).alias("mp3"), F.nullif("wav_path", F.lit("")).alias("wav"))
    with_mp3 = named.join(there.select(F.col("path").alias("mp3"), F.lit(True).alias("_mp3")), "mp3", "left")
    with_both = with_mp3.join(there.select(F.col("path").alias("wav"), F.lit(True).alias("_wav")), "wav", "left")
    whole = F.col("_mp3").isNotNull() & (F.col("wav").isNull() | F.col("_wav").isNotNull())
    return with_both.groupBy("job_id").agg(F.min(whole.cast("int")).alias("whole")).where("whole = 1").select("job_id")


def pending(jobs: DataFrame, done: DataFrame) -> DataFrame:
    return jobs.join(done, "job_id", "left_anti")


def skipped(jobs: DataFrame, done: DataFrame) -> DataFrame:
    return jobs.join(done, "job_id", "left_semi")


JOB_KEY = ["estimated_chunks", "estimated_chars", "chapter_index", "job_id"]


def gpu_pick(jobs: DataFrame, scope: list[str], short_first: bool = False) -> DataFrame:
    """The job that a GPU worker takes in each scope: the longest that it may take, or the shortest."""
    allowed = jobs.where(F.col("preferred_provider").isNull() | (F.col("preferred_provider") == GPU))
    key = F.struct(*JOB_KEY)
    return allowed.groupBy(*scope).agg((F.min(key) if short_first else F.max(key)).alias("k")).select(*scope, "k.job_id", "k.estimated_chunks", "k.estimated_chars")


def cpu_tier(jobs: DataFrame, allowed_chunks: int = 1, gpu_active: bool = False) -> DataFrame:
    """Adds the tier in which a CPU worker would take a job: 1 pinned to it, 2 short or small, 3 small after the
    GPUs stopped, 4 any; null where it must wait for the GPUs."""
    free = F.col("preferred_provider").isNull() | (F.col("preferred_provider") == CPU)
    small = (F.col("estimated_chars") <= CPU_LIMIT) & (F.col("estimated_chunks") <= allowed_chunks)
    tier = F.when(F.col("preferred_provider") == CPU, 1).when(free & (is_short_section(F.coalesce("chapter_title", F.lit(""))) | small), 2)
    if not gpu_active:
        tier = tier.when(free & small, 3).otherwise(4)
    return jobs.withColumn("tier", tier)


def cpu_pick(jobs: DataFrame, scope: list[str], allowed_chunks: int = 1, gpu_active: bool = False) -> DataFrame:
    key = F.struct("tier", *JOB_KEY)
    return cpu_tier(jobs, allowed_chunks, gpu_active).where("tier IS NOT NULL").groupBy(*scope).agg(F.min(key).alias("k")).select(*scope, "k.tier", "k.job_id", "k.estimated_chunks", "k.estimated_chars")


def chunk_budget(idle_seconds: Column, step: int = 120) -> Column:
    return F.greatest(F.lit(1), 1 + F.floor(F.greatest(idle_seconds, F.lit(0)) / step)).cast("long")


def worker_plan(gpus: int, cpus: int, selected: str = CPU) -> list[tuple[str, str]]:
    """(name, provider) of all workers; one of the selected provider if none is wished."""
    plan = [(f"gpu-{k}", GPU) for k in range(1, gpus + 1)] + [(f"cpu-{k}", CPU) for k in range(1, cpus + 1)]
    return plan or [(("cpu-1" if selected == CPU else "gpu-1"), selected)]


def next_attempts(jobs: DataFrame, failures: DataFrame, max_retries: int = 2) -> DataFrame:
    """Jobs to queue again: the latest attempt of each failed job, one attempt on; after a failure of a GPU worker that its
    device or its silence caused they are pinned to the CPU, for good. A job that is locked already, or without attempts
    left, is not queued again."""
    latest = jobs.groupBy("job_id").agg(F.max_by(F.struct("attempt", "preferred_provider", "fallback_locked"), "attempt").alias("j"))
    failed = failures.groupBy("job_id").agg((F.max(F.col("gpu_failure").cast("int")) == 1).alias("gpu_failure"))
    again = latest.join(failed, "job_id").where((F.col("j.attempt") <= max_retries) & ~F.coalesce(F.col("j.fallback_locked"), F.lit(False)))
    return again.select("job_id", (F.col("j.attempt") + 1).alias("attempt"), F.when(F.col("gpu_failure"), F.lit(CPU)).otherwise(F.col("j.preferred_provider")).alias("preferred_provider"), F.col("gpu_failure").alias("fallback_locked"))
