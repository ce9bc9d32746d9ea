"""Resuming: where a run that stops after some parts goes on, and what it leaves behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATE = (
    "source string, next_chapter_index long, next_chunk_index long, completed_chunks long, elapsed_seconds double, sample_rate int, next_group string, next_part_index long, "
    "output_parts array<struct<part: long, start_chunk: long, end_chunk: long>>"
)


def points(parts: DataFrame, keys: list[str], per_run: int) -> DataFrame:
    """(*keys, run_no, next_part, next_chunk, completed_chunks, partial): the checkpoint after each run that closes ``per_run``
    parts (0: all in one run). ``parts`` has *keys, part_no, start_chunk, end_chunk of one numbering from 1; a run is partial
    if a part is left."""
    run = F.lit(1).cast("long") if per_run <= 0 else F.floor((F.col("part_no") - 1) / per_run) + 1
    whole = Window.partitionBy(*keys)
    numbered = parts.withColumn("run_no", run.cast("long")).withColumn("_last", F.max("part_no").over(whole)).withColumn("_first", F.min("start_chunk").over(whole))
    return numbered.groupBy(*keys, "run_no").agg(
        (F.max("part_no") + 1).cast("long").alias("next_part"), (F.max("end_chunk") + 1).cast("long").alias("next_chunk"), (F.max("end_chunk") - F.min("_first") + 1).cast("long").alias("completed_chunks"),
        (F.max("part_no") < F.max("_last")).alias("partial"),
    )


def write(states: DataFrame, path: str) -> None:
    """Checkpoints, one JSON line each; the folder is replaced."""
    states.write.mode("overwrite").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Checkpoints of a folder; no row where there is none."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    known = files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files)
    return spark.read.schema(STATE).json(path) if known else spark.createDataFrame([], STATE)


def remaining(chunks: DataFrame, next_chapter: Column | int, next_chunk: Column | int) -> DataFrame:
    """Chunks that a resumed run still has to render: later chapters, and of the same chapter those from its next chunk on."""
    return chunks.where((F.col("chapter_index") > next_chapter) | (F.col("chapter_index") == next_chapter) & (F.col("chunk_index") >= next_chunk))


def stale(states: DataFrame, stem: Column) -> DataFrame:
    """(source, name): the part that a resumed run would write under a temporary name and may find half written."""
    from ..functions.text import temporary_part_name

    return states.select("source", temporary_part_name(F.col("next_part_index"), stem).alias("name"))


def requeued(jobs: DataFrame, states: DataFrame) -> DataFrame:
    """Jobs whose run ended partially: they go back to the queue as they are, with the same attempt."""
    return jobs.join(states.select(F.col("source").alias("source_path")).distinct(), "source_path", "left_semi")
