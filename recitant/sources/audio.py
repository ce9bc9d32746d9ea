"""WAV files: what they hold, and writing parts as 16-bit mono."""

from __future__ import annotations

import io
import os
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import importable


def encode(samples: np.ndarray, rate: int) -> bytes:
    """Floats in -1 to 1, clipped, as a 16-bit mono file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.clip(samples, -1.0, 1.0) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, sample_rate, channels, frames, duration_seconds, samples array<float>) of 16-bit WAV files;
    channels stay interleaved."""
    importable(spark)
    schema = pa.schema([("path", pa.string()), ("sample_rate", pa.int32()), ("channels", pa.int32()), ("frames", pa.int64()), ("duration_seconds", pa.float64()), ("samples", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with wave.open(io.BytesIO(content)) as f:
                    if f.getsampwidth() != 2:
                        raise ValueError(f"{path} does not hold 16-bit samples")
                    rate, channels, frames = f.getframerate(), f.getnchannels(), f.getnframes()
                    samples = np.frombuffer(f.readframes(frames), dtype="<i2").astype(np.float32) / 32767
                yield pa.RecordBatch.from_pylist([{"path": path, "sample_rate": rate, "channels": channels, "frames": frames, "duration_seconds": frames / rate, "samples": samples.tolist()}], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{wav,WAV}").load(paths).select("path", "content")
    return files.mapInArrow(run, "path string, sample_rate int, channels int, frames long, duration_seconds double, samples array<float>")


def listing(spark: SparkSession, folder: str, deep: bool = False) -> DataFrame:
    """Sound files of a folder, or of the folders below it alone, ordered by name in lower case."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.mp3").option("recursiveFileLookup", "true").load(folder)
    base = F.lit(os.path.abspath(folder).rstrip("/") + "/")
    relative = F.regexp_replace(F.expr("url_decode(path)"), "^file:/*", "/")
    named = found.select("path", "length", F.replace(relative, base, F.lit("")).alias("name"))
    inside = F.contains("name", F.lit("/"))
    return named.where(inside if deep else ~inside).orderBy(F.lower("name"))


def write(parts: DataFrame, folder: str, force: bool = False) -> DataFrame:
    """(path, bytes) of parts written from (name, samples, sample_rate) to a folder that all executors share. A
    file appears under its name only when it is whole; one that is there already is an error unless forced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, samples, rate in zip(*(batch.column(c).to_pylist() for c in range(3))):
                path = os.path.join(folder, f"{name}.wav")
                os.makedirs(os.path.dirname(path), exist_ok=True)
                if os.path.exists(path) and not force:
                    raise FileExistsError(path)
                content = encode(np.array(samples, dtype=np.float32), rate)
                with open(f"{path}.{os.getpid()}.tmp", "wb") as f:
                    f.write(content)
                os.replace(f"{path}.{os.getpid()}.tmp", path)
                rows.append({"path": path, "bytes": len(content)})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("bytes", pa.int64())]))

    return parts.select("name", "samples", "sample_rate").mapInArrow(run, "path string, bytes long")
