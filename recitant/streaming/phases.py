"""Worker events as a stream, with the column functions of the batch plans."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.events import BOOTSTRAP_SILENCE, SILENCE, phase_of
from ..tables import shared_folder

SCHEMA = "event_id bigint, job_id bigint, worker_name string, event_kind string, line_text string, logged_at timestamp_ntz, received_at timestamp_ntz"


def events(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """The log as a stream: a folder of parquet files, or one file."""
    reader = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
    if os.path.isfile(path):
        return reader.option("pathGlobFilter", os.path.basename(path)).parquet(os.path.dirname(path))
    return reader.parquet(path)


def last_phases(stream: DataFrame, lateness: str = "30 days") -> DataFrame:
    """(job_id, phase_at, phase): per job the last line that announces a phase, so far. An event delivered again within
    ``lateness`` of its first delivery counts once; the watermark lets older event ids go. State is then one row a job."""
    timed = stream.withColumn("received", F.col("received_at").cast("timestamp")).withWatermark("received", lateness)
    announced = timed.withColumn("phase", phase_of(F.col("line_text"))).where("phase IS NOT NULL").dropDuplicatesWithinWatermark(["event_id"])
    return announced.groupBy("job_id").agg(F.max(F.struct("logged_at", "event_id", "phase")).alias("s")).select("job_id", F.col("s.logged_at").alias("phase_at"), F.col("s.phase").alias("phase"))


WATCHED = "event_id bigint, job_id bigint, worker_name string, phase string, silent boolean"
STATE = "phase string, seen_at long"


def watched(stream: DataFrame, general: float = SILENCE, early: float = BOOTSTRAP_SILENCE, lateness: str = "30 days", timer: bool = True) -> DataFrame:
    """(event_id, job_id, worker_name, phase, silent): the phase of a run after each of its events, and whether the run had been
    silent for longer than its phase allows before it. A run that gets no further event within that time gives a row
    without event_id once, by a timer, and is forgotten. A run is one worker on one job; its state is its phase and the
    time of its last event. Events delivered again within ``lateness`` count once; those of a batch are taken in the order
    of their times, so an event that comes a batch late counts from when it comes. A stream that runs once over what is
    there needs ``timer`` off, as timers would keep it waiting."""
    timed = stream.withColumn("received", F.col("received_at").cast("timestamp")).withWatermark("received", lateness).dropDuplicatesWithinWatermark(["event_id"])
    told = timed.select("event_id", "job_id", "worker_name", F.unix_micros(F.col("logged_at").cast("timestamp")).alias("at"), phase_of(F.col("line_text")).alias("announced"))

    def limit(phase: str) -> float:
        return max(min(general, early) if phase.startswith("bootstrap") or phase == "warmup" else general, 1.0)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        job, worker = key
        if state.hasTimedOut:
            phase, _ = state.get
            state.remove()
            yield pd.DataFrame({"event_id": pd.array([None], "Int64"), "job_id": [job], "worker_name": [worker], "phase": [phase], "silent": [True]})
            return
        phase, seen = state.get if state.exists else ("spawn", None)
        events = pd.concat(list(batches)).sort_values(["at", "event_id"])
        phases, silent = [], []
        for at, announced in zip(events["at"], events["announced"]):
            silent.append(seen is not None and at - seen > limit(phase) * 1e6)
            phase = announced if isinstance(announced, str) else phase
            seen = int(at) if seen is None else max(seen, int(at))
            phases.append(phase)
        state.update((phase, seen))
        if timer:
            state.setTimeoutDuration(int(limit(phase) * 1000))
        yield pd.DataFrame({"event_id": pd.array(events["event_id"], "Int64"), "job_id": job, "worker_name": worker, "phase": phases, "silent": silent})

    return told.groupBy("job_id", "worker_name").applyInPandasWithState(step, WATCHED, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if timer else GroupStateTimeout.NoTimeout)


def run_appended(spark: SparkSession, result: DataFrame, name: str) -> DataFrame:
    """Runs a stream in append mode over all that is there; each batch is written once under its number."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/batch={number}")

    result.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(", ".join(f"`{c}` {t}" for c, t in result.dtypes) + ", batch int").parquet(f"{folder}/table").drop("batch")


def run_to_table(spark: SparkSession, result: DataFrame, name: str, key: str, version: str) -> DataFrame:
    """Runs a stream over all that is there and gives its final result from the shared folder. In update mode each
    batch delivers the rows that changed, written once under the batch's number, so a batch that is repeated replaces
    itself; the reader takes for each ``key`` the row of the highest ``version``."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/batch={number}")

    query = result.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    rows = spark.read.schema(", ".join(f"`{c}` {t}" for c, t in result.dtypes) + ", batch int").parquet(f"{folder}/table")
    rest = [c for c in result.columns if c != key]
    return rows.groupBy(key).agg(F.max(F.struct(version, "batch", *(c for c in rest if c != version))).alias("r")).select(key, *(f"r.{c}" for c in rest))
