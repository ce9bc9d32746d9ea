"""Worker events: parsing, phases, silences, last states and summaries. The same column functions serve the
batch plans here and the streams in ``streaming``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import PROGRESS, clock

#: Seconds without a line after which a worker counts as hung, in general and before it renders.
SILENCE, BOOTSTRAP_SILENCE = 300.0, 90.0


def phase_of(line: Column) -> Column:
    """The phase that a line announces; null for lines that leave the phase as it is."""
    # What the lines hold.
    t = F.lower(F.trim(line))
    has = lambda x: F.contains(t, F.lit(x))
    return (
        F.when(has("[run:bootstrap] loading onnxruntime..."), "bootstrap_onnxruntime")
        .when(has("[run:bootstrap] loading kokoro_onnx..."), "bootstrap_model_load")
        .when(has("[run:bootstrap] creating kokoro session..."), "bootstrap_session")
        .when(has("[run:warmup] start"), "warmup")
        .when(has("[run:warmup] done"), "chapter_load")
        .when(F.startswith(t, F.lit("[")) & has("/") & has("chapter=") & has("chunk="), "render")
    )


def silence_limit(phase: Column, general: float = SILENCE, early: float = BOOTSTRAP_SILENCE) -> Column:
    """Seconds that a worker may be silent in a phase; no limit is below one."""
    general, early = max(general, 1.0), max(early, 1.0)
    return F.when(F.startswith(phase, F.lit("bootstrap")) | (phase == "warmup"), F.lit(min(general, early))).otherwise(F.lit(general))


def once(log: DataFrame) -> DataFrame:
    """Rows delivered twice count once."""
    return log.dropDuplicates(["event_id"])


def parsed(log: DataFrame, *more: str) -> DataFrame:
    """Adds what the line says: progress numbers, heartbeat and done flags of JSON lines. Lines that are no
    valid JSON give null flags."""
    line = F.trim("line_text")
    number = lambda k, kind: F.nullif(F.regexp_extract(line, PROGRESS, k), F.lit("")).try_cast(kind)
    is_json = F.startswith(line, F.lit("{"))
    flag = lambda name: F.coalesce(F.when(is_json, F.get_json_object(line, f"$.{name}") == "true"), F.lit(False))
    return log.select(
        "event_id", "job_id", "worker_name", "event_kind", *more,
        number(1, "long").alias("progress_current"), number(2, "long").alias("progress_total"), number(3, "double").alias("percent"), number(4, "double").alias("eta_seconds"),
        flag("heartbeat").alias("is_heartbeat"), flag("worker_job_done").alias("is_done"),
        F.when(is_json, F.get_json_object(line, "$.completed_chunks").try_cast("long")).alias("completed_chunks"),
    )


def _announced(log: DataFrame) -> DataFrame:
    """Events once, with the phase that their line announces in place of the line."""
    return once(log.select("event_id", "job_id", "worker_name", "logged_at", phase_of(F.col("line_text")).alias("announced")))


def phases(log: DataFrame) -> DataFrame:
    """(event_id, job_id, phase): the phase after each event of a job's run, ``spawn`` at first.

    A run is one worker on one job, so no window holds a worker's whole log."""
    run = Window.partitionBy("job_id", "worker_name").orderBy("logged_at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return _announced(log).select("event_id", "job_id", F.coalesce(F.last("announced", ignorenulls=True).over(run), F.lit("spawn")).alias("phase"))


def silences(log: DataFrame, general: float = SILENCE, early: float = BOOTSTRAP_SILENCE) -> DataFrame:
    """(event_id, job_id, gap_seconds) of events before which a run was silent for longer than its phase
    allows."""
    order = Window.partitionBy("job_id", "worker_name").orderBy("logged_at", "event_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    at = F.unix_micros(F.col("logged_at").cast("timestamp"))
    phase = F.coalesce(F.last("announced", ignorenulls=True).over(so_far), F.lit("spawn"))
    gaps = _announced(log).select("event_id", "job_id", ((at - F.lag(at).over(order)) / 1_000_000).alias("gap_seconds"), silence_limit(phase, general, early).alias("limit"))
    return gaps.where("gap_seconds > limit").select("event_id", "job_id", "gap_seconds")


def last_states(log: DataFrame, keys: list[str]) -> DataFrame:
    """The last event of each key, aggregated on the map side."""
    state = F.struct("logged_at", "event_id", "event_kind", "line_text")
    return log.groupBy(*keys).agg(F.max(state).alias("s"), F.count_distinct("event_id").alias("n_events")).select(*keys, "s.event_id", "s.event_kind", "n_events")


def summary(log: DataFrame) -> DataFrame:
    """Per kind of event: events, jobs and workers."""
    return once(log).groupBy("event_kind").agg(F.count("*").alias("n_events"), F.count_distinct("job_id").alias("n_jobs"), F.count_distinct("worker_name").alias("n_workers"))


def job_states(jobs: DataFrame, log: DataFrame) -> DataFrame:
    """(job_id, chunks, done, current, failed): size, whether finished, chunks as far as the last progress line says but no more
    than there are, and whether the last attempt ended in a failure."""
    size = jobs.groupBy("job_id").agg(F.max("estimated_chunks").cast("long").alias("chunks"))
    p = parsed(once(log).withColumn("_at", F.struct("logged_at", "event_id")), "_at")
    bad = F.col("event_kind").isin("worker_exception", "timeout")
    state = p.groupBy("job_id").agg(F.max(F.col("is_done").cast("int")).alias("done"), F.max("progress_current").alias("current"), F.max(F.when(bad, F.col("_at"))).alias("_bad"), F.max(F.when(~bad, F.col("_at"))).alias("_good"))
    failed = F.col("_bad").isNotNull() & (F.col("_good").isNull() | (F.col("_bad") > F.col("_good")))
    return size.join(state, "job_id", "left").select("job_id", "chunks", (F.coalesce("done", F.lit(0)) == 1).alias("done"), F.least("chunks", F.coalesce("current", F.lit(0))).alias("current"), F.coalesce(failed, F.lit(False)).alias("failed"))


def batch_progress(jobs: DataFrame, log: DataFrame) -> DataFrame:
    """One row: jobs, finished jobs, chunks, chunks done (finished jobs whole, running ones as far as their
    last progress line says, never more than there are), percent."""
    each = job_states(jobs, log)
    made = F.sum(F.when(F.col("done"), F.col("chunks")).otherwise(F.col("current")))
    return each.agg(F.count("*").alias("n_jobs"), F.count_if("done").alias("n_done"), F.sum("chunks").alias("n_chunks"), made.alias("n_chunks_done")).withColumn(
        "percent", F.when(F.col("n_chunks") > 0, F.round(F.col("n_chunks_done") * 100.0 / F.col("n_chunks"), 1)).otherwise(F.lit(100.0))
    )


def batch_summary(states: DataFrame, keys: list[str], elapsed: Column) -> DataFrame:
    """(*keys, n_jobs, n_done, n_running, n_failed, percent, average_seconds, eta_seconds): finished jobs count whole, running
    ones (begun, neither finished nor failed) as far as they are; the time left is the average by chunk times the chunks
    left. ``states`` are ``job_states`` with the seconds that each group has been worked on in ``elapsed``."""
    running = ~F.col("done") & ~F.col("failed") & (F.col("current") > 0)
    made = F.sum(F.when(F.col("done"), F.col("chunks")).when(running, F.col("current")).otherwise(F.lit(0)))
    sums = states.groupBy(*keys).agg(
        F.count("*").alias("n_jobs"), F.count_if("done").alias("n_done"), F.count_if(running).alias("n_running"), F.count_if(F.col("failed") & ~F.col("done")).alias("n_failed"), F.sum("chunks").alias("_all"), made.alias("_made"), F.max(elapsed).alias("_elapsed"),
    )
    average = F.when(F.col("_made") > 0, F.greatest(F.col("_elapsed"), F.lit(0.0)) / F.col("_made")).otherwise(F.lit(0.0))
    return sums.select(
        *keys, "n_jobs", "n_done", "n_running", "n_failed", F.when(F.col("_all") > 0, F.round(F.col("_made") * 100.0 / F.col("_all"), 1)).otherwise(F.lit(100.0)).alias("percent"),
        F.round(average, 3).alias("average_seconds"), F.round(average * (F.col("_all") - F.col("_made")), 3).alias("eta_seconds"),
    )


#: Seconds within which a worker's progress is shown once, unless the chunk is the last.
SHOWN_EVERY = 3.0


def shown_progress(log: DataFrame, every: float = SHOWN_EVERY) -> DataFrame:
    """(event_id, job_id) of the progress lines that are shown: of a run, the first; later ones if the total is another, or if
    the chunk is another and it is the last or ``every`` seconds have gone since the line shown before. A fold over the
    numbers of one run, which has no more lines than its job has chunks."""
    lines = parsed(once(log).withColumn("_t", F.unix_micros(F.col("logged_at").cast("timestamp"))), "_t").where("progress_current IS NOT NULL")
    runs = lines.groupBy("job_id", "worker_name").agg(F.array_sort(F.collect_list(F.struct("_t", "event_id", F.col("progress_current").alias("c"), F.col("progress_total").alias("n")))).alias("all"))
    start = F.struct(F.array().cast("array<bigint>").alias("kept"), F.lit(None).cast("bigint").alias("t"), F.lit(None).cast("bigint").alias("c"), F.lit(None).cast("bigint").alias("n"))

    def step(s: Column, x: Column) -> Column:
        same = s["n"].eqNullSafe(x["n"])
        hidden = same & ((s["c"] == x["c"]) | (x["c"] < x["n"]) & (x["_t"] - s["t"] < int(every * 1_000_000)))
        shown = F.struct(F.concat(s["kept"], F.array(x["event_id"])).alias("kept"), x["_t"].alias("t"), x["c"].alias("c"), x["n"].alias("n"))
        return F.when(hidden, s).otherwise(shown)

    return runs.select("job_id", F.explode(F.aggregate("all", start, step, lambda s: s["kept"])).alias("event_id")).select("event_id", "job_id")


#: Seconds that a GPU worker rests after a failure, at least, and at least when recovering aggressively.
REST, AGGRESSIVE_REST = 12.0, 20.0


def rests(log: DataFrame, seconds: float = REST, aggressive: bool = False) -> DataFrame:
    """(event_id, worker_name, ready_at): until when a GPU worker takes no job after its device failed or it fell silent."""
    wait = max(seconds, 1.0, AGGRESSIVE_REST if aggressive else 0.0)
    failed = once(log).where(device_failure(F.col("event_kind"), F.col("line_text"), F.col("worker_name")))
    return failed.select("event_id", "worker_name", (F.col("logged_at") + F.make_dt_interval(secs=F.lit(wait))).alias("ready_at"))


def progress_lines(log: DataFrame) -> DataFrame:
    """(event_id, shown): progress events as a person reads them."""
    p = parsed(once(log)).where("progress_current IS NOT NULL AND eta_seconds IS NOT NULL")
    return p.select("event_id", F.format_string("[%s] chunk %d/%d | eta %s", F.coalesce("worker_name", F.lit("?")), "progress_current", "progress_total", clock(F.col("eta_seconds"))).alias("shown"))


def device_failure(kind: Column, line: Column, worker: Column) -> Column:
    """Whether an event shows that a GPU worker's device failed or the worker fell silent."""
    # What the lines of a failing device hold.
    said = F.lower(line).rlike(r"cuda|cudnn|cublas|out of memory")
    return F.coalesce((said | (kind == "timeout")) & F.startswith(worker, F.lit("gpu")), F.lit(False))


def gpu_failures(log: DataFrame) -> DataFrame:
    """(job_id, gpu_failure): failed runs, and whether a GPU worker's device or silence was at fault."""
    bad = log.where(F.col("event_kind").isin("worker_exception", "timeout", "retry"))
    return bad.select("job_id", device_failure(F.col("event_kind"), F.col("line_text"), F.col("worker_name")).alias("gpu_failure"))
