"""Reading of the engine's tables and the few physical choices that every plan shares."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def importable(spark: SparkSession) -> None:
    """Lets Python workers find this package where it lies on a path that they can read; on a cluster without
    such a path, ship it with ``--py-files``."""
    root, environment = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    if root not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, environment.get("PYTHONPATH")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan_tasks(df: DataFrame) -> int:
    """Tasks that the scans of a plan give: the sum over a union, the larger side of a join. Only the planner is asked:
    no job runs."""

    def tasks(node) -> int:
        children = node.children()
        if children.isEmpty():
            rdd = node.inputRDD() if node.getClass().getSimpleName() == "FileSourceScanExec" else node.execute()
            return rdd.getNumPartitions()
        own = [tasks(children.apply(k)) for k in range(children.size())]
        return sum(own) if node.getClass().getSimpleName() == "UnionExec" else max(own)

    return tasks(df._jdf.queryExecution().sparkPlan())


def spread(df: DataFrame, *keys: str, unique: bool = False) -> DataFrame:
    """Rows for CPU-bound Python stages, in at least as many partitions as there are cores.

    A scan that already gives one task per core passes unchanged, so that large inputs are never
    shuffled for this; a scan of a few unsplittable files is hashed on ``keys`` (deterministic, so a lost
    task can be repeated alone). With ``unique`` one row for each value of ``keys`` stays: the rows are hashed on them
    once, into as many partitions as the scan has tasks, and are told apart there. ``df`` holds scans, projections and
    filters alone.
    """
    cores, tasks = df.sparkSession.sparkContext.defaultParallelism, scan_tasks(df)
    if unique:
        return df.repartition(max(cores, tasks), *keys).dropDuplicates(list(keys))
    return df if tasks >= cores else df.repartition(cores, *keys)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it. Where it is unset, a session on
    this machine alone gets a folder of its own, which goes with the process; a cluster is an error."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    global _own
    if _own is None:
        _own = tempfile.mkdtemp(prefix="recitant-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return _own


_own: str | None = None


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder; Spark removes the files when the
    frame is gone if ``spark.cleaner.referenceTracking.cleanCheckpoints`` says so."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """A broadcast hint only where a count of at most ``max_rows`` + 1 rows proves the side small.

    Beyond the bound the frame comes back without the hint, and the planner picks a shuffled join.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def data_dir(name: str = "sf0.001") -> str:
    return os.path.join("/root/testdata", name)
