"""Session factory and materialised stages in the cluster's shared folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings every job of the engine relies on; sizes are left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def make_session(master: str = "local[*]", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and benches; on a cluster use the one that is given."""
    builder = SparkSession.builder.master(master).appName("quern").config("spark.ui.enabled", "false")
    for key, value in {**SETTINGS, "spark.sql.shuffle.partitions": str(shuffle_partitions), **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])


def spread(df: DataFrame, each: int = 32 << 20) -> DataFrame:
    """``df`` in a partition for each core, where fewer files than half of them hold all of it and it is small.

    For work that takes much more time than moving its rows: a small file can't be
    split among tasks. Inputs of many files, or of more than ``each`` bytes a core,
    stay where they are. Only looks at the plan; nothing is run, and file names are
    asked for only where the input is small.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > each * cores or 2 * len(df.inputFiles()) > cores:
        return df
    return df.repartition(cores)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a folder of its own where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _forget(spark: SparkSession, path: str) -> None:
    """Delete a stage's files; at exit the JVM may already be gone, and then they stay."""
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it back.

    Cuts the lineage like a checkpoint, survives lost executors, is computed once
    only, and what reads it prunes columns and knows its size. The files go when
    they are ``dropped`` or ``released``, at the latest when the session's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quern/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _stages:
        atexit.register(release, spark)
    _stages.append(path)
    found = spark.read.parquet(path)
    found._quern_stage = path
    return found


#: The stages that are there, in order.
_stages: list[str] = []


def drop(*stages: DataFrame) -> None:
    """Delete stages that nothing will read any more; other DataFrames are passed over."""
    for df in stages:
        path = getattr(df, "_quern_stage", None)
        if path in _stages:
            _stages.remove(path)
            _forget(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Delete all stages; results that weren't read or written by then can't be any more. For long sessions, between jobs."""
    while _stages:
        _forget(spark, _stages.pop())
