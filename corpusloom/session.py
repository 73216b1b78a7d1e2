"""Session and checkpoint helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


FEW_PIECES = 16

# Where cut_lineage writes inside a scratch() block.
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def local_session(cpus: int | str = "*", name: str = "corpusloom") -> SparkSession:
    """A local session for tests and benchmarks. On a cluster, pass in your own.

    Its checkpoint folder is removed when Python ends.
    """
    folder = tempfile.mkdtemp(prefix=f"{name}-checkpoint-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", folder)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session
    may fall back to a folder of this machine; executors elsewhere could not
    read it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="corpusloom-checkpoint-"))
    return sc.getCheckpointDir()


def spread(df: DataFrame) -> DataFrame:
    """Share out rows that were read in a handful of pieces.

    A file with one large row group is one task, whatever its size. Inputs
    with enough pieces, which is every large one, are left as they are: more
    than a few, and more than a quarter of the cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = max(cores // 4, min(cores, FEW_PIECES))
    return df.repartition(cores) if df.rdd.getNumPartitions() <= few else df


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``cut_lineage`` writes inside the block are deleted at its end.

    Results are read from these tables, so write them inside the block::

        with scratch(spark):
            dependents(dependencies, results).write.parquet(path)
    """
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpusloom-scratch-{uuid.uuid4().hex}"
    token = _scratch.set(folder)
    try:
        yield
    finally:
        _scratch.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def is_missing_path(error: Exception) -> bool:
    """True if a read failed because there is nothing at the path, and for no other reason."""
    return getattr(error, "getCondition", lambda: None)() == "PATH_NOT_FOUND"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the written table.

    The copy has known sizes, so later joins are planned on facts, and lost
    executors read it again instead of repeating what led to it. Copies stay
    until the end of the ``scratch`` block around the call; without one they
    are the caller's to remove.
    """
    spark = df.sparkSession
    folder = _scratch.get() or ensure_checkpoint_dir(spark)
    path = f"{folder.rstrip('/')}/corpusloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
