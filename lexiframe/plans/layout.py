"""Where rows and written steps lie: scan spreading and the shared folder."""

from __future__ import annotations

import logging
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("lexiframe")

SETTING = "spark.checkpoint.dir"
_local_roots: dict[str, str] = {}
_steps: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session without the setting gets a folder of its own.
    """
    named = spark.conf.get(SETTING, None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError(f"set {SETTING} to a folder all executors share")
    if context.applicationId not in _local_roots:
        _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _local_roots[context.applicationId]


@contextmanager
def timed(step: str) -> Iterator[None]:
    """Log the start and the wall-clock time of a step."""
    log.info("start %s", step)
    start = time.monotonic()
    yield
    log.info("finish %s (%.2f s)", step, time.monotonic() - start)


def new_path(spark: SparkSession, step: str) -> str:
    return f"{shared_folder(spark)}/lexiframe/{step}/{uuid.uuid4().hex}"


def written(df: DataFrame, step: str) -> DataFrame:
    """Write a step once and read it back: it cuts lineage, survives lost
    executors, and later passes read only the columns they need."""
    return written_at(df, new_path(df.sparkSession, step), step)


def written_at(df: DataFrame, path: str, step: str) -> DataFrame:
    """A written step whose path the caller keeps, to drop it when nothing reads it any more."""
    _steps.append(path)
    seen = Observation(step)
    with timed(f"write {step}"):
        df.observe(seen, F.count(F.lit(1)).alias("n_rows")).write.parquet(path)
    log.info("%s: %d rows", step, seen.get["n_rows"])
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_step(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clear_steps(spark: SparkSession) -> None:
    """Delete the steps written so far. Frames built on them can no longer be read, so
    call it when their results are stored."""
    while _steps:
        drop_step(spark, _steps.pop())


def _splits_short(scan: DataFrame) -> bool:
    return scan.rdd.getNumPartitions() < scan.sparkSession.sparkContext.defaultParallelism


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Spread a scan with fewer splits than task slots, before regex work.

    A scan that already fills the cluster is left alone: text never shuffles
    just to be counted.
    """
    if not _splits_short(scan):
        return scan
    return scan.repartition(2 * scan.sparkSession.sparkContext.defaultParallelism, key)


def cluster(scan: DataFrame, key: str) -> DataFrame:
    """Bring rows of a key together once, while a document is still one row.

    Everything grouped by the key afterwards stays in its partition, and the
    text of a document is smaller than its exploded tokens.
    """
    if not _splits_short(scan):
        least = int(scan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return scan.repartition(max(least, scan.rdd.getNumPartitions()), key)  # as small as the splits
    return scan.repartition(2 * scan.sparkSession.sparkContext.defaultParallelism, key)
