"""Steps kept on disk and reused while their settings and input stay the same."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Sequence
from hashlib import sha256
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiframe.config import Settings


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file system Spark can reach holds this path."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def input_identity(spark: SparkSession, paths: Sequence[str]) -> tuple:
    """Changes when a file of the input is added, removed or rewritten.

    A listing only; its hash is summed by Spark, so one row reaches the driver.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    seen = F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)")
    row = files.agg(F.count(F.lit(1)), F.sum(seen)).first()
    return int(row[0]), int(row[1] or 0)


def code_identity(*modules: ModuleType) -> str:
    """Changes with the source of the modules that make a step."""
    return sha256("".join(map(inspect.getsource, modules)).encode()).hexdigest()[:16]


def reuse_or_write(spark: SparkSession, folder: str, step: str, settings: Settings,
                   inputs: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """Read `folder/step/fingerprint`, or make and write it first.

    `inputs` names what the step depends on (file identity, code, stop words), so a
    change of any of them leads to another folder, never to a stale one. A write that was
    cut off has no success mark and is done again.
    """
    path = f"{folder}/{step}/{settings.fingerprint(step, *inputs)}"
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
