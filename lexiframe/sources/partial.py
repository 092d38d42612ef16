"""Counts kept per input file, so that only new or changed files are read."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lexiframe.sources.artefacts import exists



@dataclass
class Counted:
    """`totals`: word and cnt over all files; how many files and rows were read this time."""

    totals: DataFrame
    read_files: int
    read_rows: int


def file_key() -> Column:
    """A file's path, size and time of change, as one text."""
    parts = [F.col(f"_metadata.file_{p}").cast("string") for p in ("path", "size", "modification_time")]
    return F.sha2(F.concat_ws("|", *parts), 256)


def counted_files(spark: SparkSession, paths: Sequence[str], kept: str,
                  count: Callable[[DataFrame], DataFrame]) -> Counted:
    """Word counts of the Parquet files under `paths`, from partial counts kept under `kept`.

    A file is known by its path, size and time of change. `count` turns rows with a `file` column
    into `file, word, cnt`. Counts of new files are written first and the list of their files after
    them, so a run that breaks off leaves counts that no list names and that are not used. Counts of
    files that are gone or were changed are not used either.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option(
        "pathGlobFilter", "*.parquet").load(list(paths)).select(
        file_key().alias("file"), F.col("_metadata.file_path").alias("path"))
    known = spark.read.parquet(f"{kept}/files") if exists(spark, f"{kept}/files") else None
    new = listed if known is None else listed.join(known, "file", "left_anti")
    fresh = [r["path"] for r in new.select("path").collect()]
    rows = 0
    if fresh:
        batch, seen = uuid.uuid4().hex, Observation("files")
        texts = spark.read.parquet(*fresh).withColumn("file", file_key()).observe(seen, F.count(F.lit(1)).alias("rows"))
        count(texts).select("file", "word", "cnt").write.parquet(f"{kept}/counts/batch={batch}")
        listed.join(F.broadcast(spark.createDataFrame([(p,) for p in fresh], "path string")), "path").select(
            "file", F.lit(batch).alias("batch")).write.mode("append").parquet(f"{kept}/files")
        rows = seen.get["rows"]
    if not exists(spark, f"{kept}/files"):
        return Counted(spark.createDataFrame([], "word string, cnt long"), 0, 0)
    known = spark.read.parquet(f"{kept}/files").join(listed.select("file").distinct(), "file", "left_semi").distinct()
    counts = spark.read.parquet(f"{kept}/counts").join(known, ["file", "batch"], "left_semi")
    return Counted(counts.groupBy("word").agg(F.sum("cnt").alias("cnt")), len(fresh), rows)
