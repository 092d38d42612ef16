"""Document vectors per experiment and split; word vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiframe.config import Settings


def write_vectors(vectors: DataFrame, path: str, mode: str = "append") -> None:
    """`doc_id, vector` under experiment=.../split=..., as written by the tasks:
    no shuffle, so a large experiment is not funnelled into one task."""
    vectors.select("experiment", "split", "doc_id", "vector").write.mode(mode).partitionBy(
        "experiment", "split").parquet(path)


def read_vectors(spark: SparkSession, path: str, experiment: str | None = None) -> DataFrame:
    """Stored vectors; one experiment is a partition filter, not a scan."""
    stored = spark.read.parquet(path)
    return stored if experiment is None else stored.filter(F.col("experiment") == experiment)


def list_experiments(spark: SparkSession, path: str) -> DataFrame:
    return read_vectors(spark, path).select("experiment").distinct()


def list_files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """Names, without the suffix, of the files under a folder that end in it."""
    from lexiframe.functions.names import strip_suffix

    files = (spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}")
             .load(path).select(F.element_at(F.split("path", "/"), -1).alias("file")))
    return files.select(strip_suffix(F.col("file"), suffix).alias("name"))


def word_vector_name(size: int, settings: Settings = Settings()) -> str:
    return f"word_vectors_size_{size}_min_{settings.min_count}_window_{settings.window}"


def write_word_vectors(vectors: DataFrame, folder: str, size: int,
                       settings: Settings = Settings()) -> str:
    path = f"{folder}/{word_vector_name(size, settings)}"
    vectors.write.mode("overwrite").parquet(path)
    return path


def read_word_vectors(spark: SparkSession, folder: str, size: int,
                      settings: Settings = Settings()) -> DataFrame:
    return spark.read.parquet(f"{folder}/{word_vector_name(size, settings)}")
