"""Reports as JSON rows and as one CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lexiframe.config import REPORT_METRICS
from lexiframe.sources.artefacts import exists

REPORT_SCHEMA = T.StructType(
    [T.StructField("name", T.StringType())]
    + [T.StructField(m, T.DoubleType()) for m in REPORT_METRICS])


def write_reports(reports: DataFrame, path: str, mode: str = "append") -> None:
    """One JSON row per experiment; later runs append."""
    reports.select("name", *REPORT_METRICS).write.mode(mode).json(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Stored reports; an empty frame where none is stored yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], REPORT_SCHEMA)
    return spark.read.schema(REPORT_SCHEMA).json(path)


def write_table(rows: DataFrame, path: str) -> None:
    """Flat report table as CSV with a header, index column first."""
    rows.write.option("header", True).csv(path)
