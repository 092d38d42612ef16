"""Score exported experiments once, as they arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiframe.operators import experiments as ex
from lexiframe.sources import reports as rp
from lexiframe.sources.artefacts import exists
from lexiframe.sources.vectors import read_vectors


def run_scoring(spark: SparkSession, exports: str, schema: T.StructType, reports: str,
                checkpoint: str, score: Callable[[DataFrame], DataFrame]) -> None:
    """Take new files under `exports`, score names without a report, stop.

    `score` turns new rows into one report per name. A batch that is run again
    after a failure finds the names already stored and adds none twice.
    """
    def store(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        rp.write_reports(score(ex.pending(batch, rp.read_reports(session, reports))), reports)

    query = (spark.readStream.schema(schema).json(exports).writeStream
             .foreachBatch(store).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


BOTH = 3  # bits of the splits that were seen


def _now_ready(key: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """A name, once, when vectors of its second split arrive."""
    before = state.get[0] if state.exists else 0
    seen = before
    for batch in rows:
        for split in batch["split"].unique():
            seen |= {"train": 1, "test": 2}.get(split, 0)
    if seen != before:
        state.update((seen,))
    if seen == BOTH and before != BOTH:
        yield pd.DataFrame({"name": [key[0]]})


def ready_names(arriving: DataFrame) -> DataFrame:
    """`name` of each experiment when both its splits have arrived; the splits seen are keyed state."""
    one = arriving.select(F.col("experiment").alias("name"), "split")
    return one.groupBy("name").applyInPandasWithState(_now_ready, "name string", "seen int", "append", "NoTimeout")


def run_fits(spark: SparkSession, stored: str, labels: DataFrame, reports: str, checkpoint: str,
             fit: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """Take new vector files under `stored`, fit each experiment that became ready, stop.

    `fit` gets an experiment's labelled train and test rows and returns its scores. What was seen
    is the stream's state, so the reports are never read; those of a batch lie under its number, and
    a batch that is run again after a failure overwrites its own.
    """
    def store(batch: DataFrame, number: int) -> None:
        session, mode = batch.sparkSession, "overwrite"
        for row in batch.collect():  # names only; each is a fit of its own
            own = ex.with_labels(read_vectors(session, stored, row["name"]), labels).select("split", "vector", "label")
            train, test = (own.filter(F.col("split") == s) for s in ("train", "test"))
            scored = fit(train, test).select(F.lit(row["name"]).alias("name"), *rp.REPORT_METRICS)
            rp.write_reports(scored, f"{reports}/batch={number}", mode)
            mode = "append"

    schema = spark.read.parquet(stored).schema
    query = (ready_names(spark.readStream.schema(schema).parquet(stored)).writeStream
             .foreachBatch(store).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def read_batches(spark: SparkSession, reports: str) -> DataFrame:
    """Reports of all batches; an empty frame where none is stored yet."""
    if not exists(spark, reports):
        return spark.createDataFrame([], rp.REPORT_SCHEMA)
    return spark.read.schema(rp.REPORT_SCHEMA).option("recursiveFileLookup", True).json(reports)
