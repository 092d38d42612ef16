"""Experiment names, reports and what is left to score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiframe.config import EXPERIMENT_FIELDS, REPORT_METRICS
from lexiframe.functions import names
from lexiframe.plans.ranking import numbered

FIELDS = [field for field, _ in EXPERIMENT_FIELDS]


def _read_names(reports: DataFrame, name: str) -> DataFrame:
    """Add `_texts`, the fields of each name. The exploded arrays of one element keep Spark from
    writing the name, and its match, into every expression that uses them."""
    once = [F.explode_outer(F.array(c)).alias(c) if c == name else F.col(c) for c in reports.columns]
    return reports.select(*once).select("*", F.explode_outer(F.array(names.field_texts(F.col(name)))).alias("_texts"))


def parsed(reports: DataFrame, name: str = "name") -> DataFrame:
    """Add the typed fields of each name; names of another layout are left out."""
    good = _read_names(reports, name).filter(names.is_experiment(F.col("_texts")))
    return good.select(*reports.columns, *names.typed_fields(F.col("_texts")))


def unparsed(reports: DataFrame, name: str = "name") -> DataFrame:
    return _read_names(reports, name).filter(~names.is_experiment(F.col("_texts"))).drop("_texts")


def latest(reports: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key under `order`, by one combined maximum."""
    rest = [c for c in reports.columns if c not in (*key, *order)]
    best = reports.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("_last"))
    return best.select(*key, *[f"_last.{c}" for c in (*order, *rest)])


def pending(exported: DataFrame, scored: DataFrame, key: str = "name") -> DataFrame:
    """Experiments with vectors and no report yet."""
    return exported.join(scored.select(key), key, "left_anti")


def train_and_test(artefacts: DataFrame, key: str = "name") -> DataFrame:
    """Row counts of experiments that have both splits, in one pass."""
    def rows(split: str) -> Column:
        return F.count_if(F.col("split") == split)

    both = artefacts.groupBy(key).agg(rows("train").alias("n_train"), rows("test").alias("n_test"))
    return both.filter((F.col("n_train") > 0) & (F.col("n_test") > 0))


def with_labels(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels for the documents of every experiment."""
    return vectors.join(labels, "doc_id")


def top(reports: DataFrame, k: int, metric: str = "f_measure",
        ties: Sequence[str] = ("name",), by: Sequence[str] = ()) -> DataFrame:
    """The k best reports, over all or per group."""
    order = [F.col(metric).desc(), *[F.col(t).asc() for t in ties]]
    if not by:
        return reports.orderBy(*order).limit(k)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return reports.withColumn("place", place).filter(F.col("place") <= k)


def report_table(reports: DataFrame, name: str = "name", ties: Sequence[str] = ()) -> DataFrame:
    """Flat report columns with a row index over the experiment key.

    The names are read once; rows are dealt by ranges of the key, so no task sorts them all and a
    much used configuration is split further.
    """
    ranked = numbered(parsed(reports, name), [*FIELDS, name, *ties])
    return ranked.select(F.col("number").alias("row_index"), *FIELDS[:-1], *REPORT_METRICS)


def resume_epochs(models: DataFrame, done: DataFrame, model: str = "model") -> DataFrame:
    """First epoch still to run: one past the last done, 0 where none is."""
    last = done.groupBy(model).agg((F.max("epoch") + 1).alias("next_epoch"))
    return models.select(model).distinct().join(last, model, "left").select(
        model, F.coalesce("next_epoch", F.lit(0)).alias("next_epoch"))


def epoch_cost(costs: DataFrame) -> DataFrame:
    return costs.groupBy("epoch").agg(F.avg("cost").alias("mean_cost"),
                                      F.count(F.lit(1)).alias("n_batches"))


def export_epochs(total: int, gap: int) -> list[int]:
    """1-based epochs after which vectors are exported."""
    return [e for e in range(1, total + 1) if e % gap == 0]
