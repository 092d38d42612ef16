"""Add-k bigram likelihood of framed sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiframe.config import EOS, GO


def steps(indexed: DataFrame, split: Column) -> DataFrame:
    """(previous, next) symbols of each sentence from GO to EOS, counted per split."""
    ids = F.col("ids")
    pair = F.arrays_zip(F.concat(F.array(F.lit(GO)), ids).alias("prev"),
                        F.concat(ids, F.array(F.lit(EOS))).alias("next"))
    rows = indexed.select((split == "train").cast("long").alias("train"), F.inline_outer(pair))
    return rows.groupBy("prev", "next").agg(
        F.sum("train").alias("n_train"), F.sum(1 - F.col("train")).alias("n_test"))


def framed_steps(framed: DataFrame, split: Column) -> DataFrame:
    """(input, target) symbols of decoder frames inside the length mask, counted per split."""
    steps_in = F.slice(F.arrays_zip(F.col("out").alias("prev"), F.col("target").alias("next")), 1, F.col("out_len"))
    rows = framed.select((split == "train").cast("long").alias("train"), F.inline_outer(steps_in))
    return rows.groupBy("prev", "next").agg(
        F.sum("train").alias("n_train"), F.sum(1 - F.col("train")).alias("n_test"))


def perplexity(counted: DataFrame, vocab_size: int, k: float) -> DataFrame:
    """Masked mean cross-entropy and perplexity of the test split.

    log p = log(n(v,w) + k) - log(n(v) + kV): the first term sums over pairs, the
    second over previous symbols, so one small regrouping replaces the join.
    """
    pair_term = F.col("n_test") * F.log(F.col("n_train") + F.lit(k))
    by_prev = counted.groupBy("prev").agg(
        F.sum("n_test").alias("n_test"), F.sum("n_train").alias("n_train"),
        F.sum(pair_term).alias("pair_term"))
    prev_term = F.col("n_test") * F.log(F.col("n_train") + F.lit(k * vocab_size))
    summed = by_prev.agg(
        F.sum("n_train").alias("n_train"), F.sum("n_test").alias("n_targets"),
        (F.sum(prev_term) - F.sum("pair_term")).alias("nll"))
    cost = F.col("nll") / F.nullif(F.col("n_targets"), F.lit(0))
    return summed.select("n_train", "n_targets", cost.alias("cross_entropy"),
                         F.exp(cost).alias("perplexity"))
