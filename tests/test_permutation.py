"""Epoch orders by a keyed permutation of row numbers."""

import re

import pytest
from pyspark.sql import functions as F

from lexiframe.functions.hashing import feistel_sides, permuted
from lexiframe.operators import framing


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 16, 17, 97, 1000, 10_007])
def test_every_place_once(spark, n):
    rows, columns = feistel_sides(n)
    assert n <= rows * columns < n + max(rows, columns) + 1
    found = [r[0] for r in spark.range(n).select(permuted(F.col("id"), n, 1, 0)).collect()]
    assert sorted(found) == list(range(n))
    if n > 90:
        other = [r[0] for r in spark.range(n).select(permuted(F.col("id"), n, 1, 1)).collect()]
        assert sum(a == b for a, b in zip(found, other)) < 12 and sum(k == a for k, a in enumerate(found)) < 12


def test_second_epoch_has_no_exchange(spark):
    rows = framing.numbered_rows(spark.range(1000).select(F.col("id").alias("key")), ["key"])
    for epoch in (0, 1):
        batches = framing.permuted_batches(rows, 1000, 64, epoch)
        plan = batches._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"(?<!Broadcast)Exchange \w+partitioning", plan) and "Sort" not in plan
        seen = {(r["batch_id"], r["row_in_batch"]): r["key"] for r in batches.collect()}
        assert sorted(seen) == [(k // 64, k % 64) for k in range(1000)] and len(set(seen.values())) == 1000
    assert framing.permuted_batches(rows, 1000, 64, 2, drop_last=True).count() == 15 * 64
