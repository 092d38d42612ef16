"""Row numbers by ranges of the key."""

import random

from lexiframe.plans.ranking import numbered


def test_numbers_follow_the_order(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 1, 1, 2, rng.randrange(50)]), k) for k in range(3000)]
    frame = spark.createDataFrame(rows, "a int, b int").repartition(7)
    got = {(r["a"], r["b"]): r["number"] for r in numbered(frame, ["a", "b"]).collect()}
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [got[r] for r in want] == list(range(3000))


def test_no_rows(spark):
    frame = spark.createDataFrame([], "a int, b int")
    assert numbered(frame, ["a"]).collect() == [] and numbered(frame, ["a"]).columns == ["a", "b", "number"]
