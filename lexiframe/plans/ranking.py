"""Exact global row numbers without a single-task sort."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiframe.plans.layout import written

Level = dict[str, Column]
PLACES = 1 << 33  # of one partition in monotonically_increasing_id


def global_rank(rows: DataFrame, levels: Sequence[Level], order: Sequence[Column],
                descending: Collection[str] = (), rank: str = "rank") -> DataFrame:
    """Add the 1-based rank of each row, sorted by the levels' keys, then `order`.

    Each level splits the buckets of the one before it; the first should have
    few values, and the last should leave few rows per bucket. Rows are sorted
    only inside a bucket of the last level, and a bucket's start is a running
    sum of sizes inside its parent. `order` must be total inside a bucket.
    """
    # One struct column per level: joining on plain columns would test each for
    # NULL below the projection that computes it, and so compute it twice.
    names = [f"_level_{i}" for i in range(len(levels))]
    keyed = rows.withColumns({
        name: F.struct(*[c.alias(n) for n, c in level.items()])
        for name, level in zip(names, levels, strict=True)})
    starts = _starts(keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("_size")),
                     names, levels, descending)
    inside = Window.partitionBy(*names).orderBy(*order)
    return (
        keyed.withColumn("_place", F.row_number().over(inside))
        .join(starts, names)
        .withColumn(rank, (F.col("_start") + F.col("_place")).cast("long"))
        .drop("_start", "_place", *names)
    )


def _starts(sizes: DataFrame, names: Sequence[str], levels: Sequence[Level],
            descending: Collection[str]) -> DataFrame:
    """Rows before each bucket: before it in its parent, plus before the parent."""
    def before(depth: int) -> Column:
        level = names[depth]
        in_turn = [F.col(f"{level}.{key}").desc() if key in descending
                   else F.col(f"{level}.{key}").asc() for key in levels[depth]]
        earlier = Window.partitionBy(*names[:depth]).orderBy(*in_turn).rowsBetween(
            Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_size").over(earlier), F.lit(0))

    last = len(names) - 1
    starts = sizes.select(*names, before(last).alias("_start"))
    for depth in range(last):
        parent = names[:depth + 1]
        whole = sizes.groupBy(*parent).agg(F.sum("_size").alias("_size"))
        starts = (starts.join(whole.select(*parent, before(depth).alias("_before")), parent)
                  .withColumn("_start", F.col("_start") + F.col("_before")).drop("_before"))
    return starts


def numbered(rows: DataFrame, order: Sequence[str], number: str = "number") -> DataFrame:
    """Add the 0-based place of each row under `order`, which must be total.

    Rows are dealt by ranges of `order`, sorted in their partitions and written with their place
    there; a partition's start is the running sum of sizes. Two shuffles, one of which moves a row
    per partition, and one size per partition comes to the driver.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = written(ranged.withColumn("_place", F.monotonically_increasing_id()), "numbered")
    part = F.expr(f"_place DIV {PLACES}")
    sizes = kept.groupBy(part.alias("part")).count().orderBy("part").collect()
    starts, start = [], 0
    for row in sizes:
        starts.append((row["part"], start))
        start += row["count"]
    table = rows.sparkSession.createDataFrame(starts, "_part long, _start long")
    return (kept.withColumn("_part", part).join(F.broadcast(table), "_part")
            .withColumn(number, F.col("_start") + F.col("_place") % PLACES).drop("_part", "_start", "_place"))
