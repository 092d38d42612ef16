"""Join facts to a lookup table whose size and hot keys are checked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 1024 * 1024
ROW_OVERHEAD = 48


def table_size(table: DataFrame) -> tuple[int, int]:
    """Rows and bytes in memory of a written table: one small aggregate over it."""
    widths = F.lit(ROW_OVERHEAD)
    for field in table.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            widths = widths + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif isinstance(field.dataType, T.ArrayType):
            widths = widths + 8 * F.coalesce(F.size(field.name), F.lit(0))
        else:
            widths = widths + 8
    row = table.agg(F.count(F.lit(1)), F.sum(widths.cast("long"))).first()
    return row[0], row[1] or 0


def hot_rows(table: DataFrame, hot: Callable[[int], Column], limit: int) -> int:
    """The largest tried n for which the rows `hot(n)` fit the limit."""
    rows, size = table_size(table)
    n = limit * rows // size
    while n and table_size(table.filter(hot(n)))[1] > limit:
        n //= 2
    return n


def lookup(facts: DataFrame, table: DataFrame, key: str, hot: Callable[[int], Column],
           limit: int = BROADCAST_BYTES, home: str | None = None) -> DataFrame:
    """Left join of `facts` to `table` (unique on `key`, already written).

    A table under `limit` bytes is broadcast. A larger one is cut in two by
    `hot(n)`, which selects the n most frequent keys, with n measured to fit:
    that part is broadcast and settles the bulk of the facts where they lie;
    only facts with other keys shuffle to the rest, so no hot key ever does.

    Facts that lie together by `home` (a document) stay there: the distinct other
    keys of each home go out, and what they find comes back as one map per home.
    """
    if table_size(table)[1] <= limit:
        return facts.join(F.broadcast(table), key, "left")
    chosen = hot(hot_rows(table, hot, limit))
    head = table.filter(chosen).withColumn("_hot", F.lit(True))
    near = facts.join(F.broadcast(head), key, "left")
    settled = F.col("_hot").isNotNull() | F.col(key).isNull()
    rest = table.filter(~chosen).hint("merge")
    if home is not None:
        values = [c for c in table.columns if c != key]
        found = near.filter(~settled).select(home, key).distinct().join(rest, key)
        maps = found.groupBy(home).agg(F.map_from_entries(F.collect_list(
            F.struct(F.col(key), F.struct(*values)))).alias("_rest"))
        both = near.drop("_hot").join(maps, home, "left")
        return both.withColumns({
            v: F.coalesce(F.col(v), F.col("_rest")[F.col(key)][v]) for v in values}).drop("_rest")
    far = near.filter(~settled).select(*facts.columns)
    return near.filter(settled).drop("_hot").unionByName(
        far.join(rest, key, "left"))
