"""Running totals without a single sorted task, and prefixes under a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.sources.checkpoints import settle


#: Rows of a range, about, and rows that are put in order in one task at most.
RANGE_ROWS, FEW = 200_000, 10_000


def running_sum(df: DataFrame, key: str, amount: str, total: str = "running", ranges: int | None = None) -> DataFrame:
    """``df`` with the sum of ``amount`` up to each row in the order of ``key``.

    Rows are dealt out by ranges of the key; each range is summed alone, and the
    sums of the ranges before it (one row a range) are added. No task sees more
    than its range, unlike a window over the whole table. There are as many ranges as the
    rows need, if their number isn't given.
    """
    ranges = ranges or max(1, -(-df.count() // RANGE_ROWS))
    # kept once: a second computation might draw other limits of the ranges
    dealt = settle(df.repartitionByRange(ranges, key).withColumn("_range", F.spark_partition_id()))
    # equal keys lie in one range, and ranges follow the key
    local = dealt.withColumn("_local", F.sum(amount).over(Window.partitionBy("_range").orderBy(key)))
    sums = dealt.groupBy("_range").agg(F.sum(amount).alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    return local.join(F.broadcast(before), "_range").withColumn(total, F.col("_local") + F.col("_before")).drop("_range", "_local", "_before")


def budget_prefix(df: DataFrame, key: str, amount: str, budget: int, items: int | None = None) -> DataFrame:
    """Rows in key order as long as their amounts fit the budget, at most ``items``, with the running sum.

    A row that alone exceeds the budget is left out and does not count; the first
    other row that doesn't fit ends the prefix.
    """
    fitting = df.where(F.coalesce(F.col(amount), F.lit(0)) <= budget)
    if items is not None and items <= FEW:
        first = fitting.orderBy(key).limit(items)
        return first.withColumn("running", F.sum(amount).over(Window.orderBy(key))).where(F.col("running") <= budget)
    within = running_sum(fitting, key, amount).where(F.col("running") <= budget)
    return within if items is None else within.orderBy(key).limit(items)
