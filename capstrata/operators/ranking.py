"""Running totals and ranks within groups of any size: a hot group is worked on by many tasks.

A window over a group is one task's work. Where the largest group is small that is the plan; else rows are dealt to
ranges by group and order, each range is summed by itself, and a group's ranges get the sums of those before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capstrata.session import materialised

#: Rows of the largest group that one task may order.
AT_ONCE = 100_000


def running_total(rows: DataFrame, keys: list[str], order: list[str], amount: Column, name: str = "before", at_once: int = AT_ONCE) -> DataFrame:
    """rows with the sum of the amount (never null) over the rows of the same keys that come before in order.

    The order is total within keys, or rows that tie must not differ in what they sum. Nulls in keys are one group,
    in the order they come first.
    """
    rows = rows.withColumn("__amount", amount)
    largest = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    earlier = F.coalesce(F.sum("__amount").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if largest <= at_once:
        return rows.withColumn(name, earlier).drop("__amount")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # materialised, so that the range of a row stays what it is
    ranged = materialised(rows.repartitionByRange(max(parts, -(-largest // at_once)), *keys, *order).withColumn("__range", F.spark_partition_id()))
    sums = ranged.groupBy("__range", *keys).agg(F.sum("__amount").alias("__sum"))  # a group has as many rows here as it has ranges
    ranges = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    start = materialised(sums.withColumn("__start", F.coalesce(F.sum("__sum").over(ranges), F.lit(0))).drop("__sum"))
    here = Window.partitionBy("__range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.withColumn("__within", F.coalesce(F.sum("__amount").over(here), F.lit(0)))
    on = [ranged["__range"] == start["__range"], *(within[k].eqNullSafe(start[k]) for k in keys)]
    return within.join(start, on).select(*(within[c] for c in rows.columns if c != "__amount"), (F.col("__start") + F.col("__within")).alias(name))


def ranked(rows: DataFrame, keys: list[str], order: list[str], name: str = "rank", at_once: int = AT_ONCE) -> DataFrame:
    """rows with their place within keys, from 1."""
    return running_total(rows, keys, order, F.lit(1).cast("long"), name, at_once).withColumn(name, F.col(name) + 1)


def medians(rows: DataFrame, key: str, value: str, name: str, at_once: int = AT_ONCE) -> DataFrame:
    """(key, name): the exact median of the values of each key that are not null, the mean of the middle two of an even number.

    Equal values are counted before anything is ordered, so a value that many rows have is one row. Keys without values
    have no row.
    """
    counted = materialised(rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("__n")))
    totals = counted.groupBy(key).agg(F.sum("__n").alias("__all"))
    placed = running_total(counted, [key], [value], F.col("__n"), "__before", at_once).join(totals, key)
    low, high = F.floor((F.col("__all") - 1) / 2), F.floor(F.col("__all") / 2)
    holds = lambda place: (F.col("__before") <= place) & (place < F.col("__before") + F.col("__n"))
    middle = placed.where(holds(low) | holds(high))
    return middle.groupBy(key).agg(((F.min(value).cast("double") + F.max(value).cast("double")) / 2).alias(name))
