"""Running sums and neighbours in a global order, without one task per group.

A window over a group puts the whole group into one task.  Here rows are range
partitioned by the order and written once with their partition's number; windows
run inside partitions, and one row per partition (and group) carries sums or
border rows across.  A group of any share of the table is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.plans.lineage import written

PART = "part_"


def ranged(df: DataFrame, order: list[str], label: str) -> DataFrame:
    """``df`` written in range partitions of ``order``, with the partition's number in ``part_``."""
    return written(df.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()), label)


def running_sum(df: DataFrame, group: str, order: list[str], value: str, name: str, label: str = "sums") -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its group up to this one. ``order`` must tell rows apart."""
    rows = ranged(df, [group, *order], label)
    inner = Window.partitionBy(PART, group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("g_").orderBy("p_").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(F.col(PART).alias("p_"), F.col(group).alias("g_")).agg(F.sum(value).alias("s_"))
    sums = sums.select("p_", "g_", F.coalesce(F.sum("s_").over(before), F.lit(0)).alias("o_"))
    joined = rows.withColumn(name, F.sum(value).over(inner)).join(sums, (F.col(PART) == F.col("p_")) & F.col(group).eqNullSafe(F.col("g_")))
    return joined.withColumn(name, F.col(name) + F.col("o_")).drop(PART, "p_", "g_", "o_")


def neighbours(df: DataFrame, group: str, order: list[str], carried: list[str], label: str = "order") -> DataFrame:
    """``df`` with structs ``previous`` and ``following`` of ``carried`` from the rows beside it in its group, null at the ends."""
    rows = ranged(df, [group, *order], label)
    row = F.struct(F.col(group).alias("g_"), *carried)
    inner = Window.partitionBy(PART).orderBy(group, *order)
    place = F.struct(group, *order)
    ends = rows.groupBy(F.col(PART).alias("p_")).agg(F.min_by(row, place).alias("first_"), F.max_by(row, place).alias("last_"))
    parts = Window.orderBy("p_")
    ends = ends.select("p_", F.lag("last_").over(parts).alias("before_"), F.lead("first_").over(parts).alias("after_"))
    beside = rows.withColumn("previous", F.lag(row).over(inner)).withColumn("following", F.lead(row).over(inner))
    beside = beside.join(F.broadcast(ends), F.col(PART) == F.col("p_"))

    def same(one: Column, border: str) -> Column:
        found = F.coalesce(one, F.col(border))
        return F.when(found["g_"].eqNullSafe(F.col(group)), found)

    return beside.withColumn("previous", same(F.col("previous"), "before_")).withColumn("following", same(F.col("following"), "after_")).drop(PART, "p_", "before_", "after_")
