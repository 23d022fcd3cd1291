"""Sums over the order of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.sources.tables import save


def prefix_sums(rows: DataFrame, amount: str, order: list[str]) -> DataFrame:
    """before: the sum of `amount` over all rows that stand earlier in the order of columns, without one sorted task.

    Rows are dealt out by ranges of the order, of any type, and written with the number of their range; a sum for each
    range is then added to the running sums inside. Rows that are equal in all the columns stand in any order.
    """
    dealt = save(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_range").agg(F.sum(amount).alias("_sum"))  # a row for each range
    ahead = totals.select("_range", (F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum")).alias("_ahead"))
    running = F.coalesce(F.sum(amount).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("_inside", running).join(F.broadcast(ahead), "_range").withColumn("before", F.col("_ahead") + F.col("_inside")).drop("_range", "_inside", "_ahead")
