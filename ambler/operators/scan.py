"""Prefix sums over a whole table without a window over all its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import checkpoint

#: Width of the key ranges whose sums are taken apart.
BLOCK = 1 << 16


def exclusive_scan(df: DataFrame, key: str, value: str, out: str, block: int = BLOCK) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over rows of smaller integer ``key`` (unique).

    Key ranges are summed in parallel, then the sums of ranges, one row each, in order.
    """
    rows = df.withColumn("__scan_block", F.floor(F.col(key) / block))
    totals = rows.groupBy("__scan_block").agg(F.sum(value).alias("__scan_sum"))
    before = Window.orderBy("__scan_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__scan_block", F.coalesce(F.sum("__scan_sum").over(before), F.lit(0)).alias("__scan_before"))
    inside = Window.partitionBy("__scan_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__scan_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.join(totals, "__scan_block").withColumn(out, (F.col("__scan_inside") + F.col("__scan_before")).cast("long")).drop("__scan_block", "__scan_inside", "__scan_before")


def numbered(df: DataFrame, out: str, *order) -> DataFrame:
    """Adds ``out``: each row's 0-based place in an order, without a window over all rows.
    Rows are dealt to tasks by ranges of the order and counted there."""
    rows = checkpoint(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    rows = rows.withColumn("__part", F.shiftright("__at", 33))
    parts = rows.groupBy("__part").agg(F.count("*").alias("__n"))  # a row for each task
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return rows.join(F.broadcast(parts), "__part").withColumn(out, F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at", "__part", "__before")


def running(df: DataFrame, by: str, order: list[str], value: Column, out: str, spread: str | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over rows of the same ``by`` up to and with each row.

    With ``spread``, an integer column that the order begins with, rows of one ``by`` are
    dealt to tasks by ranges of it, and only the sums of ranges are gathered."""
    upto = lambda *keys: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if spread is None:
        return df.withColumn(out, F.sum(value).over(upto(by)))
    rows = df.withColumn("__range", F.floor(F.col(spread) / BLOCK))
    sums = rows.groupBy(by, "__range").agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(by, "__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    return rows.withColumn("__inside", F.sum(value).over(upto(by, "__range"))).join(sums, [by, "__range"]).withColumn(out, F.col("__before") + F.col("__inside")).drop("__range", "__inside", "__before")
