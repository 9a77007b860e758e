"""Array and number helpers of a sampler: membership, places, powers, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains(array, value) -> Column:
    """Whether a sorted or unsorted array holds a value; false for a null array."""
    return F.coalesce(F.array_contains(array, value), F.lit(False))


def place(array, value) -> Column:
    """The first 0-based place of a value, or null."""
    at = F.array_position(array, value)
    return F.when(at > 0, at - 1).cast("int")


def prefix_sums(array) -> Column:
    """Inclusive prefix sums of an array of doubles."""
    start = F.struct(F.array().cast("array<double>").alias("s"), F.lit(0.0).alias("t"))
    step = lambda acc, x: F.struct(F.concat(acc["s"], F.array(acc["t"] + x)).alias("s"), (acc["t"] + x).alias("t"))
    return F.aggregate(array, start, step, lambda acc: acc["s"])


def next_power_of_two(n: Column) -> Column:
    """The least power of two that is at least n; 1 for n below 2."""
    return F.when(n <= 1, 1).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(n)))).cast("long")


def div_up(a: Column, b: Column) -> Column:
    return F.ceil(a / b).cast("long")


def round_up(a: Column, b: Column) -> Column:
    return div_up(a, b) * b
