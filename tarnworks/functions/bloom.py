"""Bloom filters as sets of bit positions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parameters(n: int, p: float) -> tuple[int, int]:
    """Bits and hash functions for n items at a false-positive rate of p."""
    m = math.ceil(-n * math.log(p) / math.log(2) ** 2)
    return m, max(1, round(m / n * math.log(2)))


def _little_endian(hex16: Column) -> Column:
    return F.conv(F.concat(*[F.substring(hex16, 15 - 2 * i, 2) for i in range(8)]), 16, 10).cast("decimal(20,0)")


def positions(item: Column, m: int, k: int) -> Column:
    """The k positions of an item, from the two little-endian halves of its md5."""
    h = F.md5(item)
    h1, h2 = _little_endian(F.substring(h, 1, 16)), _little_endian(F.substring(h, 17, 16))
    return F.array(*[((h1 + h2 * F.lit(i).cast("decimal(3,0)")) % F.lit(m).cast("decimal(20,0)")).cast("int") for i in range(k)])


def build(items: DataFrame, item: str, m: int, k: int) -> DataFrame:
    """(pos, n): set bits with their counts; a counting filter, and without n a plain one."""
    return items.select(F.explode(positions(F.col(item), m, k)).alias("pos")).groupBy("pos").agg(F.count("*").alias("n"))


def counting(filter_: DataFrame, bits: int = 4) -> DataFrame:
    """Counters that stop at 2 ** bits - 1."""
    return filter_.select("pos", F.least("n", F.lit(2**bits - 1).cast("long")).alias("n"))


def remove(counters: DataFrame, removed: DataFrame, bits: int = 4) -> DataFrame:
    """Counters less those of removed items; one that has stopped at its greatest value stays, and none goes below 0."""
    x = counters.join(removed.select("pos", F.col("n").alias("gone")), "pos", "left")
    left = F.when(F.col("n") >= 2**bits - 1, F.col("n")).otherwise(F.greatest(F.col("n") - F.coalesce("gone", F.lit(0)), F.lit(0).cast("long")))
    return x.select("pos", left.alias("n")).where("n > 0")


def probe(items: DataFrame, item: str, filter_: DataFrame, m: int, k: int) -> DataFrame:
    """The distinct items all of whose positions are set."""
    asked = items.select(F.col(item).alias(item)).distinct().select(item, F.explode(F.array_distinct(positions(F.col(item), m, k))).alias("pos"))
    hit = asked.join(filter_.select("pos", F.lit(1).alias("set")), "pos", "left")
    return hit.groupBy(item).agg(F.count("*").alias("n"), F.count("set").alias("found")).where("n = found").select(item)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("pos").agg(F.sum("n").alias("n"))


def estimates(filter_: DataFrame, m: int, k: int) -> DataFrame:
    x = F.count("*")
    return filter_.agg(x.alias("bits_set"), F.round(x / m, 9).alias("density"), F.round(F.pow(x / m, F.lit(k)), 9).alias("fp_rate"), F.round(F.when(x == m, F.lit(float("inf"))).otherwise(-F.lit(m / k) * F.log(1 - x / m)), 4).alias("n_estimate"))


def slices(items: DataFrame, order: str, capacity: int, growth: int = 2) -> DataFrame:
    """Items with the slice of a scalable filter that takes each: slice i holds capacity * growth ** i items in arrival order, per group of `order`'s partition."""
    n = F.row_number().over(Window.partitionBy("grp").orderBy(order))
    at = F.floor(F.log(float(growth), (n - 1) * (growth - 1) / capacity + 1) + F.lit(1e-12)).cast("int")
    return items.withColumn("slice", at)
