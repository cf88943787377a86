"""Equi-joins by a named strategy.

The output has the left key, then all other columns; names that both sides have become left_x and right_x, and the right
key is dropped. Null keys match each other in hash joins (`null_safe`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnworks.session import plan_bytes

#: A side is broadcast only if Catalyst's estimate of it is at most this many bytes.
BROADCAST_BYTES = 64 << 20


def _how(how: str) -> str:
    if how not in ("inner", "left"):
        raise ValueError(f"join type {how!r} is neither inner nor left")
    return how


def _joined(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str, preserved: str, null_safe: bool) -> DataFrame:
    both = {c for c in left.columns if c != left_key} & {c for c in right.columns if c != right_key}
    l_names = [f"left_{c}" if c in both else c for c in left.columns if c != left_key]
    r_names = [f"right_{c}" if c in both else c for c in right.columns if c != right_key]
    left_side = left.select(F.col(left_key).alias("__l"), *[F.col(c).alias(f"left_{c}" if c in both else c) for c in left.columns if c != left_key])
    right_side = right.select(F.col(right_key).alias("__r"), *[F.col(c).alias(f"right_{c}" if c in both else c) for c in right.columns if c != right_key])
    on: Column = F.col("__l").eqNullSafe(F.col("__r")) if null_safe else F.col("__l") == F.col("__r")
    if preserved == "right":
        out = right_side.join(left_side, on, how)
        return out.select(F.coalesce("__l", "__r").alias(left_key), *l_names, *r_names)
    return left_side.join(right_side, on, how).select(F.col("__l").alias(left_key), *l_names, *r_names)


def broadcast_hash_join(small: DataFrame, large: DataFrame, small_key: str, large_key: str | None = None, how: str = "inner", null_safe: bool = False) -> DataFrame:
    """Joins with the small side broadcast if its size allows, and as Catalyst sees fit beyond that. `left` keeps every row of the large side."""
    small = F.broadcast(small) if plan_bytes(small) <= BROADCAST_BYTES else small
    return _joined(small, large, small_key, large_key or small_key, _how(how), "right", null_safe)


def partitioned_hash_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str | None = None, how: str = "inner", null_safe: bool = False) -> DataFrame:
    """Joins both sides hashed by key; `left` keeps every left row."""
    return _joined(left, right.hint("shuffle_hash"), left_key, right_key or left_key, _how(how), "left", null_safe)


def sort_merge_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str | None = None, how: str = "inner") -> DataFrame:
    """Joins both sides sorted by key; `left` keeps every left row. Null keys match nothing."""
    return _joined(left, right.hint("merge"), left_key, right_key or left_key, _how(how), "left", False)


def compare_join_strategies(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of each strategy's inner join, and rows that one of the others lacks."""
    joins = {"broadcast": broadcast_hash_join(left, right, key), "partitioned": partitioned_hash_join(left, right, key), "sort_merge": sort_merge_join(left, right, key)}
    base = joins["broadcast"]
    out = None
    for name, df in joins.items():
        off = df.exceptAll(base).union(base.exceptAll(df)).agg(F.count("*").alias("differing"))
        row = df.agg(F.count("*").alias("n_rows")).crossJoin(off).select(F.lit(name).alias("strategy"), "n_rows", "differing")  # one row each
        out = row if out is None else out.union(row)
    return out


def partition_dataset(df: DataFrame, key: str, n: int) -> DataFrame:
    """df with part, its key's hash bucket; rows without a key are left out."""
    return df.where(F.col(key).isNotNull()).withColumn("part", F.pmod(F.hash(key), F.lit(n)))


def sort_dataset(df: DataFrame, key: str, tie: str) -> DataFrame:
    """Ordered by key, rows without one last."""
    return df.orderBy(F.asc_nulls_last(key), F.asc(tie))


def is_sorted(df: DataFrame, key: str, order: str, group: str | None = None) -> DataFrame:
    """Whether key never descends along order, within each group."""
    before = F.max(key).over(Window.partitionBy(*([group] if group else [])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    got = df.where(F.col(key).isNotNull()).withColumn("__ok", (before.isNull()) | (F.col(key) >= before))
    return (got.groupBy(group) if group else got.groupBy()).agg(F.min("__ok").alias("sorted"))
