"""Merkle trees over ordered leaves: roots, proofs and differences.

A node is sha256 over its children's hex digests, left then right; missing leaves are sha256 of the empty string. Levels are built by
one aggregation each, so a tree of n leaves takes log2(n) small steps on ever fewer rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def levels(leaves: DataFrame, n: int) -> list[DataFrame]:
    """Tables (idx, hash) from the leaves (idx from 0, data) to the root; n is the number of leaves."""
    size = 1 << max(0, (n - 1).bit_length())
    level = leaves.select(F.col("idx").cast("long").alias("idx"), F.sha2("data", 256).alias("hash"))
    pad = leaves.sparkSession.range(n, size).select(F.col("id").alias("idx"), F.lit(EMPTY).alias("hash"))
    out = [level.unionByName(pad)]
    while size > 1:
        size //= 2
        out.append(out[-1].groupBy(F.floor(F.col("idx") / 2).cast("long").alias("idx")).agg(F.sha2(F.concat(F.min_by("hash", "idx"), F.max_by("hash", "idx")), 256).alias("hash")))
    return out


def root(leaves: DataFrame, n: int) -> DataFrame:
    return levels(leaves, n)[-1].select(F.col("hash").alias("root_hash"))


def proof(leaves: DataFrame, n: int, idx: int) -> DataFrame:
    """(level, idx, hash) of the siblings on the way from a leaf to the root."""
    if not 0 <= idx < n:
        raise IndexError(idx)
    out = None
    for k, level in enumerate(levels(leaves, n)[:-1]):
        row = level.where(F.col("idx") == ((idx >> k) ^ 1)).select(F.lit(k).alias("level"), "idx", "hash")
        out = row if out is None else out.unionByName(row)
    return out if out is not None else leaves.sparkSession.createDataFrame([], "level int, idx long, hash string")


def verify(leaf: DataFrame, path: DataFrame, root_hash: DataFrame) -> DataFrame:
    """(valid): whether a leaf (idx, data) and its proof (level, idx, hash) give the root (root_hash). A proof has a row for each level."""
    steps = path.agg(F.sort_array(F.collect_list(F.struct("level", F.col("idx").alias("at"), "hash"))).alias("steps"))
    up = lambda h, s: F.sha2(F.when(s["at"] % 2 == 1, F.concat(h, s["hash"])).otherwise(F.concat(s["hash"], h)), 256)
    one = leaf.select("data").crossJoin(steps).crossJoin(root_hash.select("root_hash"))  # one row each
    return one.select((F.aggregate("steps", F.sha2("data", 256), up) == F.col("root_hash")).alias("valid"))


def update_leaf(leaves: DataFrame, idx: int, data: str) -> DataFrame:
    return leaves.withColumn("data", F.when(F.col("idx") == idx, F.lit(data)).otherwise(F.col("data")))


def diff_descend(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """Indices of differing leaves of two trees of n leaves, from the root down: only children of differing nodes are compared."""
    below = None
    for x, y in zip(reversed(levels(a, n)), reversed(levels(b, n)), strict=True):
        if below is not None:
            x = x.join(below, F.floor(F.col("idx") / 2) == F.col("up"), "left_semi")
        below = x.join(y.withColumnRenamed("hash", "other"), "idx").where("hash <> other").select(F.col("idx").alias("up"))
    return below.select(F.col("up").alias("idx"))


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Indices of leaves that differ, by position."""
    x = a.select("idx", F.sha2("data", 256).alias("x"))
    y = b.select("idx", F.sha2("data", 256).alias("y"))
    return x.join(y, "idx", "full").where(~F.col("x").eqNullSafe(F.col("y"))).select("idx")


def diff_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, change) of keyed pairs (key, value), aligned by key: added, removed or changed."""
    j = a.select("key", F.col("value").alias("x"), F.lit(1).alias("in_a")).join(b.select("key", F.col("value").alias("y"), F.lit(1).alias("in_b")), "key", "full")
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(~F.col("x").eqNullSafe(F.col("y")), "changed")
    return j.select("key", change.alias("change")).where("change IS NOT NULL")
