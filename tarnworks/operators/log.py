"""Partitioned logs: placement, offsets, compaction, retention, consumer groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnworks.functions.ordered import with_running


def md5_bucket(key: Column, n: int) -> Column:
    """The 128-bit md5 of key modulo n, for n up to 128."""
    acc = F.lit(0).cast("long")
    for i in range(4):
        acc = (acc * F.lit(4294967296) + F.conv(F.substring(F.md5(key), 1 + 8 * i, 8), 16, 10).cast("long")) % n
    return acc.cast("int")


def assign(messages: DataFrame, n: int, order: str = "ts_order") -> DataFrame:
    """messages (key, topic, ...) with part: by key, or dealt round in arrival order per topic for null keys."""
    keyed = messages.where("key IS NOT NULL").withColumn("part", md5_bucket(F.col("key"), n))
    keyless = with_running(messages.where("key IS NULL"), order, F.lit(1).cast("long"), "sum", "__nth", True, ("topic",))
    return keyed.unionByName(keyless.withColumn("part", F.pmod(F.col("__nth") - 1, F.lit(n)).cast("int")).drop("__nth"))


def with_offsets(placed: DataFrame, order: str = "ts_order") -> DataFrame:
    return with_running(placed, order, F.lit(1).cast("long"), "sum", "log_offset", True, ("topic", "part")).withColumn("log_offset", F.col("log_offset") - 1)


def compact(log: DataFrame) -> DataFrame:
    """The last message of each key in each partition, and all without a key."""
    rest = [c for c in log.columns if c not in ("topic", "part", "key")]
    keyed = log.where("key IS NOT NULL").groupBy("topic", "part", "key").agg(F.max_by(F.struct(*rest), "log_offset").alias("x")).select("topic", "part", "key", "x.*")
    return keyed.unionByName(log.where("key IS NULL"))


def retain_size(log: DataFrame, most: int) -> DataFrame:
    """The last `most` offsets of each partition."""
    last = log.groupBy("topic", "part").agg(F.max("log_offset").alias("last"))
    return log.join(F.broadcast(last) if most else last, ["topic", "part"]).where(F.col("log_offset") > F.col("last") - most).drop("last")


def retain_time(log: DataFrame, cutoff: Column, ts: str) -> DataFrame:
    """Drops the leading messages before the first whose time reaches the cutoff."""
    first = log.where(F.col(ts) >= cutoff).groupBy("topic", "part").agg(F.min("log_offset").alias("first"))
    return log.join(first, ["topic", "part"]).where(F.col("log_offset") >= F.col("first")).drop("first")


def offsets(log: DataFrame) -> DataFrame:
    return log.groupBy("topic", "part").agg(F.min("log_offset").alias("earliest"), (F.max("log_offset") + 1).alias("latest"), F.count("*").alias("size"))


def group_assignment(parts: DataFrame, consumers: DataFrame) -> DataFrame:
    """Partitions in order of (topic, part), dealt round to consumers in order of their ids."""
    p = parts.select("topic", "part").distinct().withColumn("rn", F.row_number().over(Window.orderBy("topic", "part")) - 1)
    c = consumers.select("consumer").distinct().withColumn("cn", F.row_number().over(Window.orderBy("consumer")) - 1)
    n = c.agg(F.count("*").alias("n"))
    return p.crossJoin(F.broadcast(n)).join(c, F.pmod("rn", "n") == F.col("cn")).select("topic", "part", "consumer")  # n is one row


def poll(log: DataFrame, start: DataFrame, most: int) -> DataFrame:
    """Up to `most` messages from each consumer's positions (topic, part, position), in partition and offset order."""
    return log.join(start, ["topic", "part"]).where(F.col("log_offset") >= F.col("position")).orderBy("topic", "part", "log_offset").limit(most)
