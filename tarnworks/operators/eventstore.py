"""Event stores: versions, projections, time travel and snapshots over (event_id, stream_id, event_type, ...)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnworks.session import shared_dir


def with_versions(events: DataFrame) -> DataFrame:
    return events.withColumn("version", F.row_number().over(Window.partitionBy("stream_id").orderBy("event_id")))


def stream_versions(events: DataFrame) -> DataFrame:
    return events.groupBy("stream_id").agg(F.count("*").alias("version"), F.min("event_id").alias("first_event"))


def read_stream(events: DataFrame, stream_id: object, from_event: int = 0) -> DataFrame:
    return events.where((F.col("stream_id") == F.lit(stream_id)) & (F.col("event_id") >= from_event)).orderBy("event_id")


def live_projection(events: DataFrame, folds: dict[str, Column], label: str = "projection") -> DataFrame:
    """State per stream by a streaming aggregation over all events there are now; events is a stream, and its end state is returned.

    Each trigger's state replaces the one before, in the shared folder, so a restarted query goes on from its checkpoint.
    """
    spark = events.sparkSession
    where = f"{shared_dir(spark)}/tarnworks/{label}-{uuid.uuid4().hex}"
    state = events.groupBy("stream_id").agg(*[c.alias(n) for n, c in folds.items()], F.max("event_id").alias("position"))
    # the newest trigger's table is the state; older ones are kept until the next has been written
    put = lambda batch, n: batch.write.mode("overwrite").parquet(f"{where}/state/{n % 2}")
    run = state.writeStream.outputMode("complete").option("checkpointLocation", f"{where}/checkpoint").foreachBatch(put).trigger(availableNow=True).start()
    run.awaitTermination()
    last = run.lastProgress["batchId"] if run.lastProgress else None
    return spark.createDataFrame([], state.schema) if last is None else spark.read.schema(state.schema).parquet(f"{where}/state/{last % 2}")


def version_conflicts(appends: DataFrame) -> DataFrame:
    """appends with expected_version: those whose stream had another version when they came."""
    return with_versions(appends).where(F.col("expected_version").isNotNull() & (F.col("expected_version") != F.col("version") - 1))


def project(events: DataFrame, folds: dict[str, Column], up_to: int | None = None) -> DataFrame:
    """State per stream by algebraic folds, as of an event id if given, with the position reached."""
    seen = events if up_to is None else events.where(F.col("event_id") <= up_to)
    return seen.groupBy("stream_id").agg(*[c.alias(n) for n, c in folds.items()], F.max("event_id").alias("position"))


def balances(events: DataFrame) -> DataFrame:
    """(stream_id, state): the sum of the amounts in order of events, kept at 0 or more after each; null amounts add nothing.

    A run of events with the sum s, whose least sum of first amounts is m, makes max(x + s, s - m) of x. A stream's events
    are dealt over ranges, so a long one is many runs; a stream has a row of two numbers for each range it is in.
    """
    amount = F.coalesce(F.col("amount"), F.lit(0)).cast("long")
    dealt = events.select("stream_id", "event_id", amount.alias("amount")).repartitionByRange("stream_id", "event_id", "amount").withColumn("run", F.spark_partition_id())
    so_far = F.sum("amount").over(Window.partitionBy("stream_id", "run").orderBy("event_id", "amount").rowsBetween(Window.unboundedPreceding, 0))
    runs = dealt.withColumn("so_far", so_far).groupBy("stream_id", "run").agg(F.sum("amount").alias("s"), F.min("so_far").alias("m"))
    rows = runs.groupBy("stream_id").agg(F.sort_array(F.collect_list(F.struct("run", "s", "m"))).alias("rows"))
    step = lambda x, r: F.greatest(x + r["s"], r["s"] - r["m"])
    return rows.select("stream_id", F.aggregate("rows", F.lit(0).cast("long"), step).alias("state"))


def snapshot_plus_tail(snapshot: DataFrame, tail: DataFrame, sums: list[str], position: str = "position") -> DataFrame:
    """Adds a tail's state to a snapshot's for columns that add up."""
    return snapshot.unionByName(tail).groupBy("stream_id").agg(*[F.sum(c).alias(c) for c in sums], F.max(position).alias(position))
