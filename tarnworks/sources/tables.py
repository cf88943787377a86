"""Readers of the input tables and the inputs derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table's files as a stream; the table is a file or a folder of files."""
    static = table(spark, sf_dir, name)
    return spark.readStream.schema(static.schema).parquet(f"{sf_dir}/{name}.parque[t]")  # a pattern, since a plain path must be a folder


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without a time zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), ts)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no from 1, text) of text files, in file and line order; numbers are counted per file, so no global sort is needed."""
    rows = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"))
    part = F.shiftright("at", 33)
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = {r["part"]: r["n"] for r in counts.collect()}  # a number for each input split
    start, total = {}, 0
    for p in sorted(before):
        start[p], total = total, total + before[p]
    offsets = spark.createDataFrame(list(start.items()) or [(0, 0)], "part long, start long")
    numbered = rows.withColumn("part", part).join(F.broadcast(offsets), "part")
    return numbered.select((F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("line_no"), F.col("value").alias("text"))


def changelog(events: DataFrame) -> DataFrame:
    """Events as a changelog: seq, key, op (PUT, or DELETE for errors), value, num."""
    return events.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").cast("string").alias("key"),
        F.when(F.col("event_type") == "error", "DELETE").otherwise("PUT").alias("op"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("value"),
    )


#: The same input for DuckDB.
CHANGELOG_SQL = "SELECT event_id AS seq, user_id::VARCHAR AS key, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'PUT' END AS op, CASE WHEN event_type <> 'error' THEN event_type END AS value FROM events"
