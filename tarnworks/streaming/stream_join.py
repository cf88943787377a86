"""Windowed join of two event streams: the exact form over recorded arrivals, and the live form over streams.

Exact semantics, by arrival number seq: an event is late, and dropped, if its time is below the watermark (the greatest time
of all earlier arrivals of both sides) less the allowed lateness. Two accepted events of one key match if their times differ by
at most the window and the first is not yet expired when the second arrives: expiry doesn't wait for the lateness.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnworks.functions.ordered import with_running


def with_watermark_before(events: DataFrame) -> DataFrame:
    """events (seq, side L or R, k, ts as long) with wb, the watermark before each arrival."""
    return with_running(events, "seq", F.col("ts"), "max", "wb", inclusive=False)


def accepted(events: DataFrame, lateness: int) -> DataFrame:
    return with_watermark_before(events).where(F.col("wb").isNull() | (F.col("ts") >= F.col("wb") - lateness))


def stream_join_exact(events: DataFrame, window: int, lateness: int, how: str = "inner", advance_to: int | None = None) -> DataFrame:
    """(left_seq, right_seq, join_ts) of matches and, for left and full, of expired events without one. how: inner, left or full.

    advance_to moves the watermark forward after the last arrival, so that events before it expire too; it never moves back.

    The band is met through time buckets as wide as it, so that a hot key's pairs are dealt by time too.
    """
    if how not in ("inner", "left", "full"):
        raise ValueError(f"join type {how!r} is neither inner, left nor full")
    a = accepted(events, lateness).withColumn("cell", F.floor(F.col("ts") / max(1, window)).cast("long"))
    left = a.where("side = 'L'").select("k", F.col("seq").alias("ls"), F.col("ts").alias("lt"), F.col("wb").alias("lw"), F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    right = a.where("side = 'R'").select("k", F.col("seq").alias("rs"), F.col("ts").alias("rt"), F.col("wb").alias("rw"), "cell")
    first_alive = F.when(F.col("ls") < F.col("rs"), F.col("lt") >= F.col("rw") - window).otherwise(F.col("rt") >= F.col("lw") - window)
    m = left.join(right, ["k", "cell"]).where((F.abs(F.col("lt") - F.col("rt")) <= window) & first_alive)
    out = m.select(F.col("ls").alias("left_seq"), F.col("rs").alias("right_seq"), F.greatest("lt", "rt").alias("join_ts"))
    if how == "inner":
        return out
    last = events.agg(F.greatest(F.max("ts"), F.lit(advance_to).cast("long")).alias("w"))
    expired = a.join(F.broadcast(last), F.col("ts") < F.col("w") - window)  # one row
    misses = expired.where("side = 'L'").join(m.select(F.col("ls").alias("seq")), "seq", "left_anti").select(F.col("seq").alias("left_seq"), F.lit(None).cast("long").alias("right_seq"), F.col("ts").alias("join_ts"))
    out = out.union(misses)
    if how == "full":
        out = out.union(expired.where("side = 'R'").join(m.select(F.col("rs").alias("seq")), "seq", "left_anti").select(F.lit(None).cast("long"), "seq", "ts"))
    return out


def tumbling(results: DataFrame, width: int, key: str = "k", ts: str = "join_ts", closed_by: int | None = None) -> DataFrame:
    """(k, window_start, window_end, n) of results by tumbling window; only windows that end by closed_by's, if given."""
    start = F.floor(F.col(ts) / width).cast("long") * width
    out = results.groupBy(F.col(key).alias("k"), start.alias("window_start")).agg(F.count("*").alias("n"))
    out = out.select("k", "window_start", (F.col("window_start") + width).alias("window_end"), "n")
    return out if closed_by is None else out.where(F.col("window_end") <= closed_by // width * width)


def stream_join_live(left: DataFrame, right: DataFrame, window: str, lateness: str, how: str = "inner") -> DataFrame:
    """Stream-stream join of (key, ts, ...) streams. Equals the exact form where arrivals are in order from batch to batch."""
    left_side = left.withWatermark("ts", lateness).select(F.col("key").alias("left_key"), F.col("ts").alias("left_ts"), *[F.col(c).alias(f"left_{c}") for c in left.columns if c not in ("key", "ts")])
    right_side = right.withWatermark("ts", lateness).select(F.col("key").alias("right_key"), F.col("ts").alias("right_ts"), *[F.col(c).alias(f"right_{c}") for c in right.columns if c not in ("key", "ts")])
    band = F.expr(f"left_key = right_key AND right_ts BETWEEN left_ts - INTERVAL {window} AND left_ts + INTERVAL {window}")
    return left_side.join(right_side, band, {"inner": "inner", "left": "leftOuter", "full": "fullOuter"}[how])
