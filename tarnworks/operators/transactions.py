"""Multi-version state: snapshot visibility, conflicts, garbage and dependency edges.

versions: key, value, created_by, deleted_by (null while alive). txs: tx, first_active (the least transaction still running when it began),
status; a transaction sees committed ones with a smaller id that weren't running at its start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def visible(versions: DataFrame, txs: DataFrame, reader: int, running: list[int]) -> DataFrame:
    """(key, value) that transaction `reader` sees."""
    ok = txs.where((F.col("status") == "committed") & (F.col("tx") < reader) & ~F.col("tx").isin(running or [-1])).select("tx").union(txs.where(F.col("tx") == reader).select("tx")).distinct()
    made = versions.join(ok, F.col("created_by") == F.col("tx"), "left_semi")
    alive = made.join(ok.withColumnRenamed("tx", "gone"), F.col("deleted_by") == F.col("gone"), "left").where("gone IS NULL")
    return alive.groupBy("key").agg(F.max_by("value", "created_by").alias("value")).where("value IS NOT NULL")


def write_conflicts(writes: DataFrame, txs: DataFrame) -> DataFrame:
    """(tx, other, key): later committers that wrote a key of an earlier committer with an overlapping lifetime. txs: tx, started, ended."""
    w = writes.select("tx", "key").distinct().join(txs, "tx")
    o = w.select(F.col("tx").alias("other"), "key", F.col("started").alias("o_started"), F.col("ended").alias("o_ended"))
    return w.join(o, "key").where((F.col("other") != F.col("tx")) & (F.col("o_ended") < F.col("ended")) & (F.col("o_ended") > F.col("started"))).select("tx", "other", "key")


def garbage(versions: DataFrame, oldest_active: int) -> DataFrame:
    """Versions that no present or later transaction can see: those that a version below the oldest active transaction follows."""
    nxt = F.lead("created_by").over(Window.partitionBy("key").orderBy("created_by"))
    return versions.withColumn("next_by", nxt).where(F.col("next_by") < oldest_active).select("key", "created_by")


def as_of(history: DataFrame, readers: DataFrame) -> DataFrame:
    """(tx, key, value): the value of greatest commit_ts not after each reader's start. readers: tx, key, start_ts."""
    j = readers.join(history, "key").where(F.col("commit_ts") <= F.col("start_ts"))
    return j.groupBy("tx", "key").agg(F.max_by("value", "commit_ts").alias("value"))


def read_write_edges(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """(reader, writer) of a key read by one transaction and written by another that committed after the reader's start, before its end."""
    r = reads.select(F.col("tx").alias("reader"), "key", "started", "ended")
    w = writes.select(F.col("tx").alias("writer"), "key", F.col("ended").alias("w_ended"))
    return r.join(w, "key").where((F.col("reader") != F.col("writer")) & (F.col("w_ended") > F.col("started")) & (F.col("w_ended") < F.col("ended"))).select("reader", "writer").distinct()
