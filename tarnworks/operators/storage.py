"""Key-value runs, logs and ordered maps: latest-wins merges, scans, replay and compaction planning.

Runs are tables (run, key, value, ts), with a null value for a tombstone; files are Parquet sorted by key, whose statistics
take the place of sparse indexes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnworks.functions.ordered import with_running


def write_run(rows: DataFrame, path: str) -> None:
    """A sorted run without repeated keys; raises if a key repeats."""
    if rows.groupBy("key").count().where("count > 1").limit(1).count():
        raise ValueError("keys of a run must not repeat")
    rows.repartitionByRange("key").sortWithinPartitions("key").write.parquet(path)


def merge_runs(runs: DataFrame, drop_tombstones: bool = False) -> DataFrame:
    """Per key the row of the newest ts, of the lower run on ties."""
    best = runs.groupBy("key").agg(F.max_by(F.struct("value", "ts"), F.struct(F.col("ts"), -F.col("run"))).alias("x"))
    out = best.select("key", "x.value", "x.ts")
    return out.where("value IS NOT NULL") if drop_tombstones else out


def range_scan(rows: DataFrame, start: object, end: object | None = None) -> DataFrame:
    """Rows with start <= key < end, in order."""
    out = rows.where(F.col("key") >= F.lit(start))
    return (out if end is None else out.where(F.col("key") < F.lit(end))).orderBy("key")


def prefix_scan(rows: DataFrame, prefix: str) -> DataFrame:
    """Rows whose key begins with the prefix, in order; all rows for an empty one. The scan reads it as a range of keys."""
    return rows.where(F.col("key").startswith(prefix)).orderBy("key")


def extrema(rows: DataFrame) -> DataFrame:
    return rows.agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("n_keys"))


def stale_records(log: DataFrame) -> DataFrame:
    """Records per segment (segment, key, seq, value), and those that are live: the last of a key that isn't a tombstone."""
    last = log.groupBy("key").agg(F.max_by(F.struct("segment", "seq", "value"), "seq").alias("x")).where("x.value IS NOT NULL")
    live = last.select(F.col("x.segment").alias("segment")).groupBy("segment").agg(F.count("*").alias("live"))
    return log.groupBy("segment").agg(F.count("*").alias("records")).join(live, "segment", "left").select("segment", "records", F.coalesce("live", F.lit(0)).cast("long").alias("live"))


def replay_committed(wal: DataFrame, after: int = 0) -> DataFrame:
    """PUT and DELETE records (seq, op, key, value) that stand alone or whose batch has its COMMIT.

    A batch runs from a BEGIN to the next one; rows after its COMMIT stand alone and are kept with it.
    """
    x = with_running(wal.where(F.col("seq") > after), "seq", F.when(F.col("op") == "BEGIN", 1).otherwise(0).cast("long"), "sum", "island", inclusive=True)
    committed = x.where("op = 'COMMIT'").select("island").distinct()
    kept = x.where((F.col("island") == 0)).unionByName(x.where("island > 0").join(committed, "island", "left_semi").select(*x.columns))
    return kept.where("op IN ('PUT', 'DELETE')").select("seq", "op", "key", "value")


def record_crc(op: Column, key: Column, value: Column) -> Column:
    return F.crc32(F.concat(op, key, F.coalesce(value, F.lit(""))))


def size_tiers(files: DataFrame, bounds: list[int], least: int) -> DataFrame:
    """(tier, n_files, total) of size tiers with at least `least` files to merge. files: file, size, min_key, max_key."""
    tier = F.lit(len(bounds))
    for i, b in reversed(list(enumerate(bounds))):
        tier = F.when(F.col("size") < b, i).otherwise(tier)
    return files.groupBy(tier.alias("tier")).agg(F.count("*").alias("n_files"), F.sum("size").alias("total")).where(F.col("n_files") >= least)


def overlaps(files: DataFrame) -> DataFrame:
    """For each file of level 0 the number of level 1 files whose key range meets its own. Two small tables of file metadata."""
    a = files.where("level = 0").select(F.col("file").alias("file"), F.col("min_key").alias("lo"), F.col("max_key").alias("hi"))
    b = files.where("level = 1").select(F.col("file").alias("other"), "min_key", "max_key")
    return a.join(b, (F.col("min_key") <= F.col("hi")) & (F.col("max_key") >= F.col("lo")), "left").groupBy("file").agg(F.count("other").alias("n_overlapping"))


def boundaries(rows: DataFrame, most: int) -> DataFrame:
    """(part, start_key, end_key, n): contiguous ranges of at most `most` keys, numbered within cells of the first key bytes' order.

    Keys are ranked by a range shuffle's partitions, so that no single task orders all keys.
    """
    ranked = rows.select("key").distinct().repartitionByRange("key").sortWithinPartitions("key").withColumn("cell", F.spark_partition_id())
    ranked = ranked.withColumn("rn", F.row_number().over(Window.partitionBy("cell").orderBy("key")) - 1)
    return ranked.groupBy("cell", F.floor(F.col("rn") / most).alias("piece")).agg(F.min("key").alias("start_key"), F.max("key").alias("last_key"), F.count("*").alias("n"))


def route(keys: DataFrame, bounds: DataFrame) -> DataFrame:
    """keys with the part of bounds (part, start_key) that holds each: the last start not above the key. bounds is a small table."""
    starts = bounds.agg(F.sort_array(F.collect_list(F.struct(F.col("start_key").alias("s"), F.col("part").alias("p")))).alias("b"))
    at = F.aggregate("b", F.lit(None).cast(dict(bounds.dtypes)["part"]), lambda a, x: F.when(x["s"] <= F.col("key"), x["p"]).otherwise(a))
    return keys.crossJoin(F.broadcast(starts)).withColumn("part", at).drop("b")  # starts is one row


def merge_small(sizes: DataFrame, least: int) -> DataFrame:
    """(start_part, n): adjacent parts merged left to right while their joint size is at most `least`. sizes (part, n) is partition metadata."""
    rows = sizes.agg(F.sort_array(F.collect_list(F.struct("part", F.col("n").cast("long").alias("n")))).alias("r"))
    start = F.array().cast("array<struct<start_part:bigint,n:bigint>>")
    fold = F.aggregate(
        F.expr("transform(r, x -> struct(cast(x.part as bigint) as start_part, x.n as n))"),
        start,
        lambda acc, x: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["n"] + x["n"] <= least), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start_part"].alias("start_part"), (F.try_element_at(acc, F.lit(-1))["n"] + x["n"]).alias("n"))))).otherwise(F.concat(acc, F.array(x))),
    )
    return rows.select(F.explode(fold).alias("x")).select("x.start_part", "x.n")
