"""Changelogs (seq, key, op, value) folded into state, views and indexes. op is PUT or DELETE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnworks.functions.ordered import with_running


def latest(log: DataFrame, keys: list[str] | None = None, seq: str = "seq") -> DataFrame:
    """The last entry of each key, deletes included: log compaction. A partial aggregation, so hot keys don't gather."""
    keys = keys or ["key"]
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("last")).select(*keys, "last.*").select(*log.columns)


def current_state(log: DataFrame) -> DataFrame:
    """Keys whose last entry is a PUT."""
    return latest(log).where("op = 'PUT'")


def with_images(log: DataFrame) -> DataFrame:
    """log with kind (insert, update or delete), before and after; deletes of absent keys give no event."""
    w = Window.partitionBy("key").orderBy("seq")
    x = log.withColumn("before", F.lag("value").over(w)).withColumn("was", F.lag("op").over(w))
    x = x.withColumn("kind", F.when(F.col("op") == "DELETE", "delete").when(F.col("was") == "PUT", "update").otherwise("insert"))
    x = x.where((F.col("op") == "PUT") | (F.col("was") == "PUT"))
    return x.select("seq", "key", "kind", F.when(F.col("was") == "PUT", F.col("before")).alias("before"), F.col("value").alias("after"))


def read_range(log: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    out = log.where(F.col("seq") >= start)
    return out if end is None else out.where(F.col("seq") < end)


def consumer_lag(log: DataFrame, positions: DataFrame) -> DataFrame:
    """positions (consumer, position): entries after each consumer's position, and the log's last position less its own.

    Positions are put among the entries and get the running number of entries up to them.
    """
    entries = log.select((2 * F.col("seq")).alias("at"), F.lit(1).cast("long").alias("one"))
    asked = positions.select("consumer", "position", (2 * F.col("position") + 1).alias("at"), F.lit(0).cast("long").alias("one"))
    upto = with_running(entries.unionByName(asked, allowMissingColumns=True), "at", F.col("one"), "sum", "upto", True).where("one = 0")
    whole = log.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("latest"), F.count("*").alias("entries"))
    return upto.crossJoin(F.broadcast(whole)).select("consumer", (F.col("latest") - F.col("position")).alias("lag"), (F.col("entries") - F.col("upto")).alias("pending"))  # whole is one row


def snapshot_and_tail(log: DataFrame, at: int) -> DataFrame:
    """(seq, key, op, value): the state at `at` as entries of seq -1, then later entries."""
    state = current_state(log.where(F.col("seq") <= at)).select(F.lit(-1).cast("long").alias("seq"), "key", "op", "value")
    return state.union(log.where(F.col("seq") > at).select("seq", "key", "op", "value"))


def view_counts(log: DataFrame, group: Column) -> DataFrame:
    """Live keys by group, with groups that once had keys kept at 0; null groups don't count."""
    x = with_images(log.withColumn("value", group))
    deltas = x.select(F.explode(F.array(F.struct(F.col("before").alias("g"), F.lit(-1).alias("d")), F.struct(F.col("after").alias("g"), F.lit(1).alias("d")))).alias("x")).select("x.*")
    return deltas.where("g IS NOT NULL").groupBy(F.col("g").alias("grp")).agg(F.sum("d").alias("n"))


def view_lists(log: DataFrame) -> DataFrame:
    """Live keys by value in order of their last PUT, joined by commas: postings of one value, gathered per value by contract."""
    return current_state(log).groupBy("value").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "key"))), lambda x: x["key"]), ",").alias("keys"))


def postings(rows: DataFrame, pk: str, fields: list[str]) -> DataFrame:
    """(field, value, pk) of the non-null fields."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    return rows.select(F.col(pk).alias("pk"), pairs.alias("x")).select("x.field", "x.value", "pk").where("value IS NOT NULL").distinct()


def pending_index(changes: DataFrame, pk: str, fields: list[str], seq: str, flushed: int) -> DataFrame:
    """(field, value, pk, visible) of an index whose changes after `flushed` wait: postings of later rows aren't visible yet."""
    ready = postings(changes.where(F.col(seq) <= flushed), pk, fields).withColumn("visible", F.lit(True))
    return ready.unionByName(postings(changes.where(F.col(seq) > flushed), pk, fields).withColumn("visible", F.lit(False)))


def text_postings(rows: DataFrame, pk: str, fields: list[str]) -> DataFrame:
    """(token, pk): lower-cased tokens between white space, punctuation kept."""
    cut = F.split(F.lower(F.concat_ws(" ", *[F.col(f).cast("string") for f in fields])), r"\s+")
    return rows.select(F.explode(F.array_distinct(cut)).alias("token"), F.col(pk).alias("pk")).where("token <> ''")


def search_all(index: DataFrame, terms: list[str]) -> DataFrame:
    """pks that have all terms; none for no terms."""
    wanted = sorted({t.lower() for t in terms})
    return index.where(F.col("token").isin(wanted)).groupBy("pk").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("pk") if wanted else index.select("pk").limit(0)


def apply_delta(state: DataFrame, delta: DataFrame) -> DataFrame:
    """The state (seq, key, op, value; tombstones kept) after a later part of the log: for foreachBatch upserts."""
    return latest(state.unionByName(delta))
