"""Replicated and causally ordered state: CRDTs, vector clocks, quorums, repair, hints, membership, fencing and agreement."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States that a run of a register's ops may start from and that it tells apart.
MOVES = 64


def gcounter(states: DataFrame) -> DataFrame:
    """Value of each key of grow-only counters (key, replica, n): the sum of each replica's greatest count."""
    return states.groupBy("key", "replica").agg(F.max("n").alias("n")).groupBy("key").agg(F.sum("n").alias("value"))


def pncounter(states: DataFrame) -> DataFrame:
    m = states.groupBy("key", "replica").agg(F.max("p").alias("p"), F.max("n").alias("n"))
    return m.groupBy("key").agg((F.sum("p") - F.sum("n")).alias("value"))


def lww(writes: DataFrame) -> DataFrame:
    """(key, value) of the greatest (ts, writer)."""
    return writes.groupBy("key").agg(F.max_by("value", F.struct("ts", "writer")).alias("value"))


def orset(adds: DataFrame, removed_tags: DataFrame) -> DataFrame:
    """(key, element) with an add tag that no tombstone covers."""
    return adds.join(removed_tags.select("tag").distinct(), "tag", "left_anti").select("key", "element").distinct()


def merge_clocks(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def compare_clocks(a: Column, b: Column) -> Column:
    """EQUAL, BEFORE, AFTER or CONCURRENT."""
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    less = F.exists(keys, lambda k: F.coalesce(F.try_element_at(a, k), F.lit(0)) < F.coalesce(F.try_element_at(b, k), F.lit(0)))
    more = F.exists(keys, lambda k: F.coalesce(F.try_element_at(a, k), F.lit(0)) > F.coalesce(F.try_element_at(b, k), F.lit(0)))
    return F.when(less & more, "CONCURRENT").when(less, "BEFORE").when(more, "AFTER").otherwise("EQUAL")


def siblings(versions: DataFrame) -> DataFrame:
    """Versions (key, id, clock) that no other version of the key dominates."""
    other = versions.select("key", F.col("id").alias("other"), F.col("clock").alias("other_clock"))
    v, o = versions.alias("v"), other.alias("o")
    beaten = (F.col("v.key") == F.col("o.key")) & (F.col("id") != F.col("other")) & (compare_clocks(F.col("clock"), F.col("other_clock")) == "BEFORE")
    return v.join(o, beaten, "left_anti")


def quorum_read(replicas: DataFrame, quorum: int) -> DataFrame:
    """(key, version, values): greatest version among available copies, its distinct values, where enough copies are available."""
    live = replicas.where("available")
    top = live.groupBy("key").agg(F.max("version").alias("version"), F.count("*").alias("n")).where(F.col("n") >= quorum).drop("n")
    return live.join(top, ["key", "version"]).groupBy("key", "version").agg(F.array_join(F.array_sort(F.collect_set("value")), ",").alias("vals"))


def stale_copies(replicas: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, node, has, wants): copies that lag behind or are missing. nodes, all of a cluster, is a small table."""
    want = replicas.groupBy("key").agg(F.max("version").alias("wants"))
    every = want.crossJoin(F.broadcast(nodes.select("node")))  # a copy per node is what is stored
    return every.join(replicas.select("key", "node", F.col("version").alias("has")), ["key", "node"], "left").where("has IS NULL OR has < wants").select("key", "node", "has", "wants")


def read_repair(replicas: DataFrame, reads: int) -> DataFrame:
    """(key, node): stale copies among the first `reads` available ones of each key."""
    w = Window.partitionBy("key").orderBy("node")
    asked = replicas.where("available").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= reads)
    top = asked.groupBy("key").agg(F.max("version").alias("top"))
    return asked.join(top, "key").where("version < top").select("key", "node")


def hint_status(hints: DataFrame, now: Column) -> DataFrame:
    """hints (target, created, ttl) by what a handoff at `now` does with them."""
    return hints.withColumn("status", F.when(now >= F.col("created") + F.col("ttl"), "expired").otherwise("delivered"))


def follower_lag(log: DataFrame, applied: DataFrame) -> DataFrame:
    last = log.agg(F.max("lsn").alias("last"))
    return applied.crossJoin(F.broadcast(last)).select("follower", (F.col("last") - F.col("lsn")).alias("lag"))  # last is one row


def monotonic_violations(reads: DataFrame) -> DataFrame:
    """Reads (session, seq, lsn) that saw less than an earlier one of their session."""
    before = F.max("lsn").over(Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return reads.withColumn("seen", before).where("lsn < seen").select("session", "seq", "lsn", "seen")


def member_status(members: DataFrame, now: Column, suspect: int, dead: int, cleanup: int) -> DataFrame:
    """(observer, member, status) from the newest heartbeat that each observer knows."""
    newest = members.groupBy("observer", "member").agg(F.max(F.struct("heartbeat", "updated")).alias("x"))
    gap = now - F.col("x.updated")
    return newest.select("observer", "member", F.when(gap > cleanup, "removed").when(gap > dead, "dead").when(gap > suspect, "suspected").otherwise("alive").alias("status"))


def fenced_writes(writes: DataFrame) -> DataFrame:
    """writes (resource, seq, token) with accepted: no higher token came to the resource before; an equal one is accepted."""
    before = F.max("token").over(Window.partitionBy("resource").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return writes.withColumn("accepted", F.coalesce(F.col("token") >= before, F.lit(True)))


def tx_outcomes(votes: DataFrame, participants: int) -> DataFrame:
    """(tx, outcome): committed if all participants voted yes."""
    yes = F.countDistinct(F.when(F.col("vote") == "yes", F.col("participant")))
    return votes.groupBy("tx").agg(F.when(yes == participants, "committed").otherwise("aborted").alias("outcome"))


def in_doubt(states: DataFrame) -> DataFrame:
    """(participant, tx) whose last state is prepared."""
    return states.groupBy("participant", "tx").agg(F.max_by("state", "seq").alias("state")).where("state = 'prepared'").select("participant", "tx")


def agreed(messages: DataFrame, f: int) -> DataFrame:
    """(view_no, sequence, digest) prepared by 2f and committed by 2f + 1 distinct senders."""
    n = lambda kind: F.countDistinct(F.when(F.col("kind") == kind, F.col("sender")))
    return messages.groupBy("view_no", "sequence", "digest").agg(n("PREPARE").alias("prepares"), n("COMMIT").alias("commits")).where((F.col("prepares") >= 2 * f) & (F.col("commits") >= 2 * f + 1))


def commit_index(match: DataFrame, nodes: int) -> DataFrame:
    """(term, commit_index): the greatest log index that a majority holds."""
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("match_index"), "node"))
    return match.withColumn("rn", rank).where(F.col("rn") == nodes // 2 + 1).select("term", F.col("match_index").alias("commit_index"))


def leader_changes(history: DataFrame) -> DataFrame:
    """Rows (cluster, tick, leader) where the leader differs from the one before."""
    before = F.lag("leader").over(Window.partitionBy("cluster").orderBy("tick"))
    return history.withColumn("previous", before).where(F.col("previous").isNull() | (F.col("previous") != F.col("leader")))


def delivered_prefix(slots: DataFrame) -> DataFrame:
    """(node, delivered): slots from 0 on without a gap."""
    rn = F.row_number().over(Window.partitionBy("node").orderBy("slot")) - 1
    return slots.withColumn("rn", rn).groupBy("node").agg(F.sum(F.when(F.col("rn") == F.col("slot"), 1).otherwise(0)).alias("delivered"))


def _register_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ops of one key, in slot order, as maps of states: to `value` from every state after a write, else `was` to `becomes`."""
    names = ["key", "part", "nth", "written", "value", "was", "becomes"]
    current: object = _register_runs  # no key yet; None is one
    written, value, moves = False, None, {}
    out: list[tuple] = []
    nth, part, key_type = 0, 0, pa.null()

    def packed() -> pa.RecordBatch:
        kinds = [key_type, pa.int32(), pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        key_type = batch.column("key").type
        for key, part, write, expected, new in zip(*(batch.column(c).to_pylist() for c in ("key", "part", "write", "expected", "value")), strict=True):
            if key != current or len(moves) >= MOVES:
                if current is not _register_runs:
                    out.append((current, part, nth, written, value, list(moves), list(moves.values())))
                    nth += 1
                current, written, value, moves = key, False, None, {}
            if write:
                written, value, moves = True, new, {}
            elif written:
                value = new if value == expected else value
            else:
                moves.setdefault(expected, expected)
                for was, state in moves.items():
                    if state == expected:
                        moves[was] = new
        if len(out) >= 1000:
            yield packed()
            out = []
    if current is not _register_runs:
        out.append((current, part, nth, written, value, list(moves), list(moves.values())))
        yield packed()


def _register_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state of each key after its runs, which come in order."""
    current: object = _register_ends
    state, kind = None, pa.null()
    for batch in batches:
        kind = batch.column("key").type
        keys, values = [], []
        for key, written, value, was, becomes in zip(*(batch.column(c).to_pylist() for c in ("key", "written", "value", "was", "becomes")), strict=True):
            if key != current:
                if current is not _register_ends:
                    keys.append(current)
                    values.append(state)
                current, state = key, None
            state = value if written else dict(zip(was, becomes, strict=True)).get(state, state)
        yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(values, pa.string())], names=["key", "value"])
    if current is not _register_ends:
        yield pa.RecordBatch.from_arrays([pa.array([current], kind), pa.array([state], pa.string())], names=["key", "value"])


def register_state(ops: DataFrame) -> DataFrame:
    """(key, value) of a register after its ops (key, slot, kind write or cas, expected, value) in slot order.

    Ops are dealt by ranges of key and slot, so a hot key is many runs. A run is a map from state to state, of MOVES states
    at most; one task goes through a key's runs.
    """
    kind = ops.schema["key"].dataType.simpleString()
    strings = [F.col(c).cast("string").alias(c) for c in ("expected", "value")]
    dealt = ops.select("key", "slot", "kind", *strings).repartitionByRange("key", "slot", "kind", "expected", "value").sortWithinPartitions("key", "slot", "kind", "expected", "value")
    dealt = dealt.select("key", F.spark_partition_id().alias("part"), (F.col("kind") == "write").alias("write"), "expected", "value")
    runs = dealt.mapInArrow(_register_runs, f"key {kind}, part int, nth long, written boolean, value string, was array<string>, becomes array<string>")
    runs = runs.repartition("key").sortWithinPartitions("key", "part", "nth").select("key", "written", "value", "was", "becomes")
    return runs.mapInArrow(_register_ends, f"key {kind}, value string")


def lamport_edges(events: DataFrame) -> DataFrame:
    """(cause, effect): each event's predecessor on its node, and the send of each receive. events: id, node, seq, message, kind."""
    own = events.withColumn("cause", F.lag("id").over(Window.partitionBy("node").orderBy("seq"))).where("cause IS NOT NULL").select("cause", F.col("id").alias("effect"))
    sent = events.where("kind = 'send'").select(F.col("id").alias("cause"), "message")
    got = events.where("kind = 'receive'").select(F.col("id").alias("effect"), "message")
    return own.union(sent.join(got, "message").select("cause", "effect"))


def reaches(edges: DataFrame, source: int) -> DataFrame:
    """(id): events that happen after `source`, by a frontier of distinct events; one round for each edge of the longest way."""
    from tarnworks.session import stash, unstash

    spark = edges.sparkSession
    seen = frontier = spark.createDataFrame([(source,)], "id long")
    while True:
        nxt = stash(edges.join(frontier, F.col("cause") == F.col("id"), "left_semi").select(F.col("effect").cast("long").alias("id")).distinct().join(seen, "id", "left_anti"), "frontier")
        if not nxt.limit(1).count():
            return seen.where(F.col("id") != source)
        both = stash(seen.union(nxt), "seen")  # the plan of a long union would grow with each round
        unstash(seen)
        unstash(frontier)
        seen, frontier = both, nxt


def happens_after(events: DataFrame, source: int) -> DataFrame:
    """(id): the events (see lamport_edges) that happen after `source`.

    What is reached of a node is all from some seq on, so the state is the first reached seq of each node. A round follows
    all messages sent from there on; an earliest way meets no node twice, so there are no more rounds than nodes.
    """
    from tarnworks.session import stash, unstash

    start = events.where(F.col("id") == source).select(F.col("node").alias("at"), F.col("seq").alias("first"))
    # null nodes are one node, as in lamport_edges
    on_node = lambda c: F.col(c).eqNullSafe(F.col("at"))
    sent = events.where("kind = 'send'").select(F.col("node").alias("sender"), F.col("seq").alias("sent"), "message")
    got = events.where("kind = 'receive'").select(F.col("node").alias("receiver"), F.col("seq").alias("got"), "message")
    hops = stash(sent.join(got, "message").select("sender", "sent", "receiver", "got"), "hops")
    reached = stash(start, "reached")
    while True:
        new = hops.join(reached, on_node("sender") & (F.col("sent") >= F.col("first"))).groupBy(F.col("receiver").alias("at")).agg(F.min("got").alias("first"))
        nxt = stash(reached.union(new).groupBy("at").agg(F.min("first").alias("first")), "reached")
        was = reached.select(F.col("at").alias("node"), F.col("first").alias("was"))
        earlier = nxt.join(was, on_node("node") & (F.col("was") <= F.col("first")), "left_anti").limit(1).count()
        unstash(reached)
        reached = nxt
        if not earlier:
            unstash(hops)
            return events.join(reached, on_node("node") & (F.col("seq") >= F.col("first"))).where(F.col("id") != source).select(F.col("id").cast("long").alias("id"))
