"""Operators do the whole job where the given tables are too small or too even to tell."""

import random

from pyspark.sql import functions as F

from tarnworks.operators import eventstore as es
from tarnworks.operators import replicas as rp


def brute_after(events, source):
    last, sent, out = {}, {i: [] for i, *_ in events}, {source}
    for i, node, _, _, _ in events:
        if node in last:
            sent[last[node]].append(i)
        last[node] = i
    for i, _, _, m, kind in events:
        sent[i] += [j for j, _, _, n, k in events if kind == "send" and k == "receive" and m == n]
    todo = [source]
    while todo:
        new = [j for j in sent[todo.pop()] if j not in out]
        out.update(new)
        todo += new
    return out - {source}


def test_happens_after_follows_long_ways(spark):
    rng = random.Random(1)
    local = [(i, 0, i, None, "local") for i in range(2500)]  # one node: 2499 edges from the first to the last event
    mixed = [(i, rng.choice([0, 1, 2, 3, 4, None]), i, rng.randrange(40), rng.choice(["send", "receive", "local"])) for i in range(200)]
    mixed = [e for e in mixed if e[4] != "receive" or all(s[3] != e[3] or s[4] != "send" or s[0] < e[0] for s in mixed)]
    for events in (local, mixed):
        df = spark.createDataFrame(events, "id long, node int, seq long, message long, kind string")
        source = events[3][0]
        got = [r.id for r in rp.happens_after(df, source).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_after(events, source)


def test_happens_before_reads_the_whole_table(spark):
    import __spark_entry__ as entry

    got = entry.queries()["happens_before"](spark, "/root/testdata/sf0.001")
    assert got.agg({"id": "max"}).first()[0] == spark.read.parquet("/root/testdata/sf0.001/events.parquet").agg({"event_id": "max"}).first()[0]


def no_array_of_a_hot_group(df, hot):
    """No row of an aggregate holds as many entries as the hot group has rows."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    gathered = [c for c in ("collect_list(struct(slot", "collect_list(struct(event_id") if c in plan]
    return not gathered and df.count() < hot


def test_register_state_of_a_hot_key(spark):
    rng = random.Random(3)
    values = [None, *(f"v{i}" for i in range(90))]
    key = lambda i: 5 if i % 3 == 0 else None if i % 31 == 0 else i % 17
    ops = [(key(i), i, "write" if key(i) != 5 and rng.random() < 0.1 or i == 0 else "cas", rng.choice(values), rng.choice(values)) for i in range(6000)]
    ops += [(99, i, "cas", None if i == 0 else f"v{i - 1}", f"v{i}") for i in range(500)]  # a chain of states from no write on
    want = {}
    for k, _, kind, expected, value in ops:
        state = want.setdefault(k, None)
        want[k] = value if kind == "write" or state == expected else state
    df = spark.createDataFrame(rng.sample(ops, len(ops)), "key long, slot long, kind string, expected string, value string")
    got = rp.register_state(df)
    assert {r.key: r.value for r in got.collect()} == want
    assert no_array_of_a_hot_group(got, 2000)


def test_balances_of_a_hot_stream(spark):
    rng = random.Random(4)
    events = [(i, 5 if i % 3 == 0 else None if i % 31 == 0 else i % 17, rng.randrange(-60, 55)) for i in range(6000)]
    want = {}
    for _, k, amount in events:
        want[k] = max(0, want.get(k, 0) + amount)
    df = spark.createDataFrame(rng.sample(events, len(events)), "event_id long, stream_id long, amount long")
    got = es.balances(df)
    assert {r.stream_id: r.state for r in got.collect()} == want
    assert no_array_of_a_hot_group(got, 2000)
    # ranges that AQE does not put together again: a stream of many runs
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert {r.stream_id: r.state for r in es.balances(df).collect()} == want
        ops = df.select(F.col("stream_id").alias("key"), F.col("event_id").alias("slot"), F.lit("cas").alias("kind"), F.when(F.col("event_id") > 20, F.lit("x")).alias("expected"), F.lit("x").alias("value"))
        assert {r.value for r in rp.register_state(ops).where("key = 5").collect()} == {"x"}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
