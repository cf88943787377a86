"""Queries of record pipelines, MapReduce, joins and stream joins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnworks.operators import joins, mapreduce, pipeline
from tarnworks.plans.registry import query
from tarnworks.session import shared_dir, stash
from tarnworks.sources.tables import lines, micros, stream, table
from tarnworks.streaming import stream_join

_WORDS = r"""w AS (SELECT lower(regexp_replace(x, '^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$', '', 'g')) AS key
FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS x FROM documents)),
c AS (SELECT key, count(*)::BIGINT AS value FROM w WHERE length(key) >= 1 GROUP BY key)"""


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.count(pipeline.tokenize(table(spark, sf_dir, "documents")))


@query(f"WITH {_WORDS} SELECT * FROM c")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir)


@query(f"WITH {_WORDS} SELECT * FROM c ORDER BY value DESC, key LIMIT 20")
def word_count_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.top_n(_counts(spark, sf_dir), 20)


@query(f"WITH {_WORDS} SELECT * FROM c WHERE value >= 5")
def word_count_min_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.Pipeline().add_stage("count", pipeline.count).add_stage("frequent", lambda d: d.where("value >= 5")).build(pipeline.tokenize(table(spark, sf_dir, "documents")))


@query(f"WITH {_WORDS} SELECT left(key, 1) AS initial, sum(value)::BIGINT AS n_tokens, count(*)::BIGINT AS n_words FROM c GROUP BY 1")
def tokens_by_initial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).groupBy(F.substring("key", 1, 1).alias("initial")).agg(F.sum("value").alias("n_tokens"), F.count("*").alias("n_words"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS key, count(*)::BIGINT AS value FROM orders GROUP BY 1")
def mapreduce_orders_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.date_format("o_orderdate", "yyyy-MM").alias("value"))
    add = lambda k, values: [(k, sum(values))]
    return mapreduce.MapReduceJob(lambda _, month: [(month, 1)], add, combiner=add).run(records)


@query("SELECT n::VARCHAR AS key, count(*)::BIGINT AS value FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1")
def mapreduce_two_stage_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("key"), F.lit(1).cast("long").alias("value"))
    add = lambda k, values: [(k, sum(values))]
    # the first job's fold is built in: its keys are many and its function algebraic
    return mapreduce.MapReducePipeline().add_stage(mapreduce.MapReduceJob(lambda _, n: [(str(n), 1)], add, combiner=add)).run(pipeline.count(records))


@query("SELECT l_returnflag, date_trunc('month', l_shipdate)::DATE AS month, sum((l_extendedprice::DECIMAL(18,2)) * (1 - l_discount::DECIMAL(18,2)))::DOUBLE AS revenue FROM lineitem GROUP BY 1, 2")
def mapreduce_revenue_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = F.col("l_extendedprice").cast("decimal(18,2)") * (F.lit(1).cast("decimal(1,0)") - F.col("l_discount").cast("decimal(18,2)"))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.trunc(F.col("l_shipdate").cast("date"), "month").alias("month")).agg(F.sum(amount).cast("double").alias("revenue"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("code"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("cust"), (F.col("o_orderkey") % 7).alias("code"))
    return users, orders


_J = "SELECT {key} AS user_id, c_name AS name, c_nationkey::BIGINT AS left_code, o_orderkey, (o_orderkey % 7)::BIGINT AS right_code FROM {joined}"


@query(_J.format(key="o_custkey", joined="customer JOIN orders ON c_custkey = o_custkey"))
def join_broadcast_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    users, orders = _sides(spark, sf_dir)
    return joins.broadcast_hash_join(users, orders, "user_id", "cust")


@query(_J.format(key="o_custkey", joined="orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) c ON c_custkey = o_custkey"))
def join_broadcast_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    users, orders = _sides(spark, sf_dir)
    return joins.broadcast_hash_join(users.where("user_id % 3 <> 0"), orders, "user_id", "cust", "left")


@query(_J.format(key="c_custkey", joined="customer JOIN orders ON c_custkey = o_custkey"))
def join_shuffle_hash_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.partitioned_hash_join(*_sides(spark, sf_dir), "user_id", "cust")


@query(_J.format(key="c_custkey", joined="customer LEFT JOIN orders ON c_custkey = o_custkey"))
def join_shuffle_hash_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.partitioned_hash_join(*_sides(spark, sf_dir), "user_id", "cust", "left")


@query(_J.format(key="c_custkey", joined="customer JOIN orders ON c_custkey = o_custkey"))
def join_sort_merge_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.sort_merge_join(*_sides(spark, sf_dir), "user_id", "cust")


@query(_J.format(key="c_custkey", joined="customer LEFT JOIN orders ON c_custkey = o_custkey"))
def join_sort_merge_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.sort_merge_join(*_sides(spark, sf_dir), "user_id", "cust", "left")


@query("SELECT n_nationkey::BIGINT AS k, n_name, r_name FROM nation JOIN region ON CASE WHEN n_regionkey > 2 THEN NULL ELSE n_regionkey END IS NOT DISTINCT FROM CASE WHEN r_regionkey > 2 THEN NULL ELSE r_regionkey END")
def join_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    hidden = lambda c: F.when(F.col(c) <= 2, F.col(c))
    n = table(spark, sf_dir, "nation").select(hidden("n_regionkey").alias("rk"), F.col("n_nationkey").cast("long").alias("k"), "n_name")
    r = table(spark, sf_dir, "region").select(hidden("r_regionkey").alias("rk"), "r_name")
    return joins.partitioned_hash_join(n, r, "rk", null_safe=True).select("k", "n_name", "r_name")


@query("SELECT s AS strategy, count(*)::BIGINT AS n_rows, 0::BIGINT AS differing FROM (SELECT unnest(['broadcast', 'partitioned', 'sort_merge']) AS s), orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def join_strategies_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    users, orders = _sides(spark, sf_dir)
    return joins.compare_join_strategies(users, orders.withColumnRenamed("cust", "user_id"), "user_id")


@query("SELECT o_custkey, min(CASE WHEN p IS NULL OR o_orderdate >= p THEN 1 ELSE 0 END) = 1 AS sorted FROM (SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM orders) GROUP BY 1")
def join_input_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.is_sorted(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey", "o_custkey")


HOUR, LATE = 3_600_000_000, 600_000_000


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type IN ('view', 'click')")
    shifted = micros(F.col("ts")) + (F.col("event_id") * 7919) % 600 * 1_000_000
    return e.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "view", "L").otherwise("R").alias("side"), F.col("user_id").alias("k"), shifted.alias("ts"))


_EV = f"""ev AS (SELECT event_id AS seq, CASE event_type WHEN 'view' THEN 'L' ELSE 'R' END AS side, user_id AS k, epoch_us(ts) + (event_id * 7919) % 600 * 1000000 AS ts FROM events WHERE event_type IN ('view', 'click')),
e AS (SELECT *, max(ts) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wb FROM ev),
a AS (SELECT * FROM e WHERE wb IS NULL OR ts >= wb - {LATE}),
wf AS (SELECT max(ts) AS w FROM ev),
m AS (SELECT l.seq AS left_seq, r.seq AS right_seq, greatest(l.ts, r.ts) AS join_ts, l.k AS k
  FROM a l JOIN a r ON l.k = r.k AND l.side = 'L' AND r.side = 'R' AND r.ts BETWEEN l.ts - {HOUR} AND l.ts + {HOUR}
  AND CASE WHEN l.seq < r.seq THEN l.ts >= r.wb - {HOUR} ELSE r.ts >= l.wb - {HOUR} END),
lm AS (SELECT seq AS left_seq, NULL::BIGINT AS right_seq, ts AS join_ts FROM a, wf WHERE side = 'L' AND ts < w - {HOUR} AND seq NOT IN (SELECT left_seq FROM m)),
rm AS (SELECT NULL::BIGINT AS left_seq, seq AS right_seq, ts AS join_ts FROM a, wf WHERE side = 'R' AND ts < w - {HOUR} AND seq NOT IN (SELECT right_seq FROM m))"""


@query(f"WITH {_EV} SELECT left_seq, right_seq, join_ts FROM m")
def stream_join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_join.stream_join_exact(_stream(spark, sf_dir), HOUR, LATE)


@query(f"WITH {_EV} SELECT left_seq, right_seq, join_ts FROM m UNION ALL SELECT * FROM lm")
def stream_join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_join.stream_join_exact(_stream(spark, sf_dir), HOUR, LATE, "left")


@query(f"WITH {_EV} SELECT left_seq, right_seq, join_ts FROM m UNION ALL SELECT * FROM lm UNION ALL SELECT * FROM rm")
def stream_join_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_join.stream_join_exact(_stream(spark, sf_dir), HOUR, LATE, "full")


@query(f"WITH {_EV} SELECT seq, side, ts, wb FROM e WHERE ts < wb - {LATE}")
def stream_late_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_join.with_watermark_before(_stream(spark, sf_dir)).where(F.col("ts") < F.col("wb") - LATE).select("seq", "side", "ts", "wb")


@query(f"WITH {_EV} SELECT (SELECT count(*) FROM ev)::BIGINT AS processed, (SELECT count(*) FROM ev)::BIGINT - (SELECT count(*) FROM a)::BIGINT AS late, (SELECT count(*) FROM m)::BIGINT AS matched, (SELECT count(*) FROM lm)::BIGINT AS left_misses")
def stream_join_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _stream(spark, sf_dir)
    joined = stream_join.stream_join_exact(ev, HOUR, LATE, "left").agg(F.count("right_seq").alias("matched"), F.count(F.when(F.col("right_seq").isNull(), 1)).alias("left_misses"))
    n = ev.agg(F.count("*").alias("processed")).crossJoin(stream_join.accepted(ev, LATE).agg(F.count("*").alias("ok")))  # one row each
    return n.crossJoin(joined).select("processed", (F.col("processed") - F.col("ok")).alias("late"), "matched", "left_misses")


@query(f"WITH {_EV} SELECT k, (join_ts // {HOUR}) * {HOUR} AS window_start, (join_ts // {HOUR}) * {HOUR} + {HOUR} AS window_end, count(*)::BIGINT AS n FROM m GROUP BY ALL")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _stream(spark, sf_dir)
    m = stream_join.stream_join_exact(ev, HOUR, LATE).join(ev.select(F.col("seq").alias("left_seq"), "k"), "left_seq")
    return stream_join.tumbling(m, HOUR)


#: Records of the priority's words, without the number before them.
_PRIORITY = "SELECT unnest(string_split(lower(o_orderpriority), '-')) AS key FROM orders"


def _priority_words() -> pipeline.Pipeline:
    pairs = F.transform(F.split(F.lower("o_orderpriority"), "-"), lambda w: F.struct(w.alias("key"), F.lit(1).cast("long").alias("value")))
    return pipeline.Pipeline().add_stage("flat_map", pipeline.flat_map(pairs)).add_stage("filter", pipeline.keep(F.length("key") > 1)).add_stage("count", pipeline.count).add_stage("sort", pipeline.sort, sorts=True)


@query(f"SELECT key, count(*)::BIGINT AS value FROM ({_PRIORITY}) WHERE length(key) > 1 GROUP BY 1 ORDER BY 1")
def pipeline_flat_map_filter_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _priority_words().build(table(spark, sf_dir, "orders"))


@query(f"WITH w AS ({_PRIORITY}), n AS (SELECT (SELECT count(*) FROM orders) AS a, count(*) AS b, count(*) FILTER (length(key) > 1) AS c, count(DISTINCT key) FILTER (length(key) > 1) AS d FROM w) SELECT 'flat_map' AS stage, a::BIGINT AS records_in, b::BIGINT AS records_out FROM n UNION ALL SELECT 'filter', b, c FROM n UNION ALL SELECT 'count', c, d FROM n UNION ALL SELECT 'sort', d, d FROM n")
def pipeline_stage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _priority_words()
    p.run_to_file(table(spark, sf_dir, "orders"), f"{shared_dir(spark)}/tarnworks/run-{uuid.uuid4().hex}")
    return spark.createDataFrame([(s["stage"], s["records_in"], s["records_out"]) for s in p.stats()], "stage string, records_in long, records_out long")


@query("SELECT o_orderstatus AS part, count(*)::BIGINT AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1")
def pipeline_partition_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tarnworks/parts-{uuid.uuid4().hex}"
    pipeline.partition_to(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), F.col("o_orderstatus"), path)
    return spark.read.schema("o_orderkey long, part string").json(path).groupBy("part").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT row_number() OVER (ORDER BY n_nationkey) AS line_no, n_name AS text FROM nation")
def read_lines_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tarnworks/lines-{uuid.uuid4().hex}"
    table(spark, sf_dir, "nation").coalesce(1).sortWithinPartitions("n_nationkey").select("n_name").write.text(path)
    return lines(spark, path)


def _per_customer() -> mapreduce.MapReduceJob:
    return mapreduce.MapReduceJob(lambda _, cust: [(str(cust), 1)], lambda k, values: [(k, len(values))])


@query("SELECT n::VARCHAR AS key, count(*)::BIGINT AS value FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1")
def mapreduce_two_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_custkey").alias("value"))
    add = lambda k, values: [(k, sum(values))]
    return mapreduce.MapReducePipeline().add_stage(_per_customer()).add_stage(mapreduce.MapReduceJob(lambda _, n: [(str(n), 1)], add, combiner=add)).run(orders)


@query("SELECT count(*)::BIGINT AS input_records, count(*)::BIGINT AS shuffled_records, count(DISTINCT o_custkey)::BIGINT AS output_records FROM orders")
def mapreduce_job_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = _per_customer()
    stash(job.run(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("value"))), "job")
    s = job.stats()
    return spark.createDataFrame([(s["input_records"], s["shuffled_records"], s["output_records"])], "input_records long, shuffled_records long, output_records long")


@query("SELECT count(*)::BIGINT AS n_rows, count(DISTINCT o_custkey)::BIGINT AS n_keys, 0::BIGINT AS split_keys, 0::BIGINT AS outside FROM orders WHERE o_custkey % 7 <> 0")
def join_partition_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("k"))
    keys = joins.partition_dataset(o, "k", 8).groupBy("k").agg(F.count("*").alias("n"), F.min("part").alias("lo"), F.max("part").alias("hi"))
    return keys.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"), F.count_if(F.col("lo") != F.col("hi")).alias("split_keys"), F.count_if((F.col("lo") < 0) | (F.col("hi") > 7)).alias("outside"))


@query("SELECT o_custkey, o_orderkey FROM orders ORDER BY o_custkey NULLS LAST, o_orderkey")
def join_sort_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.sort_dataset(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


#: Later than all events.
_ADVANCED = 4_000_000_000_000_000


@query(f"WITH {_EV} SELECT left_seq, right_seq, join_ts FROM m UNION ALL SELECT seq, NULL, ts FROM a WHERE side = 'L' AND seq NOT IN (SELECT left_seq FROM m)")
def stream_join_advanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_join.stream_join_exact(_stream(spark, sf_dir), HOUR, LATE, "left", advance_to=_ADVANCED)


@query(f"WITH {_EV}, e2 AS (SELECT (max(ts) // {2 * HOUR}) * {HOUR} AS e FROM ev) SELECT k, (join_ts // {HOUR}) * {HOUR} AS window_start, (join_ts // {HOUR}) * {HOUR} + {HOUR} AS window_end, count(*)::BIGINT AS n FROM m, e2 GROUP BY k, window_start, window_end, e HAVING window_end <= (e // {HOUR}) * {HOUR}")
def tumbling_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _stream(spark, sf_dir)
    half = ev.agg(F.max("ts")).first()[0] // (2 * HOUR) * HOUR
    m = stream_join.stream_join_exact(ev, HOUR, LATE).join(ev.select(F.col("seq").alias("left_seq"), "k"), "left_seq")
    return stream_join.tumbling(m, HOUR, closed_by=half)


@query("SELECT l.event_id AS left_seq, r.event_id AS right_seq FROM events l JOIN events r ON l.user_id = r.user_id AND l.event_type = 'view' AND r.event_type = 'click' AND r.ts BETWEEN l.ts - INTERVAL 1 HOUR AND l.ts + INTERVAL 1 HOUR")
def stream_join_live_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Structured Streaming join, run over all files there are; the lateness covers the recorded span, so no event is late."""
    e = stream(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), "event_type")
    sides = [e.where(F.col("event_type") == t).drop("event_type") for t in ("view", "click")]
    where = f"{shared_dir(spark)}/tarnworks/live-{uuid.uuid4().hex}"
    joined = stream_join.stream_join_live(*sides, "1 HOUR", "400 days").select("left_seq", "right_seq")
    run = joined.writeStream.format("parquet").option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start(f"{where}/rows")
    run.awaitTermination()
    return spark.read.schema(joined.schema).parquet(f"{where}/rows")
