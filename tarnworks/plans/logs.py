"""Queries of changelogs, derived views, event stores and partitioned logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnworks.operators import changelog as cl
from tarnworks.operators import eventstore as es
from tarnworks.operators import log as lg
from tarnworks.plans.registry import query
from tarnworks.sources.tables import CHANGELOG_SQL, changelog, micros, stream, table

_L = f"log AS ({CHANGELOG_SQL}), ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn, lag(value) OVER w AS before, lag(op) OVER w AS was FROM log WINDOW w AS (PARTITION BY key ORDER BY seq)), live AS (SELECT * FROM ranked WHERE rn = 1 AND op = 'PUT')"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog(table(spark, sf_dir, "events"))


@query(f"WITH {_L} SELECT seq, key, op, value FROM live")
def cdc_current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.current_state(_log(spark, sf_dir))


@query(f"WITH {_L} SELECT seq, key, op, value FROM ranked WHERE rn = 1")
def cdc_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.latest(_log(spark, sf_dir))


@query(f"WITH {_L} SELECT seq, key, op, value FROM log WHERE seq >= 100 AND seq < 500")
def cdc_read_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.read_range(_log(spark, sf_dir), 100, 500)


@query(f"WITH {_L} SELECT seq, key, CASE WHEN op = 'DELETE' THEN 'delete' WHEN was = 'PUT' THEN 'update' ELSE 'insert' END AS kind, CASE WHEN was = 'PUT' THEN before END AS before, value AS after FROM ranked WHERE op = 'PUT' OR was = 'PUT'")
def cdc_ops_with_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.with_images(_log(spark, sf_dir))


@query(f"WITH {_L} SELECT key, upper(value) AS value FROM live WHERE value <> 'view'")
def cdc_view_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.current_state(_log(spark, sf_dir)).where("value <> 'view'").select("key", F.upper("value").alias("value"))


@query("SELECT DISTINCT token, c_custkey AS pk FROM (SELECT c_custkey, unnest(regexp_split_to_array(lower(concat_ws(' ', c_name, c_mktsegment)), '\\s+')) AS token FROM customer) WHERE token <> ''")
def cdc_search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.text_postings(table(spark, sf_dir, "customer"), "c_custkey", ["c_name", "c_mktsegment"])


@query(f"WITH {_L}, p AS (SELECT unnest(['a', 'b', 'c']) AS consumer, unnest([-1, 50, 900]) AS position), x AS (SELECT max(seq) AS latest FROM log) SELECT consumer, latest - position AS lag, (SELECT count(*) FROM log WHERE seq > position)::BIGINT AS pending FROM p, x")
def cdc_consumer_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.consumer_lag(_log(spark, sf_dir), spark.createDataFrame([("a", -1), ("b", 50), ("c", 900)], "consumer string, position long"))


@query(f"WITH {_L}, s AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM log WHERE seq <= 500) SELECT -1::BIGINT AS seq, key, op, value FROM s WHERE n = 1 AND op = 'PUT' UNION ALL SELECT * FROM log WHERE seq > 500")
def cdc_snapshot_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.snapshot_and_tail(_log(spark, sf_dir), 500)


@query(f"WITH {_L}, g AS (SELECT DISTINCT value AS grp FROM log WHERE value IS NOT NULL) SELECT grp, count(live.key)::BIGINT AS n FROM g LEFT JOIN live ON live.value = grp GROUP BY 1")
def view_count_with_zero_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.view_counts(_log(spark, sf_dir), F.col("value"))


@query(f"WITH {_L} SELECT value, string_agg(key, ',' ORDER BY seq) AS keys FROM live GROUP BY 1")
def view_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.view_lists(_log(spark, sf_dir))


@query(f"WITH {_L}, early AS (SELECT * FROM log WHERE seq <= 1000) SELECT seq, key, op, value FROM ranked WHERE rn = 1")
def view_incremental_equals_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    return cl.apply_delta(cl.latest(log.where("seq <= 1000")), log.where("seq > 1000"))


@query("SELECT 'p_brand' AS field, p_brand AS value, p_partkey AS pk FROM part UNION ALL SELECT 'p_size', p_size::VARCHAR, p_partkey FROM part")
def index_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.postings(table(spark, sf_dir, "part"), "p_partkey", ["p_brand", "p_size"])


@query("SELECT doc_id AS pk FROM documents WHERE list_contains(regexp_split_to_array(lower(text), '\\s+'), 'the') AND list_contains(regexp_split_to_array(lower(text), '\\s+'), 'of')")
def fulltext_and_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return cl.search_all(cl.text_postings(docs, "doc_id", ["text"]), ["the", "of"])


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("event_id"), F.col("conv_id").alias("stream_id"), F.col("role").alias("event_type"), F.length("text").cast("long").alias("size"))


_T = "t AS (SELECT conv_id * 1000 + turn AS event_id, conv_id AS stream_id, role AS event_type, length(text)::BIGINT AS size FROM conversations)"


@query(f"WITH {_T} SELECT stream_id, count(*)::BIGINT AS version, min(event_id) AS first_event FROM t GROUP BY 1")
def es_stream_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return es.stream_versions(_turns(spark, sf_dir))


@query(f"WITH {_T} SELECT stream_id, sum(CASE WHEN event_type = 'user' THEN size ELSE -size END)::BIGINT AS balance, count(CASE WHEN event_type = 'assistant' THEN 1 END)::BIGINT AS answers, max(event_id) AS position FROM t GROUP BY 1")
def es_balance_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return es.project(_turns(spark, sf_dir), {"balance": F.sum(F.when(F.col("event_type") == "user", F.col("size")).otherwise(-F.col("size"))), "answers": F.count(F.when(F.col("event_type") == "assistant", 1))})


@query(f"WITH {_T} SELECT stream_id, sum(size)::BIGINT AS total, max(event_id) AS position FROM t WHERE event_id <= 50002 GROUP BY 1")
def es_state_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return es.project(_turns(spark, sf_dir), {"total": F.sum("size")}, up_to=50002)


@query(f"WITH {_T}, v AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY event_id) AS version, CASE WHEN event_id % 5 = 0 THEN event_id % 3 END AS expected_version FROM t) SELECT event_id, stream_id, version, expected_version FROM v WHERE expected_version <> version - 1")
def es_version_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    appends = _turns(spark, sf_dir).withColumn("expected_version", F.when(F.col("event_id") % 5 == 0, F.col("event_id") % 3))
    return es.version_conflicts(appends).select("event_id", "stream_id", F.col("version").cast("long").alias("version"), "expected_version")


@query(f"WITH {_T} SELECT stream_id, sum(size)::BIGINT AS total, max(event_id) AS position FROM t GROUP BY 1")
def es_snapshot_plus_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir)
    tail = es.project(turns.where("event_id % 1000 > 2"), {"total": F.sum("size")})
    return es.snapshot_plus_tail(es.project(turns.where("event_id % 1000 <= 2"), {"total": F.sum("size")}), tail, ["total"])


@query("SELECT o_custkey AS stream_id, greatest(0, last(b ORDER BY o_orderkey))::BIGINT AS state FROM (SELECT *, sum(c) OVER w - least(0, min(s) OVER w2) AS b FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN -200 ELSE (o_orderkey % 100) END AS c, sum(CASE WHEN o_orderkey % 3 = 0 THEN -200 ELSE (o_orderkey % 100) END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS s FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey), w2 AS (PARTITION BY o_custkey ORDER BY o_orderkey)) GROUP BY 1")
def es_balance_never_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = F.when(F.col("o_orderkey") % 3 == 0, F.lit(-200).cast("long")).otherwise(F.col("o_orderkey") % 100)
    events = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("stream_id"), amount.alias("amount"))
    return es.balances(events)


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("ts_order"), F.when(F.col("event_id") % 10 != 0, F.col("user_id").cast("string")).alias("key"), F.col("event_type").alias("topic"), micros(F.col("ts")).alias("ts"))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lg.with_offsets(lg.assign(_messages(spark, sf_dir), 4))


_MOD = "0"
for _i in range(4):
    _MOD = f"((({_MOD}) * 4294967296 + ('0x' || substr(md5(key), {1 + 8 * _i}, 8))::BIGINT) % 4)"
_P = f"""msg AS (SELECT event_id AS ts_order, CASE WHEN event_id % 10 <> 0 THEN user_id::VARCHAR END AS key, event_type AS topic, epoch_us(ts) AS ts FROM events),
placed AS (SELECT *, CASE WHEN key IS NOT NULL THEN {_MOD} ELSE (row_number() OVER (PARTITION BY topic, key IS NULL ORDER BY ts_order) - 1) % 4 END::INT AS part FROM msg),
lg AS (SELECT *, row_number() OVER (PARTITION BY topic, part ORDER BY ts_order) - 1 AS log_offset FROM placed)"""


@query(f"WITH {_P} SELECT ts_order, key, topic, part, log_offset FROM lg")
def log_partition_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir).select("ts_order", "key", "topic", "part", "log_offset")


@query(f"WITH {_P} SELECT topic, part, key, log_offset FROM lg WHERE key IS NULL UNION ALL SELECT topic, part, key, max(log_offset) FROM lg WHERE key IS NOT NULL GROUP BY 1, 2, 3")
def log_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lg.compact(_placed(spark, sf_dir)).select("topic", "part", "key", "log_offset")


@query(f"WITH {_P}, x AS (SELECT *, max(log_offset) OVER (PARTITION BY topic, part) AS m FROM lg) SELECT topic, part, log_offset FROM x WHERE log_offset > m - 20")
def log_retention_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lg.retain_size(_placed(spark, sf_dir), 20).select("topic", "part", "log_offset")


@query(f"WITH {_P}, c AS (SELECT (min(ts) + max(ts)) // 2 AS c FROM lg), f AS (SELECT topic, part, min(log_offset) AS f FROM lg, c WHERE ts >= c GROUP BY 1, 2) SELECT topic, part, log_offset FROM lg JOIN f USING (topic, part) WHERE log_offset >= f")
def log_retention_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _placed(spark, sf_dir)
    lo, hi = _messages(spark, sf_dir).agg(F.min("ts"), F.max("ts")).first()
    return lg.retain_time(log, F.lit(((lo or 0) + (hi or 0)) // 2), "ts").select("topic", "part", "log_offset")


@query(f"WITH {_P} SELECT topic, part, min(log_offset) AS earliest, max(log_offset) + 1 AS latest, count(*)::BIGINT AS size FROM lg GROUP BY 1, 2")
def log_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lg.offsets(_placed(spark, sf_dir))


@query(f"WITH {_P}, p AS (SELECT topic, part, row_number() OVER (ORDER BY topic, part) - 1 AS rn FROM (SELECT DISTINCT topic, part FROM lg)) SELECT topic, part, ['c1', 'c2', 'c3'][rn % 3 + 1] AS consumer FROM p")
def log_group_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lg.group_assignment(_placed(spark, sf_dir), spark.createDataFrame([("c2",), ("c1",), ("c3",)], "consumer string"))


@query(f"WITH {_P} SELECT topic, part, log_offset FROM lg WHERE log_offset >= 5 AND topic = 'click' ORDER BY topic, part, log_offset LIMIT 100")
def log_poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = spark.createDataFrame([("click", p, 5) for p in range(4)], "topic string, part int, position long")
    return lg.poll(_placed(spark, sf_dir), start, 100).select("topic", "part", "log_offset")


@query("SELECT event_id, user_id AS stream_id, event_type FROM events WHERE user_id = (SELECT min(user_id) FROM events) AND event_id >= 100 ORDER BY 1")
def es_read_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("stream_id"), "event_type")
    return es.read_stream(events, events.agg(F.min("stream_id")).first()[0], 100)


@query("SELECT user_id AS stream_id, count(*)::BIGINT AS n, count(*) FILTER (event_type = 'purchase')::BIGINT AS purchases, max(event_id) AS position FROM events GROUP BY 1")
def es_live_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = stream(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("stream_id"), "event_type")
    return es.live_projection(events, {"n": F.count("*"), "purchases": F.count_if(F.col("event_type") == "purchase")})
