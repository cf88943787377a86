"""Queries of versions, transactions, replicas, clocks and agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnworks.operators import replicas as rp
from tarnworks.operators import storage
from tarnworks.operators import transactions as tx
from tarnworks.plans.registry import query
from tarnworks.sources.tables import table


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("created_by"), F.lead("o_orderkey").over(w).alias("deleted_by"))


_V = "v AS (SELECT o_custkey AS key, o_orderpriority AS value, o_orderkey AS created_by, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS deleted_by FROM orders)"
#: Transactions whose id divides by 9 were aborted; those of 500 and 501 still ran.
_OK = "o_orderkey % 9 <> 0 AND o_orderkey < 1000 AND o_orderkey NOT IN (500, 501) OR o_orderkey = 1000"


@query(f"WITH {_V}, ok AS (SELECT o_orderkey AS t FROM orders WHERE {_OK}) SELECT key, arg_max(value, created_by) AS value FROM v WHERE created_by IN (SELECT t FROM ok) AND (deleted_by IS NULL OR deleted_by NOT IN (SELECT t FROM ok)) GROUP BY 1")
def mvcc_visible_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    txs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tx"), F.when(F.col("o_orderkey") % 9 == 0, "aborted").otherwise("committed").alias("status"))
    return tx.visible(_versions(spark, sf_dir), txs, 1000, [500, 501])


def _txs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("tx"), (F.col("o_custkey") % 50 + F.expr("o_orderkey div 20") * 50).alias("key")), o.select(F.col("o_orderkey").alias("tx"), F.col("o_orderkey").alias("started"), (F.col("o_orderkey") + 2 + F.col("o_orderkey") % 5).alias("ended"))


_X = "w AS (SELECT o_orderkey AS tx, o_custkey % 50 + (o_orderkey // 20) * 50 AS key, o_orderkey AS started, o_orderkey + 2 + o_orderkey % 5 AS ended FROM orders)"


@query(f"WITH {_X} SELECT DISTINCT a.tx AS tx, b.tx AS other, a.key AS key FROM w a JOIN w b ON a.key = b.key AND a.tx <> b.tx AND b.ended < a.ended AND b.ended > a.started")
def mvcc_write_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.write_conflicts(*_txs(spark, sf_dir))


@query(f"WITH {_V} SELECT key, created_by FROM v WHERE deleted_by < 5000")
def mvcc_gc_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.garbage(_versions(spark, sf_dir), 5000)


@query("WITH r AS (SELECT c_custkey AS tx, c_custkey AS key, c_custkey * 7 AS start_ts FROM customer) SELECT tx, key, arg_max(o_orderpriority, o_orderkey) AS value FROM r JOIN orders ON o_custkey = key AND o_orderkey <= start_ts GROUP BY 1, 2")
def ssi_snapshot_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    readers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tx"), F.col("c_custkey").alias("key"), (F.col("c_custkey") * 7).alias("start_ts"))
    return tx.as_of(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("commit_ts"), F.col("o_orderpriority").alias("value")), readers)


@query(f"WITH {_X} SELECT DISTINCT a.tx AS reader, b.tx AS writer FROM w a JOIN w b ON a.key = b.key AND a.tx <> b.tx AND b.ended > a.started AND b.ended < a.ended")
def ssi_rw_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, t = _txs(spark, sf_dir)
    both = w.join(t, "tx")
    return tx.read_write_edges(both, both)


@query("SELECT o_custkey AS key, o_orderkey AS tx FROM orders WHERE o_orderkey > 300 AND o_orderkey <= 600 AND o_orderstatus = 'O'")
def ssi_phantoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the predicate (open orders) holds at 600 and not at 300."""
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("tx"))
    return rows.where("tx <= 600").exceptAll(rows.where("tx <= 300"))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id", F.col("event_id") % 3).orderBy("event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), (F.col("event_id") % 3).alias("replica"), F.count(F.when(F.col("event_type") != "error", 1)).over(w).alias("p"), F.count(F.when(F.col("event_type") == "error", 1)).over(w).alias("n"))


@query("SELECT user_id AS key, count(*) FILTER (event_type <> 'error')::BIGINT AS value FROM events GROUP BY 1")
def crdt_gcounter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.gcounter(_counts(spark, sf_dir).select("key", "replica", F.col("p").alias("n")))


@query("SELECT user_id AS key, (count(*) FILTER (event_type <> 'error') - count(*) FILTER (event_type = 'error'))::BIGINT AS value FROM events GROUP BY 1")
def crdt_pncounter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.pncounter(_counts(spark, sf_dir))


@query("SELECT user_id AS key, arg_max(event_type, (event_id // 10) * 10 + event_id % 3) AS value FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_id // 10, event_id % 3 ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 GROUP BY 1")
def crdt_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("key", "ts", "writer").orderBy(F.desc("event_id"))
    writes = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.expr("event_id div 10").alias("ts"), (F.col("event_id") % 3).alias("writer"), F.col("event_type").alias("value"), "event_id")
    return rp.lww(writes.withColumn("rn", F.row_number().over(w)).where("rn = 1"))


@query("SELECT DISTINCT user_id AS key, event_type AS element FROM events WHERE event_type <> 'error' AND event_id NOT IN (SELECT event_id - 1 FROM events WHERE event_type = 'error')")
def crdt_orset(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    adds = e.where("event_type <> 'error'").select(F.col("event_id").alias("tag"), F.col("user_id").alias("key"), F.col("event_type").alias("element"))
    return rp.orset(adds, e.where("event_type = 'error'").select((F.col("event_id") - 1).alias("tag")))


def _clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    clock = F.create_map(F.lit("a"), F.col("o_orderkey") % 4, F.lit("b"), F.col("o_orderkey") % 3)
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), clock.alias("clock"))


_C = "c AS (SELECT o_custkey AS key, o_orderkey AS id, o_orderkey % 4 AS a, o_orderkey % 3 AS b FROM orders)"


@query(
    f"""WITH {_C}, w AS (
        SELECT *, lead(id, 1) OVER v AS other, lead(a, 1) OVER v AS a2, lead(b, 1) OVER v AS b2 FROM c WINDOW v AS (PARTITION BY key ORDER BY id)
        UNION ALL SELECT *, lead(id, 2) OVER v, lead(a, 2) OVER v, lead(b, 2) OVER v FROM c WINDOW v AS (PARTITION BY key ORDER BY id))
    SELECT id, other, CASE WHEN (a < a2 OR b < b2) AND (a > a2 OR b > b2) THEN 'CONCURRENT' WHEN a < a2 OR b < b2 THEN 'BEFORE' WHEN a > a2 OR b > b2 THEN 'AFTER' ELSE 'EQUAL' END AS relation, greatest(a, a2) AS merged_a, greatest(b, b2) AS merged_b
    FROM w WHERE other IS NOT NULL"""
)
def vc_compare_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each version of a customer beside its next two."""
    by_key = Window.partitionBy("key").orderBy("id")
    later = F.array(*[F.struct(F.lead("id", n).over(by_key).alias("other"), F.lead("clock", n).over(by_key).alias("other_clock")) for n in (1, 2)])
    near = _clocks(spark, sf_dir).withColumn("later", later).select("id", "clock", F.explode("later").alias("x")).select("id", "clock", "x.*").where("other IS NOT NULL")
    merged = rp.merge_clocks(F.col("clock"), F.col("other_clock"))
    return near.select("id", "other", rp.compare_clocks(F.col("clock"), F.col("other_clock")).alias("relation"), merged["a"].alias("merged_a"), merged["b"].alias("merged_b"))


@query(f"WITH {_C} SELECT key, id FROM c x WHERE NOT EXISTS (SELECT 1 FROM c y WHERE y.key = x.key AND y.id <> x.id AND y.a >= x.a AND y.b >= x.b AND (y.a > x.a OR y.b > x.b))")
def vc_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.siblings(_clocks(spark, sf_dir)).select("key", "id")


@query("SELECT event_id, user_id % 5 AS node, row_number() OVER (PARTITION BY event_id // 100 ORDER BY event_id % 10, user_id % 5, event_id) AS place FROM events")
def lamport_total_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy(F.expr("event_id div 100")).orderBy(F.col("event_id") % 10, F.col("user_id") % 5, "event_id")
    return table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 5).alias("node"), F.row_number().over(w).cast("long").alias("place"))


def _trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 6 == 1, "send").when(F.col("event_id") % 6 == 4, "receive").otherwise("local")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 5).alias("node"), F.col("event_id").alias("seq"), F.expr("event_id div 6").alias("message"), kind.alias("kind"))


_TR = """t AS (SELECT event_id AS id, user_id % 5 AS node, event_id // 6 AS message, CASE event_id % 6 WHEN 1 THEN 'send' WHEN 4 THEN 'receive' ELSE 'local' END AS kind FROM events),
    hops AS (SELECT s.node AS sender, s.id AS sent, r.node AS receiver, r.id AS got FROM t s JOIN t r ON s.message = r.message AND s.kind = 'send' AND r.kind = 'receive')"""


@query(
    f"""WITH RECURSIVE {_TR}, h(node, begin) AS (
        SELECT node, id FROM t WHERE id = (SELECT min(id) FROM t)
        UNION SELECT receiver, got FROM h JOIN hops ON sender = node AND sent >= begin)
    SELECT id FROM t JOIN (SELECT node, min(begin) AS begin FROM h GROUP BY 1) USING (node) WHERE id >= begin AND id <> (SELECT min(id) FROM t)"""
)
def happens_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that the first one happens before."""
    trace = _trace(spark, sf_dir)
    return rp.happens_after(trace, trace.agg(F.min("id")).first()[0])


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("node"))
    version = (1 + (F.col("key") + F.col("node")) % 3).alias("version")
    return k.select("key", "node", version, F.concat(F.lit("v"), (F.col("key") % 2 + F.col("node")).cast("string")).alias("value"), ((F.col("key") + F.col("node") * 2) % 5 != 0).alias("available"))


_RP = "c AS (SELECT c_custkey AS key, n::INT AS node, 1 + (c_custkey + n) % 3 AS version, 'v' || (c_custkey % 2 + n)::VARCHAR AS value, (c_custkey + n * 2) % 5 <> 0 AS available FROM customer, range(3) AS r(n))"


@query(f"WITH {_RP}, l AS (SELECT * FROM c WHERE available), t AS (SELECT key, max(version) AS version FROM l GROUP BY 1 HAVING count(*) >= 2) SELECT key, version, string_agg(DISTINCT value, ',' ORDER BY value) AS vals FROM l JOIN t USING (key, version) GROUP BY 1, 2")
def quorum_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.quorum_read(_copies(spark, sf_dir), 2)


@query(f"WITH {_RP}, l AS (SELECT * FROM c WHERE available), t AS (SELECT key, max(version) AS w FROM l GROUP BY 1), e AS (SELECT key, n::INT AS node, w FROM t, range(4) AS r(n)) SELECT e.key AS key, e.node AS node, l.version AS has, w AS wants FROM e LEFT JOIN l ON l.key = e.key AND l.node = e.node WHERE l.version IS NULL OR l.version < w")
def anti_entropy_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.stale_copies(_copies(spark, sf_dir).where("available"), spark.createDataFrame([(i,) for i in range(4)], "node int"))


@query(f"WITH {_RP}, a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY node) AS rn FROM c WHERE available) WHERE rn <= 2), t AS (SELECT key, max(version) AS m FROM a GROUP BY 1) SELECT key, node FROM a JOIN t USING (key) WHERE version < m")
def stale_replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.read_repair(_copies(spark, sf_dir), 2)


@query(f"WITH {_RP} SELECT node AS target, CASE WHEN 120 >= key % 100 + 60 + node THEN 'expired' ELSE 'delivered' END AS status, count(*)::BIGINT AS n FROM c WHERE NOT available GROUP BY 1, 2")
def hints_delivered_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    hints = _copies(spark, sf_dir).where("NOT available").select(F.col("node").alias("target"), (F.col("key") % 100).alias("created"), (60 + F.col("node")).alias("ttl"))
    return rp.hint_status(hints, F.lit(120)).groupBy("target", "status").agg(F.count("*").alias("n"))


@query("SELECT unnest(['f1', 'f2', 'f3']) AS follower, (SELECT max(event_id) FROM events) - unnest([10, 200, 999]) AS lag")
def follower_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    applied = spark.createDataFrame([("f1", 10), ("f2", 200), ("f3", 999)], "follower string, lsn long")
    return rp.follower_lag(table(spark, sf_dir, "events").select(F.col("event_id").alias("lsn")), applied)


@query("SELECT session, seq, lsn, seen FROM (SELECT user_id AS session, event_id AS seq, (event_id * 31) % 1000 AS lsn, max((event_id * 31) % 1000) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM events) WHERE lsn < seen")
def monotonic_read_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.monotonic_violations(table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), ((F.col("event_id") * 31) % 1000).alias("lsn")))


@query("SELECT user_id AS key, arg_max(event_type, event_id) AS value FROM events GROUP BY 1")
def multi_leader_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("ts"), (F.col("event_id") % 3).alias("writer"), F.col("event_type").alias("value"))
    return rp.lww(changes)


@query("SELECT user_id % 3 AS observer, user_id AS member, CASE WHEN 20000 - m > 15000 THEN 'removed' WHEN 20000 - m > 12000 THEN 'dead' WHEN 20000 - m > 10500 THEN 'suspected' ELSE 'alive' END AS status FROM (SELECT user_id, max(event_id) AS m FROM events GROUP BY 1)")
def gossip_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("observer"), F.col("user_id").alias("member"), F.col("event_id").alias("heartbeat"), F.col("event_id").alias("updated"))
    return rp.member_status(members, F.lit(20000), 10500, 12000, 15000)


@query("SELECT event_id AS seq, user_id AS resource, token, coalesce(token >= m, true) AS accepted FROM (SELECT *, max(token) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM (SELECT *, event_id // 10 - event_id % 7 AS token FROM events))")
def fencing_accepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    writes = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("resource"), (F.expr("event_id div 10") - F.col("event_id") % 7).alias("token"))
    return rp.fenced_writes(writes)


@query("SELECT event_id // 4 AS tx, CASE WHEN count(DISTINCT CASE WHEN event_type <> 'error' THEN event_id % 4 END) = 4 THEN 'committed' ELSE 'aborted' END AS outcome FROM events GROUP BY 1")
def tx_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = table(spark, sf_dir, "events").select(F.expr("event_id div 4").alias("tx"), (F.col("event_id") % 4).alias("participant"), F.when(F.col("event_type") == "error", "no").otherwise("yes").alias("vote"))
    return rp.tx_outcomes(votes, 4)


@query("SELECT participant, tx FROM (SELECT event_id % 4 AS participant, user_id AS tx, arg_max(CASE event_type WHEN 'view' THEN 'prepared' WHEN 'click' THEN 'committed' ELSE 'aborted' END, event_id) AS s FROM events GROUP BY 1, 2) WHERE s = 'prepared'")
def tx_in_doubt(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("event_type") == "view", "prepared").when(F.col("event_type") == "click", "committed").otherwise("aborted")
    return rp.in_doubt(table(spark, sf_dir, "events").select((F.col("event_id") % 4).alias("participant"), F.col("user_id").alias("tx"), F.col("event_id").alias("seq"), state.alias("state")))


_PB = "m AS (SELECT 0 AS view_no, event_id // 12 AS sequence, 'd' || (event_id // 12 % 5)::VARCHAR AS digest, event_id % 4 AS sender, CASE WHEN event_type IN ('view', 'click') THEN 'PREPARE' ELSE 'COMMIT' END AS kind FROM events)"


@query(f"WITH {_PB} SELECT view_no, sequence, digest, count(DISTINCT CASE WHEN kind = 'PREPARE' THEN sender END)::BIGINT AS prepares, count(DISTINCT CASE WHEN kind = 'COMMIT' THEN sender END)::BIGINT AS commits FROM m GROUP BY 1, 2, 3 HAVING prepares >= 2 AND commits >= 3")
def pbft_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("view", "click"), "PREPARE").otherwise("COMMIT")
    seq = F.expr("event_id div 12")
    return rp.agreed(table(spark, sf_dir, "events").select(F.lit(0).alias("view_no"), seq.alias("sequence"), F.concat(F.lit("d"), (seq % 5).cast("string")).alias("digest"), (F.col("event_id") % 4).alias("sender"), kind.alias("kind")), 1)


@query("SELECT term, m AS commit_index FROM (SELECT term, m, row_number() OVER (PARTITION BY term ORDER BY m DESC, node) AS rn FROM (SELECT event_id // 500 AS term, user_id % 5 AS node, max(event_id) AS m FROM events GROUP BY 1, 2)) WHERE rn = 3")
def raft_commit_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    match = table(spark, sf_dir, "events").groupBy(F.expr("event_id div 500").alias("term"), (F.col("user_id") % 5).alias("node")).agg(F.max("event_id").alias("match_index"))
    return rp.commit_index(match, 5)


@query("SELECT cluster, tick, leader, previous FROM (SELECT user_id % 3 AS cluster, event_id AS tick, (event_id // 50) % 4 AS leader, lag((event_id // 50) % 4) OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS previous FROM events) WHERE previous IS NULL OR previous <> leader")
def election_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.leader_changes(table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("cluster"), F.col("event_id").alias("tick"), (F.expr("event_id div 50") % 4).alias("leader")))


@query("SELECT node, sum(CASE WHEN rn = slot THEN 1 ELSE 0 END)::BIGINT AS delivered FROM (SELECT event_id % 4 AS node, event_id // 4 AS slot, row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) - 1 AS rn FROM events WHERE event_id % 101 <> 100) GROUP BY 1")
def total_order_delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = table(spark, sf_dir, "events").where("event_id % 101 <> 100").select((F.col("event_id") % 4).alias("node"), F.expr("event_id div 4").alias("slot"))
    return rp.delivered_prefix(slots)


#: A step of the recursion is one op of every register.
_REGISTER = "o AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, event_type AS v, event_type = 'purchase' AS cas FROM events), r AS (SELECT key, 1::BIGINT AS rn, CASE WHEN NOT cas THEN v END AS state FROM o WHERE rn = 1 UNION ALL SELECT o.key, o.rn, CASE WHEN NOT o.cas OR r.state = 'view' THEN o.v ELSE r.state END FROM r JOIN o ON o.key = r.key AND o.rn = r.rn + 1)"


@query(f"WITH RECURSIVE {_REGISTER} SELECT key, arg_max(coalesce(state, ''), rn) AS value FROM r GROUP BY 1")
def linearizable_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "cas").otherwise("write")
    state = rp.register_state(e.select(F.col("user_id").alias("key"), F.col("event_id").alias("slot"), kind.alias("kind"), F.lit("view").alias("expected"), F.col("event_type").alias("value")))
    return state.select("key", F.coalesce("value", F.lit("")).alias("value"))


@query(f"WITH {_V}, ok AS (SELECT o_orderkey AS t FROM orders WHERE {_OK}) SELECT c_name AS key, arg_max(value, created_by) AS value FROM v JOIN customer ON key = c_custkey WHERE starts_with(c_name, 'Customer#0000000') AND created_by IN (SELECT t FROM ok) AND (deleted_by IS NULL OR deleted_by NOT IN (SELECT t FROM ok)) GROUP BY 1 ORDER BY 1")
def mvcc_prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    txs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tx"), F.when(F.col("o_orderkey") % 9 == 0, "aborted").otherwise("committed").alias("status"))
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust"), F.col("c_name").alias("key"))
    versions = _versions(spark, sf_dir).withColumnRenamed("key", "cust").join(names, "cust").drop("cust")
    return storage.prefix_scan(tx.visible(versions, txs, 1000, [500, 501]), "Customer#0000000")
