"""Queries of secondary indexes, ranges, rings, sketches, integrity trees, runs and schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnworks.functions import avro, bloom
from tarnworks.operators import changelog as cl
from tarnworks.operators import log as lg
from tarnworks.operators import merkle, ring, storage
from tarnworks.plans.registry import query
from tarnworks.sources.tables import CHANGELOG_SQL, changelog, table


def _bucket_sql(key: str, n: int) -> str:
    out = "0"
    for i in range(4):
        out = f"((({out}) * 4294967296 + ('0x' || substr(md5({key}), {1 + 8 * i}, 8))::BIGINT) % {n})"
    return f"{out}::INT"


@query(f"SELECT {_bucket_sql('p_partkey::VARCHAR', 4)} AS part, p_brand, count(*)::BIGINT AS n FROM part GROUP BY ALL")
def idx_doc_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(lg.md5_bucket(F.col("p_partkey").cast("string"), 4).alias("part"), "p_brand").agg(F.count("*").alias("n"))


@query(f"SELECT {_bucket_sql('p_brand', 4)} AS term_part, p_partkey AS pk, p_name FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)")
def idx_term_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    index = cl.postings(part, "p_partkey", ["p_brand"]).withColumn("term_part", lg.md5_bucket(F.col("value"), 4))
    wanted = part.agg(F.min("p_brand").alias("value"))
    return index.join(F.broadcast(wanted), "value").join(part.select(F.col("p_partkey").alias("pk"), "p_name"), "pk").select("term_part", "pk", "p_name")


@query("SELECT DISTINCT p_partkey AS pk FROM part WHERE lower(p_type) BETWEEN 'e' AND 'm' OR lower(p_brand) BETWEEN 'e' AND 'm'")
def idx_term_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = cl.postings(table(spark, sf_dir, "part"), "p_partkey", ["p_type", "p_brand"])
    return index.where(F.lower("value").between("e", "m")).select("pk").distinct()


@query(f"SELECT p_partkey AS pk, 1 AS doc_touched, len(list_distinct([{_bucket_sql('p_partkey::VARCHAR', 4)}, {_bucket_sql('p_brand', 4)}, {_bucket_sql('p_type', 4)}]))::INT AS term_touched FROM part")
def idx_touch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = lambda c: lg.md5_bucket(F.col(c).cast("string"), 4)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pk"), F.lit(1).alias("doc_touched"), F.size(F.array_distinct(F.array(b("p_partkey"), b("p_brand"), b("p_type")))).alias("term_touched"))


_CUTS = [(0, "", "Part#000000400"), (1, "Part#000000400", "Part#000001200"), (2, "Part#000001200", None)]


@query("SELECT p_partkey, p_name AS key, CASE WHEN p_name < 'Part#000000400' THEN 0 WHEN p_name < 'Part#000001200' THEN 1 ELSE 2 END AS part FROM part")
def range_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = spark.createDataFrame(_CUTS, "part int, start_key string, end_key string")
    return storage.route(table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("key")), bounds)


@query("SELECT p_name AS key, p_partkey FROM part WHERE p_name >= 'P' AND p_name < 'Q' ORDER BY 1")
def range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.range_scan(table(spark, sf_dir, "part").select(F.col("p_name").alias("key"), "p_partkey"), "P", "Q")


@query("SELECT count(DISTINCT c_custkey)::BIGINT AS n_keys, true AS small_enough, true AS disjoint FROM customer")
def range_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = storage.boundaries(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), 100)
    crossing = b.select(F.col("start_key").alias("s"), F.col("last_key").alias("e"))
    n_crossing = b.join(crossing, (F.col("s") > F.col("start_key")) & (F.col("s") <= F.col("last_key"))).agg(F.count("*").alias("x"))
    return b.agg(F.sum("n").alias("n_keys"), (F.max("n") <= 100).alias("small_enough")).crossJoin(n_crossing).select("n_keys", "small_enough", (F.col("x") == 0).alias("disjoint"))  # one row each


_MERGED = "s AS (SELECT row_number() OVER (ORDER BY c_nationkey) AS rn, c_nationkey::BIGINT AS part, count(*)::BIGINT AS n FROM customer GROUP BY c_nationkey), r AS (SELECT rn, part AS start_part, n FROM s WHERE rn = 1 UNION ALL SELECT s.rn, CASE WHEN r.n + s.n <= (SELECT count(*) // 6 FROM customer) THEN r.start_part ELSE s.part END, CASE WHEN r.n + s.n <= (SELECT count(*) // 6 FROM customer) THEN r.n + s.n ELSE s.n END FROM r JOIN s ON s.rn = r.rn + 1)"


@query(f"WITH RECURSIVE {_MERGED} SELECT start_part, max(n) AS n FROM r GROUP BY 1")
def range_merge_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("part")).agg(F.count("*").alias("n"))
    least = sizes.agg(F.sum("n")).first()[0] // 6
    return storage.merge_small(sizes, least)


_NODES = ["node-a", "node-b", "node-c"]


def _ring_sql(nodes: list[str]) -> str:
    return f"SELECT n || '' AS node, ('0x' || substr(md5(n || ':' || i::VARCHAR), 25, 8))::BIGINT AS pos FROM (SELECT unnest({nodes}) AS n), range(150) AS r(i)"


_K = "k AS (SELECT c_name AS key, ('0x' || substr(md5(c_name), 25, 8))::BIGINT AS p FROM customer)"


def _owner_sql(ring_name: str) -> str:
    return f"(SELECT key, coalesce(arg_min(node, pos) FILTER (pos > p), arg_min(node, pos)) AS node FROM k, {ring_name} GROUP BY key)"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_name").alias("key"))


@query(f"WITH r AS ({_ring_sql(_NODES)}), {_K} SELECT * FROM {_owner_sql('r')}")
def ring_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.owners(_customers(spark, sf_dir), ring.vnodes(spark, _NODES)).select("key", F.col("nodes")[0].alias("node"))


@query(f"WITH r AS ({_ring_sql(_NODES)}), {_K}, d AS (SELECT key, node, min((pos - p - 1 + 4294967296) % 4294967296) AS d FROM k, r GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY d) AS rn FROM d) SELECT key, string_agg(node, ',' ORDER BY rn) AS nodes FROM n WHERE rn <= 2 GROUP BY 1")
def ring_preference_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.owners(_customers(spark, sf_dir), ring.vnodes(spark, _NODES), 2).select("key", F.array_join("nodes", ",").alias("nodes"))


@query(f"WITH r AS ({_ring_sql(_NODES)}) SELECT node, sum(arc)::BIGINT AS arc FROM (SELECT node, pos - coalesce(lag(pos) OVER (ORDER BY pos, node), (SELECT max(pos) FROM r) - 4294967296) AS arc FROM r) GROUP BY 1")
def ring_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.load(ring.vnodes(spark, _NODES))


@query(f"WITH r AS ({_ring_sql(_NODES)}), r2 AS ({_ring_sql([*_NODES, 'node-d'])}), {_K} SELECT a.node AS from_node, b.node AS to_node, count(*)::BIGINT AS n FROM {_owner_sql('r')} a JOIN {_owner_sql('r2')} b USING (key) WHERE a.node <> b.node GROUP BY 1, 2")
def ring_moved_keys_on_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.moved(_customers(spark, sf_dir), ring.vnodes(spark, _NODES), ring.vnodes(spark, [*_NODES, "node-d"]))


#: Hash functions at this rate of false positives, for any number of items; the bits follow the table's rows.
_RATE = 0.01
_H = bloom.parameters(1_000_000, _RATE)[1]
_BITS = f"(SELECT ceil(-greatest(count(*), 1) * ln({_RATE}) / pow(ln(2), 2))::BIGINT FROM part)"


def _bits(parts: DataFrame) -> int:
    return bloom.parameters(max(parts.count(), 1), _RATE)[0]


def _half_sql(begin: int) -> str:
    return "('0x' || " + " || ".join(f"substr(md5(p_name), {begin + 14 - 2 * i}, 2)" for i in range(8)) + ")::UBIGINT"


_POS = f"pos AS (SELECT p_partkey, p_name, ((({_half_sql(1)})::HUGEINT + ({_half_sql(17)})::HUGEINT * i) % {_BITS})::INT AS pos FROM part, range({_H}) AS r(i))"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name")


@query(f"WITH {_POS} SELECT p_name, pos FROM pos")
def bloom_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    return parts.select("p_name", F.explode(bloom.positions(F.col("p_name"), _bits(parts), _H)).alias("pos"))


@query(f"WITH {_POS}, f AS (SELECT DISTINCT pos FROM pos WHERE p_partkey % 2 = 0) SELECT p_name FROM pos GROUP BY p_name HAVING count(DISTINCT pos) = count(DISTINCT CASE WHEN pos IN (SELECT pos FROM f) THEN pos END)")
def bloom_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    m = _bits(parts)
    return bloom.probe(parts, "p_name", bloom.build(parts.where("p_partkey % 2 = 0"), "p_name", m, _H), m, _H)


@query(f"WITH {_POS}, x AS (SELECT count(DISTINCT pos) AS x, {_BITS} AS m FROM pos) SELECT x::BIGINT AS bits_set, round(x / m, 9) AS density, round(pow(x / m, {_H}), 9) AS fp_rate, round(-(m / {_H}) * ln(1 - x / m), 4) AS n_estimate FROM x")
def bloom_density_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    m = _bits(parts)
    return bloom.estimates(bloom.build(parts, "p_name", m, _H), m, _H)


@query(f"WITH {_POS} SELECT pos, least(count(*), 15)::BIGINT AS n FROM pos GROUP BY 1")
def bloom_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    m = _bits(parts)
    halves = [bloom.build(parts.where(f"p_partkey % 2 = {i}"), "p_name", m, _H) for i in (0, 1)]
    return bloom.counting(bloom.union(*halves))


def _leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("idx"), F.concat(F.col("n_nationkey").cast("string"), F.lit(":"), "n_name").alias("data"))


_T = "l0 AS (SELECT i AS idx, sha256(coalesce(n_nationkey::VARCHAR || ':' || n_name, '')) AS hash FROM range(32) AS r(i) LEFT JOIN nation ON n_nationkey = i)" + "".join(f", l{k} AS (SELECT idx // 2 AS idx, sha256(string_agg(hash, '' ORDER BY idx)) AS hash FROM l{k - 1} GROUP BY 1)" for k in range(1, 6))


@query(f"WITH {_T} SELECT hash AS root_hash FROM l5")
def merkle_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.root(_leaves(spark, sf_dir), 25)


@query(f"WITH {_T} " + " UNION ALL ".join(f"SELECT {k} AS level, idx, hash FROM l{k} WHERE idx = {(11 >> k) ^ 1}" for k in range(5)))
def merkle_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proof(_leaves(spark, sf_dir), 25, 11)


@query("SELECT n_nationkey::BIGINT AS idx FROM nation WHERE n_nationkey % 7 = 3")
def merkle_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _leaves(spark, sf_dir)
    return merkle.diff(a, a.withColumn("data", F.when(F.col("idx") % 7 == 3, F.concat("data", F.lit("!"))).otherwise(F.col("data"))))


@query("SELECT c_custkey AS key, CASE WHEN c_custkey % 11 = 0 THEN 'removed' ELSE 'changed' END AS change FROM customer WHERE c_custkey % 11 = 0 OR c_custkey % 13 = 0 UNION ALL SELECT -c_custkey, 'added' FROM customer WHERE c_custkey % 17 = 0 AND c_custkey <> 0")
def kv_diff_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    b = a.where("key % 11 <> 0").withColumn("value", F.when(F.col("key") % 13 == 0, "x").otherwise(F.col("value")))
    return merkle.diff_keys(a, b.union(a.where("key % 17 = 0 AND key <> 0").select(-F.col("key"), "value")))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog(table(spark, sf_dir, "events")).select((F.col("seq") % 4).alias("run"), "key", "value", F.col("seq").alias("ts"))


_R = f"log AS ({CHANGELOG_SQL}), best AS (SELECT key, value, seq AS ts FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1)"


@query(f"WITH {_R} SELECT * FROM best")
def kv_merge_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.merge_runs(_runs(spark, sf_dir))


@query(f"WITH {_R} SELECT * FROM best WHERE value IS NOT NULL")
def kv_merge_drop_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.merge_runs(_runs(spark, sf_dir), True)


@query(f"WITH {_R} SELECT * FROM best WHERE value IS NOT NULL AND key >= '2' AND key < '5' ORDER BY key")
def lsm_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.range_scan(storage.merge_runs(_runs(spark, sf_dir), True), "2", "5")


@query(f"WITH {_R} SELECT min(key) AS min_key, max(key) AS max_key, count(*)::BIGINT AS n_keys FROM best WHERE value IS NOT NULL")
def btree_extrema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.extrema(storage.merge_runs(_runs(spark, sf_dir), True))


@query(f"WITH {_R}, s AS (SELECT seq // 100 AS segment, count(*)::BIGINT AS records FROM log GROUP BY 1) SELECT segment, records, (SELECT count(*) FROM best WHERE ts // 100 = segment AND value IS NOT NULL)::BIGINT AS live FROM s")
def bitcask_stale_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = changelog(table(spark, sf_dir, "events")).select(F.expr("seq div 100").alias("segment"), "key", "seq", "value")
    return storage.stale_records(log)


def _wal(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("seq") % 20 == 0, "BEGIN").when((F.col("seq") % 20 == 9) & (F.col("seq") % 60 != 9), "COMMIT").otherwise(F.col("op"))
    return changelog(table(spark, sf_dir, "events")).select("seq", kind.alias("op"), "key", "value")


@query(f"WITH log AS ({CHANGELOG_SQL}), w AS (SELECT seq, CASE WHEN seq % 20 = 0 THEN 'BEGIN' WHEN seq % 20 = 9 AND seq % 60 <> 9 THEN 'COMMIT' ELSE op END AS op, key, value FROM log WHERE seq > 0), i AS (SELECT *, sum(CASE WHEN op = 'BEGIN' THEN 1 ELSE 0 END) OVER (ORDER BY seq) AS island FROM w) SELECT seq, op, key, value FROM i WHERE op IN ('PUT', 'DELETE') AND (island = 0 OR island IN (SELECT island FROM i WHERE op = 'COMMIT'))")
def wal_replay_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.replay_committed(_wal(spark, sf_dir))


_FILES = "SELECT l_suppkey % 40 AS file, (l_suppkey % 40) % 2 AS level, count(*)::BIGINT AS size, min(l_orderkey + (l_suppkey % 40) * 100) AS min_key, min(l_orderkey + (l_suppkey % 40) * 100) + 250 AS max_key FROM lineitem GROUP BY 1, 2"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("file", F.col("l_suppkey") % 40)
    lo = F.min(F.col("l_orderkey") + F.col("file") * 100)
    return li.groupBy("file", (F.col("file") % 2).alias("level")).agg(F.count("*").alias("size"), lo.alias("min_key"), (lo + 250).alias("max_key"))


@query(f"WITH f AS ({_FILES}) SELECT CASE WHEN size < 150 THEN 0 WHEN size < 1500 THEN 1 WHEN size < 15000 THEN 2 ELSE 3 END AS tier, count(*)::BIGINT AS n_files, sum(size)::BIGINT AS total FROM f GROUP BY 1 HAVING count(*) >= 4")
def compaction_size_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.size_tiers(_files(spark, sf_dir), [150, 1500, 15000], 4)


@query(f"WITH f AS ({_FILES}) SELECT a.file AS file, count(b.file)::BIGINT AS n_overlapping FROM f a LEFT JOIN f b ON b.level = 1 AND b.min_key <= a.max_key AND b.max_key >= a.min_key WHERE a.level = 0 GROUP BY 1")
def compaction_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.overlaps(_files(spark, sf_dir))


_ORDER = {"type": "record", "name": "order", "fields": [{"name": "o_orderkey", "type": "long"}, {"name": "o_custkey", "type": "long"}, {"name": "o_orderpriority", "type": ["null", "string"]}, {"name": "o_totalprice", "type": "double"}]}
_NEWER = {"type": "record", "name": "order", "fields": [{"name": "o_orderkey", "type": "long"}, {"name": "o_orderpriority", "type": ["null", "string"]}, {"name": "channel", "type": "string", "default": "web"}]}


@query("SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice FROM orders")
def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avro.decode_rows(avro.encode_rows(table(spark, sf_dir, "orders"), _ORDER), _ORDER, _ORDER, "o_orderkey long, o_custkey long, o_orderpriority string, o_totalprice double")


@query("SELECT o_orderkey, o_orderpriority, 'web' AS channel FROM orders")
def schema_resolve_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avro.decode_rows(avro.encode_rows(table(spark, sf_dir, "orders"), _ORDER), _ORDER, _NEWER, "o_orderkey long, o_orderpriority string, channel string")


@query("SELECT w, r, (w = r) OR (w = 'int' AND r IN ('long', 'float', 'double')) OR (w = 'long' AND r IN ('float', 'double')) OR (w = 'float' AND r = 'double') AS ok FROM (SELECT unnest(['null', 'boolean', 'int', 'long', 'float', 'double', 'string', 'bytes']) AS w), (SELECT unnest(['null', 'boolean', 'int', 'long', 'float', 'double', 'string', 'bytes']) AS r)")
def schema_compat_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = ["null", "boolean", "int", "long", "float", "double", "string", "bytes"]
    return spark.createDataFrame([(w, r, not avro.readable(w, r)) for w in types for r in types], "w string, r string, ok boolean")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id * 2 ELSE event_id * 2 + 1 END AS zigzag, CASE WHEN event_id % 2 = 0 THEN event_id ELSE -event_id - 1 END AS back FROM events")
def zigzag_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.when(F.col("event_id") % 2 == 0, F.col("event_id")).otherwise(-F.col("event_id") - 1)
    return table(spark, sf_dir, "events").select("event_id", avro.zigzag(n).alias("zigzag")).select("event_id", "zigzag", avro.unzigzag(F.col("zigzag")).alias("back"))


@query(f"SELECT {_bucket_sql('p_partkey::VARCHAR', 4)} AS doc_part, p_partkey AS pk, p_name FROM part WHERE p_size BETWEEN 10 AND 12")
def idx_doc_query_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").where(F.col("p_size").between(10, 12))
    return part.select(lg.md5_bucket(F.col("p_partkey").cast("string"), 4).alias("doc_part"), F.col("p_partkey").alias("pk"), "p_name")


@query("SELECT CASE WHEN v < 'h' THEN 0 WHEN v < 'p' THEN 1 ELSE 2 END AS term_part, count(*)::BIGINT AS n_postings, count(DISTINCT v)::BIGINT AS n_terms FROM (SELECT lower(p_type) AS v, p_partkey FROM part UNION ALL SELECT lower(p_brand), p_partkey FROM part) GROUP BY 1")
def idx_term_range_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = cl.postings(table(spark, sf_dir, "part"), "p_partkey", ["p_type", "p_brand"]).select(F.lower("value").alias("key"), "pk")
    bounds = spark.createDataFrame([(0, ""), (1, "h"), (2, "p")], "part int, start_key string")
    routed = storage.route(index, bounds).groupBy("part", "key").agg(F.count("*").alias("n"))
    return routed.groupBy(F.col("part").alias("term_part")).agg(F.sum("n").alias("n_postings"), F.count("*").alias("n_terms"))


@query("WITH f AS (SELECT floor(median(p_partkey) + 0.5)::BIGINT AS half FROM part) SELECT 'p_brand' AS field, p_brand AS value, p_partkey <= f.half AS visible, count(*)::BIGINT AS n FROM part, f GROUP BY ALL")
def idx_deferred_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    flushed = int(part.agg(F.expr("percentile(p_partkey, 0.5)")).first()[0] + 0.5)
    index = cl.pending_index(part, "p_partkey", ["p_brand"], "p_partkey", flushed)
    return index.groupBy("field", "value", "visible").agg(F.count("*").alias("n"))


@query("SELECT p_name AS key, p_partkey FROM part WHERE starts_with(p_name, 'Part#0000001') ORDER BY 1")
def kv_prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.prefix_scan(table(spark, sf_dir, "part").select(F.col("p_name").alias("key"), "p_partkey"), "Part#0000001")


@query(f"WITH {_POS}, c AS (SELECT pos, least(count(*), 15)::BIGINT AS n, count(*) FILTER (p_partkey % 3 = 0)::BIGINT AS gone FROM pos GROUP BY 1) SELECT pos, CASE WHEN n >= 15 THEN n ELSE greatest(n - gone, 0) END AS n FROM c WHERE CASE WHEN n >= 15 THEN n ELSE greatest(n - gone, 0) END > 0")
def bloom_counting_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    m = _bits(parts)
    return bloom.remove(bloom.counting(bloom.build(parts, "p_name", m, _H)), bloom.build(parts.where("p_partkey % 3 = 0"), "p_name", m, _H))


@query("WITH s AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i FROM part) SELECT p_brand, CASE WHEN i < 4 THEN 0 WHEN i < 12 THEN 1 WHEN i < 28 THEN 2 WHEN i < 60 THEN 3 WHEN i < 124 THEN 4 WHEN i < 252 THEN 5 ELSE 6 + floor(log2((i + 4) / 256))::INT END AS slice, count(*)::BIGINT AS n FROM s GROUP BY ALL")
def bloom_scalable_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_brand").alias("grp"))
    return bloom.slices(parts, "p_partkey", 4).groupBy("p_brand", "slice").agg(F.count("*").alias("n"))


@query("SELECT unnest(['given', 'changed']) AS leaf, unnest([true, false]) AS valid")
def merkle_verify_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = _leaves(spark, sf_dir)
    path, top, leaf = merkle.proof(leaves, 25, 11), merkle.root(leaves, 25), leaves.where("idx = 11")
    given = merkle.verify(leaf, path, top).select(F.lit("given").alias("leaf"), "valid")
    return given.unionByName(merkle.verify(merkle.update_leaf(leaf, 11, "other"), path, top).select(F.lit("changed").alias("leaf"), "valid"))


_T2 = _T.replace("coalesce(n_nationkey::VARCHAR", "coalesce(CASE WHEN i = 11 THEN 'other' END, n_nationkey::VARCHAR")


@query(f"WITH {_T2} SELECT hash AS root_hash FROM l5")
def merkle_update_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.root(merkle.update_leaf(_leaves(spark, sf_dir), 11, "other"), 25)


@query("SELECT n_nationkey::BIGINT AS idx FROM nation WHERE n_nationkey % 9 = 4")
def merkle_diff_descend(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _leaves(spark, sf_dir)
    return merkle.diff_descend(a, a.withColumn("data", F.when(F.col("idx") % 9 == 4, F.concat("data", F.lit("!"))).otherwise(F.col("data"))), 25)
