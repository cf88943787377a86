"""Consistent hashing: ring positions, owners, preference lists, load and moved keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def position(key: Column) -> Column:
    """The low 32 bits of the key's md5."""
    return F.conv(F.substring(F.md5(key), 25, 8), 16, 10).cast("long")


def vnodes(spark: SparkSession, nodes: list[str], n: int = 150, weights: dict[str, float] | None = None) -> DataFrame:
    """(node, pos) of int(n * weight) virtual nodes per node."""
    rows = spark.createDataFrame([(x, int(n * (weights or {}).get(x, 1.0))) for x in nodes], "node string, n int")
    return rows.where("n > 0").select("node", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).select("node", position(F.concat("node", F.lit(":"), F.col("i").cast("string"))).alias("pos"))


def _sorted_ring(ring: DataFrame) -> DataFrame:
    return ring.agg(F.sort_array(F.collect_list(F.struct("pos", "node"))).alias("ring"))


#: The circle is cut into cells of 2 ** CELL_BITS positions, by which keys and arcs are joined.
CELL_BITS = 20


def arcs(ring: DataFrame) -> DataFrame:
    """(lo, hi, nodes): keys at positions lo <= p < hi have their successors in this order, the nearest first."""
    turned = lambda i: F.array_distinct(F.transform(F.concat(F.slice("ring", i + 1, F.size("ring")), F.slice("ring", F.lit(1), i)), lambda x: x["node"]))
    before = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(F.col("ring"), i - 1)["pos"])
    inner = F.transform("ring", lambda x, i: F.struct(before(i).alias("lo"), x["pos"].alias("hi"), turned(i).alias("nodes")))
    last = F.array(F.struct(F.element_at("ring", -1)["pos"].alias("lo"), F.lit(4294967296).alias("hi"), turned(F.lit(0)).alias("nodes")))
    return _sorted_ring(ring).where(F.size("ring") > 0).select(F.explode(F.concat(inner, last)).alias("x")).select("x.*").where("lo < hi")


def owners(keys: DataFrame, ring: DataFrame, copies: int = 1) -> DataFrame:
    """keys with nodes: the first distinct nodes strictly clockwise of each key."""
    cells = arcs(ring).withColumn("cell", F.explode(F.sequence(F.shiftright("lo", CELL_BITS), F.shiftright(F.col("hi") - 1, CELL_BITS)))).withColumn("nodes", F.slice("nodes", 1, copies))
    placed = keys.withColumn("__pos", position(F.col("key"))).withColumn("cell", F.shiftright("__pos", CELL_BITS))
    return placed.join(cells, "cell").where("__pos >= lo AND __pos < hi").drop("cell", "__pos", "lo", "hi")


def load(ring: DataFrame) -> DataFrame:
    """(node, arc): the length of the circle that each node owns, of 2 ** 32."""
    rows = _sorted_ring(ring)
    arcs = F.transform("ring", lambda x, i: F.struct(x["node"].alias("node"), F.when(i == 0, x["pos"] + F.lit(4294967296) - F.element_at("ring", -1)["pos"]).otherwise(x["pos"] - F.get(F.col("ring"), i - 1)["pos"]).alias("arc")))
    return rows.select(F.explode(arcs).alias("x")).groupBy("x.node").agg(F.sum("x.arc").alias("arc"))


def moved(keys: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(from_node, to_node, n) of keys whose owner changes."""
    a = owners(keys, before).select("key", F.col("nodes")[0].alias("from_node"))
    both = owners(a, after).select("from_node", F.col("nodes")[0].alias("to_node"))
    return both.where("from_node <> to_node").groupBy("from_node", "to_node").agg(F.count("*").alias("n"))
