"""Connected components of an edge table, by hooking and pointer jumping.

Each round gives every root the least root seen next to its tree, then halves the trees' heights. All state is in
tables: nothing is collected but the number of nodes that still moved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnworks.session import stash, unstash


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; root is the least node of its component.

    Rows with a null end are ignored; repeated, reversed and self edges are allowed.
    """
    one = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna()
    both = stash(one.union(one.select("v", "u")).distinct(), "edges")
    roots = stash(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root")), "roots")
    while True:
        near = both.join(roots.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("low"))
        seen = roots.join(near, "node").select("node", "root", F.least("root", "low").alias("low"))
        # as a table, so that the join on a giant tree's root can be split
        hook = stash(seen.groupBy("root").agg(F.min("low").alias("lower")), "hook")
        hooked = stash(seen.join(hook, "root").select("node", F.least("low", "lower").alias("root")), "hooked")
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("top"))
        jumped = stash(hooked.join(up, "root").select("node", F.col("top").alias("root")), "roots")
        moved = roots.withColumnRenamed("root", "was").join(jumped, "node").where("was <> root").limit(1).count()
        unstash(roots)
        unstash(hooked)
        unstash(hook)
        roots = jumped
        if not moved:
            unstash(both)
            return roots
