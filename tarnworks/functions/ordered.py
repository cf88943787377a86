"""Running aggregates over an ordered table, or large groups of one, without a window that gathers them in one task.

The order column's range is cut into buckets, whose number follows the rows. Each bucket is aggregated, the bucket rows get
their running aggregate, and the rows of each bucket continue from there. Rows of a null order come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: At least so many buckets, and one for so many rows.
BUCKETS, BUCKET_ROWS = 4096, 1_000_000


def with_running(df: DataFrame, order: str, value: Column, how: str, name: str, inclusive: bool, by: tuple[str, ...] = ()) -> DataFrame:
    """df with the max or sum of value over all rows before each row in order (and that row, if inclusive), in each group of `by`. order: long."""
    fold = {"max": F.max, "sum": F.sum}[how]
    join = (lambda a, b: F.greatest(a, b)) if how == "max" else (lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    lo, hi, rows = df.agg(F.min(order), F.max(order), F.count("*")).first()
    width = ((hi - lo) // max(BUCKETS, rows // BUCKET_ROWS) + 1) if lo is not None else 1
    bucket = F.coalesce(F.floor((F.col(order) - F.lit(lo or 0)) / width).cast("long"), F.lit(-1).cast("long"))
    x = df.withColumn("__value", value).withColumn("__bucket", bucket)
    per = x.groupBy(*by, "__bucket").agg(fold("__value").alias("__own"))
    before = per.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__bucket").alias("__of"), fold("__own").over(Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    within = Window.partitionBy(*by, "__bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    same = F.col("__bucket") == F.col("__of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    # without groups there are few bucket rows; with groups Spark picks the join by their size
    near = x.join(before if by else F.broadcast(before), same)
    return near.withColumn(name, join(F.col("__before"), fold("__value").over(within))).drop("__bucket", "__value", "__before", "__of", *[f"__by_{c}" for c in by])
