"""Numbers along an order of a whole relation, never sorted in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Values looked at to cut the order into ranges; they balance the ranges and decide nothing else.
SAMPLE = 20_000


def numbered(df: DataFrame, key: str, name: str = "_place", most: int | None = None) -> DataFrame:
    """``df`` with ``name``, the place 0, 1, ... of each row in the order of ``key``, nulls first; rows of one key in any order.

    Ranges of the key are numbered apart, and each is moved by the rows of the ranges before it.
    """
    spark = df.sparkSession
    n = most if most is not None else df.count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seen = sorted(r[0] for r in df.where(F.col(key).isNotNull()).select(key).sample(min(1.0, SAMPLE / max(n, 1)), seed=1).limit(2 * SAMPLE).collect())
    cuts = sorted({seen[len(seen) * k // parts] for k in range(1, parts)}) if seen else []
    place = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(key))) if cuts else F.lit(0)
    ranged = df.withColumn("_range", F.coalesce(F.when(F.col(key).isNotNull(), place + 1), F.lit(0)))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    moved = ranged.groupBy("_range").agg(F.count("*").alias("_rows")).select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_moved"))
    within = F.row_number().over(W.partitionBy("_range").orderBy(key)) - 1
    return ranged.withColumn("_within", within).join(F.broadcast(moved), "_range").withColumn(name, (F.col("_within") + F.col("_moved")).cast("long")).drop("_range", "_within", "_moved")
