"""Matrices whose cells still arrive: running reductions over a stream of cell files.

A cell may come in several parts (counts of one observation and variable from several files), which add up. Sums by
axis are kept as partial sums, a folder for each micro-batch that a repeated batch writes anew, so a restart after a
failure neither loses nor doubles any; reading them back adds them up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.frame import Matrix

SCHEMA = "obs_id long, var_id long, value double"
_KEYS = {0: "var_id", 1: "obs_id"}


def arriving(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the cells in the Parquet files that come to a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def running_sums(cells: DataFrame, axis: int) -> DataFrame:
    """Sums and numbers of cells by variable (0) or observation (1), for output modes complete and update."""
    if axis not in _KEYS:
        raise ValueError("axis is 0 or 1")
    return cells.where("value <> 0").groupBy(_KEYS[axis]).agg(F.sum("value").alias("total"), F.count("*").alias("cells"))


def keep_sums(cells: DataFrame, axis: int, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts to keep the sums of a stream at ``path``; ``checkpoint`` is a folder that outlives the query."""

    def write(batch: DataFrame, number: int) -> None:
        running_sums(batch, axis).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return cells.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def kept_sums(spark: SparkSession, axis: int, path: str) -> DataFrame:
    """The sums of all batches so far."""
    return spark.read.parquet(path).groupBy(_KEYS[axis]).agg(F.sum("total").alias("total"), F.sum("cells").alias("cells"))


def matrix_so_far(spark: SparkSession, obs: DataFrame, var: DataFrame, path: str) -> Matrix:
    """The matrix of the cells that have come, parts of a cell added up."""
    cells = spark.read.schema(SCHEMA).parquet(path).groupBy("obs_id", "var_id").agg(F.sum("value").alias("value"))
    return Matrix.of(obs, var, cells)
