"""Contiguous, nearly even shards of an ordered table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.storage import materialize, shuffle_partitions


def numbered(df: DataFrame, *keys: str) -> DataFrame:
    """df with `_pos`, the row's place (from 0) in the order of keys; no task ever sees more than a range of it."""
    ordered = df.repartitionByRange(shuffle_partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    at = materialize(ordered.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    at = at.withColumn("_pid", F.shiftright("_at", 33))
    sizes = at.groupBy("_pid").agg(F.count("*").alias("_n"))
    starts = sizes.select("_pid", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    placed = at.join(F.broadcast(starts), "_pid")  # one row a partition
    return placed.withColumn("_pos", F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_pid", "_start")


def shard_rows(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """df with `shard` (from 0): n runs of the order, the first rows % n of them one row longer."""
    if n <= 0:
        raise ZeroDivisionError("the number of shards must be positive")
    placed = numbered(df, *keys)
    total = placed.count()
    short, longer = divmod(total, n)
    pos = F.col("_pos")
    edge = longer * (short + 1)
    shard = F.when(pos < edge, F.floor(pos / (short + 1))).otherwise(longer + F.floor((pos - edge) / max(short, 1)))
    return placed.withColumn("shard", shard.cast("int")).drop("_pos")
