"""Proportional stratified interleaving into shards.

Rows are shuffled by a seeded hash of their text within each source and ranked; the fractional rank
(rank + 1/2) / rows of the source orders all rows, and equal cuts of that order give shards whose source mixture
matches the whole and whose row counts differ by at most one (law `rows`). The seeded hash is that of the text, so
equal texts of a source stand side by side and stay together except where a cut falls between them.

Ranking uses range partitions with per-partition offsets, so neither a hot source nor the whole table is ever ranked
in one task, and no text is shuffled.

Defined cases: a null text has no bytes (size 1, crc 0); a null source is a source of its own; repeated rows
are separate rows; fewer rows than shards leave shards empty; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialize, shuffle_partitions

SHARDS, SEED = 8, 20240229


def _numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with pid and idx: the row's range partition under keys and its place there."""
    ordered = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    stored = materialize(ordered.withColumn("at", at), name)
    return stored.withColumn("pid", F.shiftright("at", 33)).withColumn("idx", F.col("at").bitwiseAND((1 << 33) - 1)).drop("at")


def stratified_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, source) for every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("stratum"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.md5(F.concat(F.lit(f"{seed}:"), text)).alias("mix"),
    )
    rows = _numbered(rows, ["stratum", "mix", "doc_id"], "shard-strata")
    runs = rows.groupBy("stratum", "pid").agg(F.count("*").alias("n"), F.min("idx").alias("first"))
    earlier = Window.partitionBy("stratum").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("stratum", "pid", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("stratum")).alias("rows_of"))
    rank = F.col("before") + F.col("idx") - F.col("first")
    rows = rows.join(runs, ["stratum", "pid"]).withColumn("frac", (2 * rank + 1) / (2 * F.col("rows_of")))
    rows = _numbered(rows.drop("pid", "idx", "first", "before", "rows_of"), ["frac", "stratum", "mix", "doc_id"], "shard-order")
    starts = rows.groupBy("pid").agg(F.count("*").alias("n"))  # one row a partition
    starts = starts.select("pid", F.coalesce(F.sum("n").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    rows = rows.join(F.broadcast(starts), "pid")  # as many rows as shuffle partitions
    place = F.col("before") + F.col("idx")
    rows = rows.withColumn("shard", F.expr(f"cast(((before + idx) * {shards}) div total as int)"))
    slot = place - F.expr(f"(shard * total + {shards} - 1) div {shards}")
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "source")
