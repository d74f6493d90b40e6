"""Sinks and the versioned artifact folder."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.storage import path_exists, rename

PRODUCTS, VECTORS, INDEX, CENTROIDS, SETTINGS, VOCABULARY = "products", "vectors", "index", "centroids", "index_settings", "vocabulary"
ARTIFACTS = (PRODUCTS, VECTORS, INDEX, CENTROIDS, SETTINGS, VOCABULARY)
#: Rows that the legacy single JSON object may hold: it is one row, made in one task.
MOST_JSON_ROWS = 100_000
#: Tasks among which the rows of a cell are dealt.
CELL_TASKS = 8


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_products_json(df: DataFrame, path: str) -> None:
    """One UTF-8 object a line, non-ASCII kept as it is."""
    df.write.mode("overwrite").json(path)


def write_embedding_json(df: DataFrame, path: str, id_col: str = "id", vector_col: str = "embedding") -> None:
    """The legacy single object {ids, embeddings}, in id order; a table of more than MOST_JSON_ROWS is refused."""
    if df.limit(MOST_JSON_ROWS + 1).count() > MOST_JSON_ROWS:
        raise ValueError(f"one JSON object holds at most {MOST_JSON_ROWS} vectors; write_parquet takes any number")
    pairs = F.sort_array(F.collect_list(F.struct(F.col(id_col).cast("string").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))))
    row = df.agg(pairs.alias("p")).select(F.col("p.id").alias("ids"), F.col("p.v").alias("embeddings"))
    row.coalesce(1).write.mode("overwrite").json(path)


def write_index(df: DataFrame, path: str) -> None:
    """Vectors laid out by cell, so that a probe reads its cells only."""
    df.repartition("cell", F.pmod(F.xxhash64("row_id"), F.lit(CELL_TASKS))).write.mode("overwrite").partitionBy("cell").parquet(path)


def backup_if_exists(spark: SparkSession, root: str, names: tuple[str, ...] = ARTIFACTS, stamp: str | None = None) -> list[str]:
    """Rename what exists to <name>.bak.<YYYYmmdd_HHMMSS>; returns the new paths."""
    stamp, moved = stamp or time.strftime("%Y%m%d_%H%M%S"), []
    for name in names:
        if path_exists(spark, f"{root}/{name}"):
            rename(spark, f"{root}/{name}", f"{root}/{name}.bak.{stamp}")
            moved.append(f"{root}/{name}.bak.{stamp}")
    return moved


def swap_in(spark: SparkSession, root: str, staged: dict[str, DataFrame]) -> None:
    """Write each table beside its place, then back up the old ones and move the new ones in: a crash loses none."""
    stamp = time.strftime("%Y%m%d_%H%M%S")
    for name, df in staged.items():
        if name == SETTINGS:
            df.coalesce(1).write.mode("overwrite").text(f"{root}/{name}.new")
        else:
            (write_index if name == INDEX and "cell" in df.columns else write_parquet)(df, f"{root}/{name}.new")
    backup_if_exists(spark, root, tuple(staged), stamp)
    for name in staged:
        rename(spark, f"{root}/{name}.new", f"{root}/{name}")
