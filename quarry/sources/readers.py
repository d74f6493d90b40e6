"""Catalog sources: CSV, JSON, JSON lines and Parquet into one declared schema."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.schema import CATALOG, CATEGORY, RAW_PRODUCT
from quarry.sources.storage import path_exists

log = logging.getLogger("quarry.sources")


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV file with a header; columns are taken by name, so the file may have more of them or in another order.

    A blank price or rating is NaN, which passes every bound, unlike an absent field, which counts as 0.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    named = {c.lower(): c for c in raw.columns}
    columns = []
    for f in schema:
        if f.name.lower() not in named:
            columns.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        column = F.col(f"`{named[f.name.lower()]}`")
        value = F.lower(F.trim(column)) == "true" if isinstance(f.dataType, T.BooleanType) else column.cast(f.dataType)
        columns.append((F.coalesce(value, F.lit(float("nan"))) if isinstance(f.dataType, T.DoubleType) else value).alias(f.name))
    return raw.select(*columns)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = CATALOG) -> DataFrame:
    """One object a line; blank lines are no rows."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("p")).select("p.*")


def read_json(spark: SparkSession, path: str, schema: T.StructType = CATALOG) -> DataFrame:
    """An array of products, or an object that holds one under `products`; anything else is a ValueError."""
    seen = spark.read.option("multiLine", True).json(path)
    if "products" in seen.columns:
        kind = seen.schema["products"].dataType
        if not isinstance(kind, T.ArrayType):
            raise ValueError(f"neither an array of products nor an object that holds one: {path}")
        wrapped = T.StructType([T.StructField("products", T.ArrayType(schema))])
        return spark.read.option("multiLine", True).schema(wrapped).json(path).select(F.explode("products").alias("p")).select("p.*")
    first = spark.read.text(path, wholetext=True).select(F.substring(F.ltrim(F.regexp_replace("value", r"^[\s﻿]+", "")), 1, 1).alias("c")).first()
    if first is None or first["c"] != "[":
        raise ValueError(f"neither an array of products nor an object that holds one: {path}")
    return spark.read.option("multiLine", True).schema(schema).json(path)


def read_parquet(spark: SparkSession, path: str, schema: T.StructType = CATALOG) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


READERS: dict[str, Callable[..., DataFrame]] = {
    ".csv": lambda spark, path: read_csv(spark, path, CATALOG),
    ".jsonl": read_jsonl,
    ".json": read_json,
    ".parquet": read_parquet,
}


def load_products(spark: SparkSession, path: str) -> DataFrame:
    """Products by suffix. Pickles are declined: reading one runs the code in it."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no product file: {path}")
    suffix = os.path.splitext(path.rstrip("/"))[1]
    if suffix not in READERS:
        raise ValueError(f"no reader for {suffix or 'files without a suffix'}: {path}")
    return READERS[suffix](spark, path)


def load_categories(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, CATEGORY)


def load_raw_products(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, RAW_PRODUCT)


def load_sample_catalog(spark: SparkSession, data_dir: str, filename: str = "sample_products.json") -> DataFrame:
    """The sample catalog, or no rows and a warning where there is none."""
    path = os.path.join(data_dir, filename)
    if not path_exists(spark, path):
        log.warning("no sample catalog: %s", path)
        return spark.createDataFrame([], CATALOG)
    return read_json(spark, path)


def load_fashion_catalog(spark: SparkSession, data_dir: str, filename: str = "processed/fashion_products.parquet") -> DataFrame:
    """The prepared catalog, or no rows and an error in the log where there is none."""
    path = os.path.join(data_dir, filename)
    if not path_exists(spark, path):
        log.error("no prepared catalog: %s", path)
        return spark.createDataFrame([], CATALOG)
    return read_csv(spark, path, CATALOG) if path.endswith(".csv") else spark.read.parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, embedding array<float>) of a vector table."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no vector table: {path}")
    return spark.read.parquet(path).select(F.col("row_id").cast("long").alias("row_id"), F.col("embedding").cast("array<float>").alias("embedding"))


def explode_embedding_json(spark: SparkSession, path: str) -> DataFrame:
    """(id, embedding) of a legacy file {ids: [...], embeddings: [[...]]}."""
    kind = "ids array<string>, embeddings array<array<double>>"
    pairs = spark.read.option("multiLine", True).schema(kind).json(path).select(F.explode(F.arrays_zip("ids", "embeddings")).alias("z"))
    return pairs.select(F.col("z.ids").alias("id"), F.col("z.embeddings").alias("embedding"))
