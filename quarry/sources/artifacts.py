"""Loading and checking of the search artifacts: products, vectors, index, vocabulary."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.sinks import CENTROIDS, INDEX, PRODUCTS, SETTINGS, VECTORS, VOCABULARY
from quarry.sources.storage import path_exists


@dataclass
class Artifacts:
    products: DataFrame
    vectors: DataFrame
    index: DataFrame
    vocabulary: DataFrame
    settings: dict[str, Any]
    centroids: np.ndarray | None = None


def check_alignment(products: DataFrame, vectors: DataFrame) -> None:
    """One vector for each product and one product for each vector, by row_id."""
    n_products, n_vectors = products.count(), vectors.count()
    if n_products != n_vectors:
        raise ValueError(f"products and vectors do not match: {n_products} rows against {n_vectors}")
    if not products.join(vectors, "row_id", "left_anti").isEmpty():
        raise ValueError("products and vectors do not match: a row_id has no vector")


def load_artifacts(spark: SparkSession, root: str) -> Artifacts:
    for name in (PRODUCTS, INDEX, VECTORS, VOCABULARY, SETTINGS):
        if not path_exists(spark, f"{root}/{name}"):
            raise FileNotFoundError(f"no {name} in the artifact folder: {root}/{name}")
    products = spark.read.parquet(f"{root}/{PRODUCTS}")
    if products.isEmpty():
        raise ValueError("the products table holds no rows")
    try:
        index = spark.read.parquet(f"{root}/{INDEX}")
    except AnalysisException as e:
        raise RuntimeError(f"the stored index cannot be read: {root}/{INDEX}") from e
    vectors = spark.read.parquet(f"{root}/{VECTORS}")
    check_alignment(products, vectors)
    settings = {k: v for k, v in spark.read.json(f"{root}/{SETTINGS}").first().asDict().items() if v is not None}
    centroids = None
    if settings["kind"] == "ivf":
        centroids = np.array([r["centroid"] for r in spark.read.parquet(f"{root}/{CENTROIDS}").orderBy("cell").collect()])  # about the root of the rows
    return Artifacts(products, vectors, index, spark.read.parquet(f"{root}/{VOCABULARY}"), settings, centroids)


def corpus_stats(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """(n, dim) in one pass."""
    return vectors.agg(F.count("*").alias("n"), F.max(F.size(vector_col)).cast("long").alias("dim"))
