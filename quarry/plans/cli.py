"""Command line: build the search artifacts of a product file."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from quarry.functions.encoders import HashingEncoder
from quarry.operators.shard import numbered
from quarry.plans.engine import build_artifacts
from quarry.sources.config import get_logger
from quarry.sources.readers import load_products


def parser() -> argparse.ArgumentParser:
    """The flags and their defaults are the interface."""
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--products", help="a product file; needed unless only the index is rebuilt")
    p.add_argument("--model-name", default="hashing-64", help="hashing-<dimensions>")
    p.add_argument("--batch-size", type=int, default=256, help="rows of an Arrow batch")
    p.add_argument("--index-type", default="hnsw", choices=["hnsw", "flat", "ivf"])
    p.add_argument("--nlist", type=int, default=None, help="cells of an inverted file")
    p.add_argument("--hnsw-m", type=int, default=32, help="links of a graph index")
    p.add_argument("--rebuild-index-only", action="store_true")
    p.add_argument("--output", default="data/embeddings")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("quarry-build").getOrCreate()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", args.batch_size)
    products = None
    if not args.rebuild_index_only:
        if not args.products:
            parser().error("--products is needed unless --rebuild-index-only is given")
        loaded = load_products(spark, args.products)
        products = numbered(loaded, *[c for c in ("asin", "id", "title") if c in loaded.columns]).withColumnRenamed("_pos", "row_id")
    encoder = HashingEncoder(int(args.model_name.rpartition("-")[2]))
    took = build_artifacts(spark, products, args.output, encoder, args.index_type, args.nlist, args.hnsw_m, args.rebuild_index_only)
    get_logger("quarry.build").info("Build complete after %.1f s: %s", took, args.output)


if __name__ == "__main__":
    main()
