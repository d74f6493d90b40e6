"""Exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.vectors import as_vector, dot, l2_distance_squared

#: Queries that one batch may broadcast; larger batches are searched block by block.
BATCH_QUERIES = 2_000


def candidate_pool(top_k: int) -> int:
    return max(20 * top_k, 50)


def _score(metric: str, v: Column, q: Column) -> Column:
    """Greater is nearer."""
    if metric == "ip":
        return dot(v, q)
    if metric == "l2":
        return -l2_distance_squared(v, q)
    raise ValueError("metric must be one of: ip, l2")


def search(vectors: DataFrame, query: Sequence[float], n: int, metric: str = "ip", id_col: str = "row_id", vector_col: str = "embedding") -> DataFrame:
    """(id, _score, _rank) of the n nearest rows, ties to the smaller id: a top-n of each task, merged by the driver."""
    scored = vectors.select(F.col(id_col), _score(metric, F.col(vector_col), as_vector(query)).alias("_score"))
    best = scored.orderBy(F.desc("_score"), id_col).limit(n)
    ranks = Window.orderBy(F.desc("_score"), id_col)  # over n rows
    return best.withColumn("_rank", F.row_number().over(ranks))


def _best_of_batches(queries: list[tuple], n: int, metric: str):
    """For each Arrow batch of (id, vector) the n best rows of every query."""
    ids = [q for q, _ in queries]
    wanted = [np.asarray(v, dtype=np.float64) for _, v in queries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.asarray(batch.column(0))
            x = np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
            out = []
            for qid, q in zip(ids, wanted):
                score = (x * q).sum(axis=1) if metric == "ip" else -((x - q) ** 2).sum(axis=1)  # one order of sums for every row
                at = np.arange(len(score))
                if len(score) > n:
                    at = np.flatnonzero(score >= np.partition(score, len(score) - n)[len(score) - n])  # ties at the edge included
                at = at[np.lexsort((own[at], -score[at]))[:n]]
                out.append((np.full(len(at), qid), own[at], score[at]))
            columns = [pa.array(np.concatenate(c)) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "row_id", "_score"])

    return run


SCORED = "query_id long, row_id long, _score double"


def query_blocks(queries: DataFrame, query_id: str = "query_id", query_vector: str = "query_vector") -> Iterator[list[tuple]]:
    """(id, vector) of the queries that have a vector, in blocks of at most about BATCH_QUERIES."""
    blocks = max(1, -(-queries.count() // BATCH_QUERIES))
    for k in range(blocks):
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == k)
        asked = [(r[0], r[1]) for r in own.select(F.col(query_id).cast("long"), query_vector).collect() if r[1] is not None]
        if asked:
            yield asked


def best_of_blocks(spark: SparkSession, found: list[DataFrame], n: int) -> DataFrame:
    """(query_id, row_id, _score, _rank): the n best rows of each query, ties to the smaller id."""
    out = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], SCORED)
    ranks = Window.partitionBy("query_id").orderBy(F.desc("_score"), "row_id")
    return out.withColumn("_rank", F.row_number().over(ranks)).where(F.col("_rank") <= n)


def search_batch(vectors: DataFrame, queries: DataFrame, n: int, metric: str = "ip", id_col: str = "row_id", vector_col: str = "embedding", query_id: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """(query_id, id, _score, _rank) for many queries with integer ids; blocks of at most about BATCH_QUERIES of them
    travel with the tasks, each task keeps n rows a query and batch, and only those are shuffled."""
    if metric not in ("ip", "l2"):
        raise ValueError("metric must be one of: ip, l2")
    rows = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>"))
    found = [rows.mapInArrow(_best_of_batches(asked, n, metric), SCORED) for asked in query_blocks(queries, query_id, query_vector)]
    return best_of_blocks(vectors.sparkSession, found, n).withColumnsRenamed({"query_id": query_id, "row_id": id_col})


def pair_loss(pairs: DataFrame, similarity: Column, label: str = "label") -> DataFrame:
    """(loss): mean squared difference of similarity and label."""
    return pairs.agg(F.avg(F.pow(similarity - F.col(label), 2)).alias("loss"))
