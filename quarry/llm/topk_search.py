"""Exact top-k search by exhaustive term-at-a-time accumulation.

Queries and corpus are sparse rows (id, terms, weights). Query rows travel to the corpus in blocks of bounded size, so the
corpus is never shuffled or copied; each pass over it answers one block. A task inverts its rows, block by block, into
postings, each term of a query scatters its weighted postings into a dense score array, partition selection keeps the
block's k best, and a ranked merge over the blocks and then over the tasks gives the final k. No row is skipped, so the
answer is exact. Answers of a block of queries are stored before the next block is read, so the driver holds one block.

Defined cases: fewer than k candidates give as many rows as there are; rows with null terms or weights take no part;
equal scores go to the smaller id; rows that carry the query's own id are not its candidates; a repeated corpus row is
a candidate for each of its repetitions, and query rows of one id are queries of their own, each with its k rows; an empty
side gives no rows. Weights and scores are 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialize

#: Rows of a query block, which the driver holds and every task reads, and of a corpus block within a task.
QUERY_BLOCK, CORPUS_BLOCK = 16_384, 4096
SCALE = 256
FOUND = "query long, query_id long, vec_id long, score long"


def quantize(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Sparse rows (id, terms, weights) with weights floor(scale * x); rows with missing or non-finite parts are left out."""
    x = F.col(vector_col)
    fit = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    parts = F.filter(F.transform(x, lambda v, i: F.struct(i.cast("int").alias("t"), F.floor(v.cast("double") * scale).alias("w"))), lambda s: s["w"] != 0)
    rows = vectors.where(F.coalesce(fit, F.lit(False)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), parts.alias("p"))
    return rows.select("id", F.col("p.t").alias("terms"), F.col("p.w").cast("array<long>").alias("weights"))


class Block:
    """Corpus rows, inverted: for each term the rows that hold it and their weights."""

    def __init__(self, rows: pa.RecordBatch):
        ids = np.asarray(rows.column(0))
        terms, weights = rows.column(1), rows.column(2)
        of = np.repeat(np.arange(len(ids)), np.diff(np.asarray(terms.offsets)))
        by_id = np.argsort(ids, kind="stable")  # the place tells which of two equal scores goes first
        place = np.empty(len(ids), dtype=np.int64)
        place[by_id] = np.arange(len(ids))
        self.ids, self.tie = ids[by_id], np.arange(len(ids) - 1, -1, -1, dtype=np.int64)
        term, weight, row = np.asarray(terms.flatten()), np.asarray(weights.flatten()), place[of]
        order = np.argsort(term, kind="stable")
        held, starts = np.unique(term[order], return_index=True)
        ends = [*starts[1:].tolist(), len(order)]
        self.lists = {t: (row[order[x:y]], weight[order[x:y]]) for t, x, y in zip(held.tolist(), starts.tolist(), ends)}

    def best(self, query_id: int, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the k best rows but the query's own."""
        score = np.zeros(len(self.ids), dtype=np.int64)
        for t, w in zip(terms.tolist(), weights.tolist()):
            if (hit := self.lists.get(t)) is not None:
                score[hit[0]] += w * hit[1]
        key = score * len(self.ids) + self.tie
        own = slice(*np.searchsorted(self.ids, [query_id, query_id + 1]))
        at = np.delete(np.arange(len(key)), own) if own.start < own.stop else np.arange(len(key))
        if len(at) > k:
            at = at[np.argpartition(key[at], len(at) - k)[len(at) - k :]]
        return score[at], self.ids[at]


def _search(asked, k: int, corpus_block: int):
    """For each task the k best of its rows for every query of the broadcast `asked`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = asked.value
        best = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))] * len(queries)
        for batch in batches:
            for start in range(0, batch.num_rows, corpus_block):
                block = Block(batch.slice(start, corpus_block))
                for i, (_, query_id, terms, weights) in enumerate(queries):
                    score, ids = (np.concatenate(x) for x in zip(best[i], block.best(query_id, terms, weights, k)))
                    order = np.lexsort((ids, -score))[:k]
                    best[i] = score[order], ids[order]
        sizes = np.array([len(x) for x, _ in best], dtype=np.int64)
        if sizes.sum():
            columns = [np.repeat(np.array([q[c] for q in queries], dtype=np.int64), sizes) for c in (0, 1)]
            columns += [np.concatenate([x[c] for x in best]) for c in (1, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query", "query_id", "vec_id", "score"])

    return run


def exact_topk(queries: DataFrame, corpus: DataFrame, k: int = 5, query_block: int = QUERY_BLOCK, corpus_block: int = CORPUS_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best corpus rows of each query row by integer inner product."""
    spark = queries.sparkSession
    fit = F.col("id").isNotNull() & F.col("terms").isNotNull() & F.col("weights").isNotNull()
    sparse = [F.col("id").cast("long").alias("id"), F.col("terms").cast("array<int>").alias("terms"), F.col("weights").cast("array<long>").alias("weights")]
    queries, corpus = queries.where(fit).select(sparse), corpus.where(fit).select(sparse)
    rows, first, parts = queries.toLocalIterator(), 0, []
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    while own := [(first + i, r["id"], np.array(r["terms"]), np.array(r["weights"])) for i, r in enumerate(islice(rows, query_block))]:
        first += len(own)
        asked = spark.sparkContext.broadcast(own)  # at most query_block rows
        found = corpus.mapInArrow(_search(asked, k, corpus_block), FOUND)
        found = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
        parts.append(materialize(found, "topk"))
        asked.unpersist()
    out = parts[0] if parts else spark.createDataFrame([], FOUND + ", rank int")
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("query_id", "rank", "vec_id", "score")
