"""Vector indexes: exact (flat), inverted file (ivf), and the graph kind, which is answered exactly."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.vectors import dot
from quarry.operators import knn
from quarry.sources.storage import materialize

TRAIN_ROWS, LEAST_CELLS, GRAPH_LINKS, SEARCH_WIDTH = 10_000, 64, 32, 128


@dataclass
class FlatIndex:
    vectors: DataFrame
    metric: str = "ip"

    def search(self, query: Sequence[float], n: int) -> DataFrame:
        return knn.search(self.vectors, query, n, self.metric)

    def settings(self) -> dict[str, Any]:
        """What a stored index must remember of itself."""
        return {"kind": "flat", "metric": self.metric}


@dataclass
class GraphIndex(FlatIndex):
    """Takes the knobs of a graph index and answers exactly, which no setting of them can surpass."""

    links: int = GRAPH_LINKS
    build_width: int = max(200, 2 * GRAPH_LINKS)
    search_width: int = SEARCH_WIDTH

    def settings(self) -> dict[str, Any]:
        return {"kind": "hnsw", "metric": self.metric, "links": self.links, "build_width": self.build_width, "search_width": self.search_width}


@dataclass
class IvfIndex:
    """Vectors by cell; a search reads the cells whose centroids score best."""

    cells: DataFrame
    centroids: np.ndarray
    probes: int = 1

    def _nearest_cells(self, query: Sequence[float]) -> list[int]:
        return np.argsort(-(self.centroids @ np.asarray(query, dtype=np.float64)), kind="stable")[: self.probes].tolist()

    def search(self, query: Sequence[float], n: int) -> DataFrame:
        return knn.search(self.cells.where(F.col("cell").isin(self._nearest_cells(query))), query, n)

    def search_batch(self, queries: list[tuple[int, Sequence[float]]], n: int) -> DataFrame:
        """(query_id, row_id, _score, _rank): each query meets the rows of its own cells only; at most BATCH_QUERIES queries."""
        if len(queries) > knn.BATCH_QUERIES:
            raise ValueError(f"a batch holds at most {knn.BATCH_QUERIES} queries")
        asked = [(int(q), cell, [float(x) for x in v]) for q, v in queries for cell in self._nearest_cells(v)]
        probes = self.cells.sparkSession.createDataFrame(asked, "query_id long, cell int, query_vector array<double>")
        scored = self.cells.join(F.broadcast(probes), "cell").select("query_id", "row_id", dot(F.col("embedding"), F.col("query_vector")).alias("_score"))
        ranks = Window.partitionBy("query_id").orderBy(F.desc("_score"), "row_id")
        return scored.withColumn("_rank", F.row_number().over(ranks)).where(F.col("_rank") <= n)

    def search_many(self, queries: DataFrame, n: int) -> DataFrame:
        """search_batch for any number of queries (query_id, query_vector): blocks of them travel with the tasks, which score the
        rows of a cell for the queries that read it and keep n rows a query."""
        rows = self.cells.select("cell", F.col("row_id").cast("long"), F.col("embedding").cast("array<double>"))
        found = [rows.mapInArrow(_best_of_cells([(q, self._nearest_cells(v), v) for q, v in asked], n), knn.SCORED) for asked in knn.query_blocks(queries)]
        return knn.best_of_blocks(self.cells.sparkSession, found, n)

    def settings(self) -> dict[str, Any]:
        return {"kind": "ivf", "metric": "ip", "nlist": len(self.centroids), "probes": self.probes}


def _best_of_cells(queries: list[tuple], n: int):
    """For the Arrow batches (cell, id, vector) of a task the n best rows of every (id, cells, vector) among the cells it reads."""
    ids = [q for q, _, _ in queries]
    wanted = [np.asarray(v, dtype=np.float64) for _, _, v in queries]
    readers: dict[int, list[int]] = {}
    for k, (_, cells, _) in enumerate(queries):
        for cell in cells:
            readers.setdefault(cell, []).append(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.empty(0), np.empty(0, dtype=np.int64))] * len(ids)
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = np.asarray(batch.column(0))
            order = np.argsort(cell, kind="stable")
            own = np.asarray(batch.column(1))[order]
            x = np.asarray(batch.column(2).flatten(), dtype=np.float64).reshape(batch.num_rows, -1)[order]
            present, starts = np.unique(cell[order], return_index=True)
            for c, lo, hi in zip(present.tolist(), starts, [*starts[1:], len(own)]):
                for k in readers.get(c, ()):
                    score = (x[lo:hi] * wanted[k]).sum(axis=1)  # one order of sums for every row, as in the exact search
                    kept, rows = best[k]
                    at = np.flatnonzero(score >= kept[-1]) if len(kept) == n else np.arange(hi - lo)
                    if len(at):
                        score, rows = np.concatenate([kept, score[at]]), np.concatenate([rows, own[lo:hi][at]])
                        top = np.lexsort((rows, -score))[:n]
                        best[k] = score[top], rows[top]
        scores, rows = (np.concatenate(c) for c in zip(*best))
        asked = np.repeat(np.array(ids, dtype=np.int64), [len(s) for s, _ in best])
        yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(rows), pa.array(scores)], ["query_id", "row_id", "_score"])

    return run


def cell_count(n: int, nlist: int | None = None) -> int:
    return int(nlist or max(LEAST_CELLS, int(n**0.5)))


def train_centroids(vectors: DataFrame, nlist: int, seed: int = 1) -> np.ndarray:
    """KMeans over the first TRAIN_ROWS rows by row_id."""
    first = vectors.where(F.col("row_id") < TRAIN_ROWS).select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=nlist, seed=seed, maxIter=20).fit(first.repartition(1))  # bounded; one partition fixes the initial draw
    centres = np.array(model.clusterCenters())
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)  # cells are picked by inner product


def assign_cells(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vectors (row_id, embedding) with `cell`, the centroid of greatest inner product, least number among equals.

    One matrix product an Arrow batch; the centroids, at most some square root of the rows, travel with the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(1)
            x = np.asarray(flat.flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
            cells = np.argmax(x @ centroids.T, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), flat, pa.array(cells, pa.int32())], ["row_id", "embedding", "cell"])

    return vectors.select(F.col("row_id").cast("long"), F.col("embedding").cast("array<float>")).mapInArrow(run, "row_id long, embedding array<float>, cell int")


def build_ivf(vectors: DataFrame, nlist: int | None = None, probes: int = 1) -> IvfIndex:
    centroids = train_centroids(vectors, cell_count(vectors.count(), nlist))
    return IvfIndex(materialize(assign_cells(vectors, centroids), "ivf-cells"), centroids, probes)


def _graph(vectors: DataFrame, nlist: int | None, links: int) -> GraphIndex:
    return GraphIndex(vectors, "l2", links, max(200, 2 * links))


BUILDERS: dict[str, Callable] = {
    "flat": lambda vectors, nlist, links: FlatIndex(vectors),
    "hnsw": _graph,
    "ivf": lambda vectors, nlist, links: build_ivf(vectors, nlist),
}


def build_index(vectors: DataFrame, kind: str = "hnsw", nlist: int | None = None, links: int = GRAPH_LINKS):
    if kind not in BUILDERS:
        raise ValueError(f"unknown index kind {kind!r}: one of {', '.join(BUILDERS)}")
    return BUILDERS[kind](vectors, nlist, links)
