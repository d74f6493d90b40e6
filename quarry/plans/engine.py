"""The search engine: correction, encoding, pool, filters, dedup and limit in one lazy plan."""

from __future__ import annotations

import json
import time
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.encoders import Encoder, HashingEncoder
from quarry.functions.lemma import Lemmatizer
from quarry.functions.spell import SpellCorrector, vocabulary
from quarry.functions.textnorm import clean_text
from quarry.operators import ann, dedup, filters, knn, present
from quarry.schema import SearchRequest, SearchResponse
from quarry.sources import artifacts, readers, sinks
from quarry.sources.storage import materialize


class Searcher(Protocol):
    def search(self, query: str, top_k: int = 5, wanted: dict[str, Any] | None = None) -> SearchResponse: ...


def ranked_results(products: DataFrame, hits: DataFrame, wanted: dict[str, Any] | None, top_k: int, columns: dict[str, str] | None = None, keep_rank: bool = False, **key_cols: str) -> DataFrame:
    """Products of the pool in rank order, filtered after the pool is drawn, one for each key, at most top_k (at least one)."""
    pool = products.join(F.broadcast(hits), "row_id")  # the pool is max(20 top_k, 50) rows
    passed = filters.apply_filters(pool, wanted, columns)
    best = dedup.first_k(dedup.keep_best(passed, dedup.dedup_key(passed, **key_cols)), top_k)
    return best if keep_rank else best.drop("_score", "_rank")


class Engine:
    """Search over products (row_id and their fields) and a vector index."""

    def __init__(self, spark: SparkSession, products: DataFrame, index, encoder: Encoder, vocab: DataFrame):
        self.spark, self.products, self.index, self.encoder = spark, products, index, encoder
        self.corrector = SpellCorrector(spark, vocab)

    @classmethod
    def build(cls, products: DataFrame, encoder: Encoder | None = None, index_kind: str = "hnsw", nlist: int | None = None, links: int = ann.GRAPH_LINKS, lemmatizer: Lemmatizer | None = None) -> Engine:
        """Titles are normalized and encoded here, once: a search reads what is stored."""
        encoder = encoder or HashingEncoder()
        texts = encoder.encode(present.embedding_text(products, "_text", lemmatizer=lemmatizer), "_text")
        vectors = materialize(texts.select("row_id", "embedding"), "engine-vectors")
        words = materialize(catalog_vocabulary(products, lemmatizer), "engine-vocabulary")
        return cls(products.sparkSession, products, ann.build_index(vectors, index_kind, nlist, links), encoder, words)

    @classmethod
    def load(cls, spark: SparkSession, root: str, encoder: Encoder | None = None) -> Engine:
        """The engine of an artifact folder, as it was built."""
        found = artifacts.load_artifacts(spark, root)
        encoder = encoder or HashingEncoder(found.vectors.select(F.size("embedding").alias("n")).first()["n"])
        kept = found.settings
        if kept["kind"] == "ivf":
            index = ann.IvfIndex(found.index, found.centroids, kept["probes"])
        elif kept["kind"] == "hnsw":
            index = ann.GraphIndex(found.vectors, kept["metric"], kept["links"], kept["build_width"], kept["search_width"])
        else:
            index = ann.FlatIndex(found.vectors, kept["metric"])
        return cls(spark, found.products, index, encoder, found.vocabulary)

    def encode_query(self, query: str) -> list[float]:
        row = self.encoder.encode(self.spark.createDataFrame([(query,)], "q string"), "q", "v").first()
        if row["v"] is None:
            raise ValueError(f"the encoder has no vector for {query!r}")
        return list(row["v"])

    def search(self, query: str, top_k: int = 5, wanted: dict[str, Any] | None = None) -> SearchResponse:
        corrected = self.corrector.correct_query(query)
        hits = self.index.search(self.encode_query(corrected or ""), knn.candidate_pool(top_k))
        results = ranked_results(self.products, hits, wanted, top_k)
        return SearchResponse(results, corrected, filters.echo_filters(wanted, self.corrector.correct_words))

    @staticmethod
    def health() -> dict[str, str]:
        return {"message": "search backend is running"}


def catalog_vocabulary(products: DataFrame, lemmatizer: Lemmatizer | None = None) -> DataFrame:
    """Tokens of cleaned titles and category names."""
    out = products
    have = [c for c in ("title", "category_name") if c in products.columns]
    for c in have:
        out = clean_text(out, c, f"_clean_{c}", lemmatizer)
    return vocabulary(out, [f"_clean_{c}" for c in have])


def handle(searcher: Searcher, body: dict[str, Any]) -> dict[str, Any]:
    """One search request to its response; results are rows as dictionaries, at most top_k of them."""
    request = SearchRequest.parse(body)
    found = searcher.search(request.query, request.top_k, request.filters)
    return {
        "query": request.query,
        "corrected_query": found.corrected_query,
        "corrected_filters": found.corrected_filters,
        "results": [r.asDict(recursive=True) for r in found.results.collect()],
    }


class DocumentRetriever:
    """Adapter with the similarity_search that retrieval frameworks call."""

    def __init__(self, searcher: Searcher, top_k: int = 5):
        self.searcher, self.top_k = searcher, top_k

    def similarity_search(self, query: str, k: int | None = None) -> list[dict[str, Any]]:
        found = self.searcher.search(query, k or self.top_k)
        return [r.asDict(recursive=True) for r in present.page_content(found.results).collect()]


def build_artifacts(spark: SparkSession, products: DataFrame | None, root: str, encoder: Encoder | None = None, index_kind: str = "hnsw", nlist: int | None = None, links: int = ann.GRAPH_LINKS, rebuild_index_only: bool = False) -> float:
    """Write products, vectors and index below root, old ones backed up; returns the seconds it took.

    rebuild_index_only keeps products and vectors and makes the index from them.
    """
    began = time.time()
    if index_kind not in ann.BUILDERS:
        raise ValueError(f"unknown index kind {index_kind!r}: one of {', '.join(ann.BUILDERS)}")
    staged: dict[str, DataFrame] = {}
    if rebuild_index_only:
        for name in (sinks.VECTORS, sinks.PRODUCTS):
            if not sinks.path_exists(spark, f"{root}/{name}"):
                raise FileNotFoundError(f"an index is rebuilt from {name}, which the folder lacks: {root}")
        vectors = spark.read.parquet(f"{root}/{sinks.VECTORS}")
        if not sinks.path_exists(spark, f"{root}/{sinks.VOCABULARY}"):
            staged[sinks.VOCABULARY] = catalog_vocabulary(spark.read.parquet(f"{root}/{sinks.PRODUCTS}"))
    else:
        if products is None:
            raise ValueError("products are needed unless only the index is rebuilt")
        texts = present.embedding_text(products, "_text")
        vectors = materialize((encoder or HashingEncoder()).encode(texts, "_text").select("row_id", "embedding"), "build-vectors")
        staged = {sinks.PRODUCTS: products, sinks.VECTORS: vectors, sinks.VOCABULARY: catalog_vocabulary(products)}
    index = ann.build_index(vectors, index_kind, nlist, links)
    staged[sinks.INDEX] = index.cells if isinstance(index, ann.IvfIndex) else vectors.select("row_id")
    staged[sinks.SETTINGS] = spark.createDataFrame([(json.dumps(index.settings()),)], "value string")
    if isinstance(index, ann.IvfIndex):
        staged[sinks.CENTROIDS] = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(index.centroids)], "cell int, centroid array<double>")
    sinks.swap_in(spark, root, staged)
    return time.time() - began


def legacy_l2_index(spark: SparkSession, vectors_path: str, path: str) -> int:
    """Store raw vectors for exact L2 search; returns how many there are. `ann.FlatIndex(vectors, "l2")` searches them."""
    sinks.write_parquet(readers.load_vectors(spark, vectors_path), path)
    return spark.read.parquet(path).count()


def legacy_embeddings(products: DataFrame, path: str, encoder: Encoder | None = None) -> bool:
    """Vectors of title and brand as one JSON object; False and no output without products."""
    if products.isEmpty():
        return False
    texts = products.withColumn("_text", present.legacy_text(F.col("title"), F.col("brand")))
    sinks.write_embedding_json((encoder or HashingEncoder()).encode(texts, "_text").select("id", "embedding"), path)
    return True
