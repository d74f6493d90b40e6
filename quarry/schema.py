"""Declared schemas and the value objects of a search."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

PRODUCT = T.StructType(
    [T.StructField(name, kind()) for name, kind in (
        ("asin", T.StringType), ("id", T.StringType), ("title", T.StringType), ("Title", T.StringType), ("name", T.StringType),
        ("brand", T.StringType), ("category", T.StringType), ("category_id", T.LongType), ("category_name", T.StringType),
        ("price", T.DoubleType), ("stars", T.DoubleType), ("isBestSeller", T.BooleanType), ("imgUrl", T.StringType), ("url", T.StringType),
    )]
)
#: Spark resolves names without case, so the Title alias is read only where a source has no title.
CATALOG = T.StructType([f for f in PRODUCT if f.name != "Title"])
CATEGORY = T.StructType([T.StructField("id", T.LongType()), T.StructField("category_name", T.StringType())])
RAW_PRODUCT = T.StructType([CATALOG[n] for n in ("asin", "title", "imgUrl", "url", "stars", "price", "category_id", "isBestSeller")])
VECTOR = T.StructType([T.StructField("row_id", T.LongType(), False), T.StructField("embedding", T.ArrayType(T.FloatType(), False))])

FILTER_KEYS = ("brand", "category", "category_name", "price_min", "price_max", "stars_min", "stars_max", "isBestSeller")


@dataclass(frozen=True)
class SearchRequest:
    query: str
    top_k: int = 5
    filters: dict[str, Any] | None = None

    @classmethod
    def parse(cls, body: dict[str, Any]) -> SearchRequest:
        """Validate a request body. Unknown filter keys are dropped; a given filter object carries every known key."""
        if not isinstance(body.get("query"), str):
            raise ValueError("query is required and must be a string")
        top_k = body.get("top_k", 5)
        if isinstance(top_k, bool) or not isinstance(top_k, int):
            raise ValueError("top_k must be an integer")
        given = body.get("filters")
        if given is not None and not isinstance(given, dict):
            raise ValueError("filters must be an object")
        return cls(body["query"], top_k, None if given is None else {k: given.get(k) for k in FILTER_KEYS})


@dataclass
class SearchResponse:
    results: DataFrame
    corrected_query: str
    corrected_filters: dict[str, Any] = field(default_factory=dict)
