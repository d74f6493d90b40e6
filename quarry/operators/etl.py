"""Catalog preparation: categories joined to products, a whitelist, counts."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

#: The category names that are kept, compared exactly.
FASHION_CATEGORIES = (
    "Baby Boys' Clothing & Shoes",
    "Baby Girls' Clothing & Shoes",
    "Boys' Clothing",
    "Girls' Clothing",
    "Men's Clothing",
    "Women's Clothing",
    "Boys' School Uniforms",
    "Girls' School Uniforms",
    "Men's Shoes",
    "Women's Shoes",
    "Boys' Shoes",
    "Girls' Shoes",
    "Men's Accessories",
    "Women's Accessories",
    "Boys' Accessories",
    "Girls' Accessories",
    "Women's Handbags",
    "Travel Duffel Bags",
    "Messenger Bags",
    "Travel Tote Bags",
    "Garment Bags",
    "Luggage Sets",
    "Suitcases",
    "Travel Accessories",
    "Backpacks",
    "Luggage",
    "Laptop Bags",
    "Men's Watches",
    "Women's Watches",
    "Boys' Watches",
    "Girls' Watches",
    "Men's Jewelry",
    "Women's Jewelry",
    "Boys' Jewelry",
    "Girls' Jewelry",
)


def left_join_categories(products: DataFrame, categories: DataFrame, key: str = "category_id", id_col: str = "id") -> DataFrame:
    """Every product with the columns of its category; null keys match null keys, clashing names get _x and _y.

    The join strategy is left to the planner, which broadcasts the categories only if they are small.
    """
    clash = set(products.columns) & set(categories.columns)
    left = products.select([F.col(c).alias(f"{c}_x" if c in clash else c) for c in products.columns])
    right = categories.select([F.col(c).alias(f"{c}_y" if c in clash else c) for c in categories.columns])
    a, b = (f"{key}_x" if key in clash else key), (f"{id_col}_y" if id_col in clash else id_col)
    return left.join(right, left[a].eqNullSafe(right[b]), "left")


def keep_categories(df: DataFrame, names: Collection[str] = FASHION_CATEGORIES, col: str = "category_name") -> DataFrame:
    return df.where(F.col(col).isin(*names))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows for each value, most frequent first, nulls left out."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("count")).orderBy(F.desc("count"), col)


def prepare_catalog(products: DataFrame, categories: DataFrame, names: Collection[str] = FASHION_CATEGORIES) -> tuple[DataFrame, dict[str, Observation]]:
    """The whitelisted catalog as a lazy plan, and observations whose `get` tells row counts once an action ran.

    Observing fixes each count's place in the plan, so the whitelist is not pushed below `merged`; use `keep_categories`
    over `left_join_categories` where the counts are not wanted.
    """
    seen = {name: Observation(name) for name in ("products", "merged", "kept")}
    count = F.count(F.lit(1)).alias("rows")
    merged = left_join_categories(products.observe(seen["products"], count), categories).observe(seen["merged"], count)
    return keep_categories(merged, names).observe(seen["kept"], count), seen
