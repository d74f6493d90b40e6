"""Embedding texts and the presentation of results."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.lemma import Lemmatizer
from quarry.functions.textnorm import clean_text

RUPEES = 85


def first_filled(df: DataFrame, *names: str) -> Column:
    """The first column that is there, not null and not empty; NaN read as text is absent."""
    have = {c.lower(): c for c in df.columns}
    found = [F.nullif(F.nullif(F.col(f"`{have[n.lower()]}`").cast("string"), F.lit("")), F.lit("NaN")) for n in dict.fromkeys(x.lower() for x in names) if n in have]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def embedding_text(df: DataFrame, target: str = "text", categories: DataFrame | None = None, lemmatizer: Lemmatizer | None = None) -> DataFrame:
    """df with cleaned title and category joined by " | ", empty parts left out.

    categories: (category_id, category_name) for products that carry only a category_id; unique by id.
    """
    title, category = first_filled(df, "title", "Title", "name"), first_filled(df, "category_name", "category")
    out = df.withColumn("_title", title).withColumn("_category", category)
    if categories is not None and "category_id" in df.columns:
        names = categories.select(F.col("category_id").cast("string").alias("_cid"), F.col("category_name").alias("_cname"))
        out = out.join(names, F.nullif(F.col("category_id").cast("string"), F.lit("0")) == F.col("_cid"), "left")
        out = out.withColumn("_category", F.coalesce("_category", F.nullif("_cname", F.lit("")))).drop("_cid", "_cname")
    out = clean_text(clean_text(out, "_title", "_title", lemmatizer), "_category", "_category", lemmatizer)
    joined = F.concat_ws(" | ", F.nullif("_title", F.lit("")), F.nullif("_category", F.lit("")))
    return out.withColumn(target, joined).drop("_title", "_category")


def legacy_text(title: Column, brand: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(brand, F.lit("")))


def page_content(df: DataFrame, title: str = "title") -> DataFrame:
    """(page_content, metadata) of each row."""
    return df.select(F.coalesce(F.col(title), F.lit("")).alias("page_content"), F.struct(*df.columns).alias("metadata"))


def price_inr(price: Column) -> Column:
    """Price in rupees to two places, "N/A" without a number."""
    return F.coalesce(F.round(price * RUPEES, 2).cast("string"), F.lit("N/A"))


def card(df: DataFrame) -> DataFrame:
    """What a result card shows, defaults filled in."""
    price = F.coalesce("price", F.lit(0.0))
    return df.select(
        F.coalesce("title", F.lit("Unknown Product")).alias("title"),
        F.coalesce("category_name", F.lit("N/A")).alias("category"),
        price.alias("price_usd"),
        price_inr(price).alias("price_inr"),
        *[c for c in ("imgUrl", "url") if c in df.columns],
    )


def filter_summary(filters: dict[str, Any]) -> str:
    """The filters in words, joined by bars."""
    parts = []
    if filters.get("category_name"):
        parts.append(f"Category → {filters['category_name']}")
    for name, low, high in (("Price", "price_min", "price_max"), ("Stars", "stars_min", "stars_max")):
        if filters.get(low) or filters.get(high):
            parts.append(f"{name} → {filters.get(low, '')} to {filters.get(high, '')}".strip())
    if "isBestSeller" in filters:
        parts.append("Best Seller only")
    return " | ".join(parts)
