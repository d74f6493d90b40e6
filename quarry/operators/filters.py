"""Attribute filters of a search, as one predicate."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def category_matches(column: Column, wanted: Any) -> Column | None:
    """Case-insensitive substring; any of a list; an empty list rejects all; other kinds pass."""
    held = F.lower(F.coalesce(column, F.lit("")))
    if isinstance(wanted, str):
        return held.contains(wanted.lower())
    if isinstance(wanted, list):
        return reduce(lambda a, b: a | b, [held.contains(w.lower()) for w in wanted], F.lit(False))
    return None


def at_least(column: Column, low: Any) -> Column:
    """Not below low; a null counts as 0, NaN passes."""
    return ~(F.coalesce(column, F.lit(0.0)) < float(low))


def at_most(column: Column, high: Any) -> Column:
    """Not above high; a null counts as 0, NaN passes although it sorts above all numbers."""
    value = F.coalesce(column, F.lit(0.0))
    return ~((value > float(high)) & ~F.isnan(value))


def is_flag(column: Column, wanted: Any) -> Column:
    return F.coalesce(column, F.lit(False)) == bool(wanted)


_BY_KEY: dict[str, tuple[str, Callable[[Column, Any], Column | None]]] = {
    "category_name": ("category_name", category_matches),
    "price_min": ("price", at_least),
    "price_max": ("price", at_most),
    "stars_min": ("stars", at_least),
    "stars_max": ("stars", at_most),
    "isBestSeller": ("isBestSeller", is_flag),
}


def predicate(filters: dict[str, Any] | None, columns: dict[str, str] | None = None) -> Column | None:
    """The conjunction of all filters, None if nothing is asked for; unknown keys and None values are skipped.

    columns: the column that stands for a field, where its name differs.
    """
    parts = []
    for key, wanted in (filters or {}).items():
        if wanted is None or key not in _BY_KEY:
            continue
        name, make = _BY_KEY[key]
        if (part := make(F.col((columns or {}).get(name, name)), wanted)) is not None:
            parts.append(part)
    return reduce(lambda a, b: a & b, parts) if parts else None


def apply_filters(df: DataFrame, filters: dict[str, Any] | None, columns: dict[str, str] | None = None) -> DataFrame:
    wanted = predicate(filters, columns)
    return df if wanted is None else df.where(wanted)


def echo_filters(filters: dict[str, Any] | None, correct: Callable[[list[str]], list[str]]) -> dict[str, Any]:
    """The filters as given, with a list of corrected categories in place of any given; {} for none."""
    if not filters:
        return {}
    out = dict(filters)
    if category := filters.get("category_name"):
        out["category_name"] = correct([c.lower() for c in ([category] if isinstance(category, str) else list(category))])
    return out


def parse_multi(text: str) -> str | list[str] | None:
    """A comma list: None if nothing is in it, a string for one part, else a list."""
    parts = [p.strip() for p in text.split(",") if p.strip()]
    return None if not parts else parts[0] if len(parts) == 1 else parts


def form_filters(category: str = "", price_min: float = 0, price_max: float = 0, stars_min: float = 0, stars_max: float = 0, best_only: bool = False) -> dict[str, Any]:
    """Filters of a search form, where 0 and unchecked mean not set."""
    numbers = {"price_min": price_min, "price_max": price_max, "stars_min": stars_min, "stars_max": stars_max}
    return {"category_name": parse_multi(category)} | {k: v if v > 0 else None for k, v in numbers.items()} | {"isBestSeller": True if best_only else None}
