"""Ordered deduplication of ranked results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY_LENGTH = 64


def json_title_prefix(title: Column) -> Column:
    """The first 64 characters of the title as a JSON string literal with non-ASCII escaped."""
    escaped = F.coalesce(title, F.lit(""))
    for plain, code in (("\\", "\\\\"), ('"', '\\"'), ("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(plain), F.lit(code))

    def escape(ch: Column) -> Column:
        code = F.ascii(ch)
        unit = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))
        pair = F.concat(unit(F.lit(0xD800) + F.floor((code - 0x10000) / 0x400)), unit(F.lit(0xDC00) + (code - 0x10000) % 0x400))
        return F.when((code >= 32) & (code < 127), ch).when(code < 0x10000, unit(code)).otherwise(pair)

    text = F.when(escaped.rlike(r"[^ -~]"), F.array_join(F.transform(F.split(escaped, ""), escape), "")).otherwise(escaped)
    return F.substring(F.concat(F.lit('"'), text, F.lit('"')), 1, KEY_LENGTH)


def dedup_key(df: DataFrame, asin: str = "asin", id_col: str = "id", url: str = "url", title: str = "title") -> Column:
    """The first of asin, id, url that is not empty (nor 0), else the title's prefix; numbers and texts never meet."""
    kinds = dict(df.dtypes)

    def of(name: str) -> Column | None:
        if name not in kinds:
            return None
        number = kinds[name] not in ("string", "boolean")
        falsy = (F.col(name) == 0) if number else (F.col(name).cast("string") == "")
        return F.when(~falsy, F.concat(F.lit("n:" if number else "s:"), F.col(name).cast("string")))

    fields = [c for c in map(of, (asin, id_col, url)) if c is not None]
    return F.coalesce(*fields, F.concat(F.lit("s:"), json_title_prefix(F.col(title) if title in kinds else F.lit(None).cast("string"))))


def keep_best(df: DataFrame, key: Column, rank_col: str = "_rank") -> DataFrame:
    """The best-ranked row of each key."""
    ranked = df.withColumn("_key", key).withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(rank_col)))
    return ranked.where("_n = 1").drop("_n", "_key")


def first_k(df: DataFrame, k: int, rank_col: str = "_rank") -> DataFrame:
    """The k best rows, at least one."""
    return df.orderBy(rank_col).limit(max(k, 1))
