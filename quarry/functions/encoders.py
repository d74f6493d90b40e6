"""Text encoders. None is a language model: `HashingEncoder` is lexical, `PrecomputedEncoder` looks vectors up."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.vectors import l2_normalize


class Encoder(Protocol):
    def encode(self, df: DataFrame, text_col: str, out_col: str = "embedding") -> DataFrame:
        """df with the unit vector of text_col in out_col."""


class HashingEncoder:
    """Signed feature hashing of words: the first eight hex digits of a word's md5 pick its place, the ninth its sign."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def vector(self, text: Column) -> Column:
        words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
        place = lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % self.dim
        sign = lambda w: F.when(F.substring(F.md5(w), 9, 1) < "8", 1.0).otherwise(-1.0)
        hashed = F.transform(words, lambda w: F.struct(place(w).alias("p"), sign(w).alias("s")))
        return F.aggregate(hashed, F.array_repeat(F.lit(0.0), self.dim), lambda v, h: F.transform(v, lambda x, i: x + F.when(h["p"] == i, h["s"]).otherwise(0.0)))

    def encode(self, df: DataFrame, text_col: str, out_col: str = "embedding") -> DataFrame:
        raw = df.withColumn(out_col, self.vector(F.col(text_col)))
        return raw.withColumn(out_col, l2_normalize(F.col(out_col)).cast("array<float>"))


class PrecomputedEncoder:
    """Vectors of a (text, embedding) table; a text it lacks has no vector."""

    def __init__(self, table: DataFrame, text_col: str = "text", vector_col: str = "embedding"):
        self.table = table.select(F.col(text_col).alias("_text"), F.col(vector_col).alias("_vector"))

    def encode(self, df: DataFrame, text_col: str, out_col: str = "embedding") -> DataFrame:
        joined = df.join(self.table, df[text_col] == F.col("_text"), "left")
        return joined.withColumn(out_col, l2_normalize(F.col("_vector")).cast("array<float>")).drop("_text", "_vector")
