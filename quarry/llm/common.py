"""Helpers the corpus operators share: table access, shared storage, input clean-up."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.storage import discard, materialize, scratch_path, shuffle_partitions

__all__ = ["WHITE", "UPPER", "table", "materialize", "discard", "scratch_path", "shuffle_partitions", "texts", "packed", "unpacked", "text_hash", "ascii_lower", "crc_mod", "filter_rows"]

#: ASCII white space, the set [\x20\x09-\x0D] that separates words and is stripped from lines.
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch of texts, where the session sets none: texts may be very long, so rows alone bound nothing.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def _bound_batches(spark: SparkSession) -> None:
    """Batches are bounded where a plan runs, which may be long after this returns: the session keeps the setting."""
    if spark.conf.get(BATCH_BYTES[0], None) is None:
        spark.conf.set(*BATCH_BYTES)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string): other columns, whatever their names, are not read; a null text is empty."""
    _bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def packed(docs: DataFrame, *own: Column) -> DataFrame:
    """(doc, own...): the columns of docs in one struct, so that names of our own beside it clash with none of them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *own)


def unpacked(rows: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns as they were before `packed`, those in `new` replaced."""
    return rows.select(*[new[c].alias(c) if c in new else F.col("doc").getField(c).alias(c) for c in columns])


def text_hash() -> Column:
    """Tells rows of one doc_id apart by their text."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def crc_mod(id_col: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; -1 for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string")) % modulus, F.lit(-1)).cast("int")


def filter_rows(docs: DataFrame, make: Callable[[], Callable[[str], bool]], text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, for whose text (null: empty) the test that `make` builds in each task holds.

    The decision is local to a row, so no row is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                yield part.filter(pa.array([keep(t or "") for t in part.column(at).to_pylist()], pa.bool_()))

    _bound_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # any name may be a user's, dots included
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
