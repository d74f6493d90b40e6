"""Line deduplication with per-document keep bitmaps.

Hashes of normalized lines are range-partitioned together with their document, positions sorted behind them; each
partition streams (line, document) groups, so a line in a third of all documents spreads over many partitions and only
one partial count of it leaves each. Frequent lines then mark all their places but those in their largest document, and
the marks return to the documents as one compressed bitmap each, 64 positions a word and words without marks left out,
which is opened beside its text only; texts are joined with bitmaps only. Marks
of hot lines, of which there can only be a few, come by broadcast, so no task gathers the places of one line.
Only DataFrame functions run.

Defined cases: a null or empty text is one empty line; lines of under `min_chars` code points are kept;
rows that share a doc_id count as one document, each keeping its own bitmap; a null doc_id is one document that sorts first;
a document that loses all its lines has an empty text; other columns, whatever their names, pass through `dedup_lines`
unchanged; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import WHITE, ascii_lower, materialize, packed, shuffle_partitions, text_hash, unpacked

MIN_CHARS, MIN_DOCS = 20, 3
#: A line is hot if it makes up the share 1 / (HOT_SHARE x shuffle partitions) of all (line, document) groups.
HOT_SHARE = 4


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))


def drop_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, row, dropped array<struct<word, mask>>): bit p % 64 of word p / 64 is set when line p goes; words without such bits
    are left out, and so are rows that lose nothing."""
    spark = docs.sparkSession
    bare = F.btrim(F.col("line"), F.lit(WHITE))
    places = docs.select(_id().alias("doc"), text_hash().alias("row"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    places = places.select("doc", "row", "pos", bare.alias("bare")).where(F.char_length("bare") >= min_chars)
    key = ascii_lower(F.col("bare"))
    places = places.select(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"), "doc", F.struct("row", "pos").alias("place"))
    ranged = places.repartitionByRange(shuffle_partitions(spark), "h1", "h2", "doc").sortWithinPartitions("h1", "h2", "doc", "place")
    groups = materialize(ranged.groupBy("h1", "h2", "doc").agg(F.collect_list("place").alias("places")), "line-groups")
    often = groups.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("keeper")).where(F.col("n_docs") >= min_docs)
    often = materialize(often, "frequent-lines")
    hot_from = max(min_docs, groups.count() // (HOT_SHARE * shuffle_partitions(spark)))
    hot = often.where(F.col("n_docs") >= hot_from)  # at most HOT_SHARE x partitions lines can be in so many documents
    cold = often.where(F.col("n_docs") < hot_from)
    met = groups.join(F.broadcast(hot.select("h1", "h2", F.col("keeper").alias("hot_keeper"))), ["h1", "h2"], "left")
    columns = ["doc", "places", "keeper"]
    gone = met.where(F.col("hot_keeper").isNotNull()).withColumnRenamed("hot_keeper", "keeper").select(columns)
    gone = gone.unionByName(met.where(F.col("hot_keeper").isNull()).join(cold, ["h1", "h2"]).select(columns))
    marks = gone.where(F.col("doc") != F.col("keeper")).select("doc", F.explode("places").alias("p")).select("doc", "p.row", "p.pos")
    words = marks.groupBy("doc", "row", F.expr("pos div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("mask"))
    return words.groupBy(F.col("doc").alias("id"), "row").agg(F.array_sort(F.collect_list(F.struct("word", "mask"))).alias("dropped"))


def _dense(dropped: Column) -> Column:
    """The words of a bitmap up to the last with a mark, gaps filled."""

    def fill(entry: Column, i: Column) -> Column:
        before = F.coalesce(F.get(dropped, i - 1)["word"], F.lit(-1))
        return F.concat(F.array_repeat(F.lit(0).cast("long"), entry["word"] - before - 1), F.array(entry["mask"]))

    return F.flatten(F.transform(dropped, fill))


def mark_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, lines, kept): the columns of docs as one struct, all lines of the text and those that stay."""
    rows = packed(docs, _id().alias("id"), text_hash().alias("row"))
    joined = rows.join(drop_bitmaps(docs, min_chars, min_docs).hint("shuffle_hash"), ["id", "row"], "left")
    marked = joined.select("doc", _lines(F.col("doc.text")).alias("lines"), _dense(F.col("dropped")).alias("dropped"))

    def stays(_: Column, i: Column) -> Column:
        mask = F.coalesce(F.get("dropped", F.floor(i / 64).cast("int")), F.lit(0).cast("long"))
        return F.getbit(mask, i % 64) == 0

    return marked.select("doc", "lines", F.when(F.col("dropped").isNull(), F.col("lines")).otherwise(F.filter("lines", stays)).alias("kept"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the same columns, dropped lines gone from `text`."""
    return unpacked(mark_lines(docs, min_chars, min_docs), docs.columns, text=F.array_join("kept", "\n"))
