"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint maps to the bit counts of its 32 two-bit segments. Fingerprints that differ in d bits have bit
counts at Manhattan distance <= d, so that distance is a lower bound. The segments form six blocks; a pair within
three bits agrees in the bit counts of at least three blocks, so every choice of three blocks is a grid whose cells
(exact bit counts of the chosen blocks) hold all linked pairs together. Inside a cell the remaining segments are
range-compared by Manhattan distance and survivors are verified by exact Hamming distance.

Copies share a fingerprint and are one row. Two rounds first link every row of a cell to one hub; only cells that still
hold more than one component compare rows, and only across components, so no link between components is lost. A cell of
more than REFINE rows is cut by the bits of its three blocks, not their counts alone: of six blocks three bits spoil at most
three, so a linked pair agrees in all bits of some choice of three, and that choice still holds it. This takes 32 bits
where counts hold some 24, and the pairs of random fingerprints fall by the same factor.

Defined cases: a null or empty text, or one of white space only, has fingerprint zero and links like any other; fewer
words than a shingle give one shingle of them all; a null doc_id keeps its row and never names a component unless
alone; repeated rows share a component; `keep_one` tells rows apart by doc_id and text, puts null ids last, keeps one of
several rows equal in both and passes other columns, whatever their names, unchanged; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize, packed, shuffle_partitions, text_hash, texts, unpacked
from quarry.llm.components import components

SHINGLE, MAX_BITS, SEED = 3, 3, 42
#: Shingle hashes whose bits are counted at once; bounds memory for long texts.
CHUNK = 1 << 15
#: Segments of each block of the grid.
BLOCK_SEGMENTS = (6, 6, 5, 5, 5, 5)
LOW = 0x5555555555555555
#: Rows of a cell from which it is cut by bits.
REFINE = 256


def fingerprint(text: str, shingle: int = SHINGLE, digest=xxhash.xxh64_intdigest) -> int:
    """The unsigned fingerprint: bit b is 1 if set in over half of the shingle hashes, repeats counted."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist())
    ones, hashes = np.zeros(64, dtype=np.int64), []
    for a, b in spans:
        hashes.append(digest(joined[a:b], SEED))
        if len(hashes) == CHUNK:
            ones += _bit_counts(hashes)
            hashes = []
    if hashes:
        ones += _bit_counts(hashes)
    return int(np.packbits((2 * ones > n).astype(np.uint8)).view(">u8")[0])


def _bit_counts(hashes: list[int]) -> np.ndarray:
    rows = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, row, fp long): the text's hash and its fingerprint's bits as a signed long, one row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                prints = np.array([fingerprint(t, shingle) for t in part.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(prints)], ["doc_id", "row", "fp"])

    return texts(docs).withColumn("row", text_hash()).mapInArrow(run, "doc_id long, row long, fp long")


def segment_counts(fp: Column) -> Column:
    """The bit counts (0 to 2) of the 32 segments, two bits each, in one long."""
    high = F.shiftrightunsigned(fp, 1)
    return F.shiftleft(fp.bitwiseAND(high).bitwiseAND(LOW), 1).bitwiseOR(fp.bitwiseXOR(high).bitwiseAND(LOW))


def manhattan(p: Column, q: Column) -> Column:
    """Manhattan distance of two segment-count vectors: fields differ by 2 where their xor is 10, by 1 where it is 01 or 11."""
    z = p.bitwiseXOR(q)
    low, high = z.bitwiseAND(LOW), F.shiftrightunsigned(z, 1).bitwiseAND(LOW)
    return F.bit_count(low) + 2 * F.bit_count(high.bitwiseAND(F.bitwise_not(low)))


def grid_masks() -> list[int]:
    """For each choice of three of the six blocks the mask of their segments, as signed longs."""
    masks, at = [], 0
    for n in BLOCK_SEGMENTS:
        masks.append(((1 << (2 * n)) - 1) << at)
        at += 2 * n
    return [x - (1 << 64) if (x := a | b | c) >> 63 else x for a, b, c in combinations(masks, 3)]


def _near(a: str, b: str, bits: int) -> Column:
    lower_bound = manhattan(F.col(f"pc_{a}"), F.col(f"pc_{b}")) <= bits
    return lower_bound & (F.bit_count(F.col(f"fp_{a}").bitwiseXOR(F.col(f"fp_{b}"))) <= bits)


def _cells(points: DataFrame) -> DataFrame:
    grid = F.array(*[F.struct(F.lit(i).alias("g"), F.col("pc").bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(grid_masks())])
    dealt = points.repartition(shuffle_partitions(points.sparkSession), "fp")  # the table is small, what it explodes to is not
    return dealt.withColumn("at", F.explode(grid)).select("fp", "comp", F.col("at.g").alias("g"), F.col("at.cell").alias("cell"))


def _with_components(points: DataFrame, edges: DataFrame | None) -> DataFrame:
    if edges is None:
        return points.withColumn("comp", F.col("fp"))
    found = components(edges)
    joined = points.join(found, points["fp"] == found["node"], "left")
    return joined.select("fp", F.coalesce("root", "fp").alias("comp"))


def link_components(prints: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(fp, comp): comp is shared exactly by the fingerprints that chains of links within `bits` connect."""
    if bits > 3:
        raise ValueError("the grid covers up to three differing bits")
    points = materialize(prints.select("fp").distinct(), "prints")
    edges, known = None, points.withColumn("comp", F.col("fp"))
    for k in range(2):
        found = _hub_edges(known, k, bits)
        edges = materialize(found if edges is None else edges.unionByName(found), "hub-edges")
        known = materialize(_with_components(points, edges), "hub-components")
    last = materialize(_cross_edges(known, bits), "cross-edges")
    return _with_components(points, edges.unionByName(last))


def _refined() -> Column:
    """What a cell of many rows is cut by: the bits of its blocks."""
    masks = F.array(*[F.lit(m) for m in grid_masks()])
    return F.when(F.col("n") > REFINE, F.col("fp").bitwiseAND(F.get(masks, F.col("g")))).otherwise(F.lit(0).cast("long"))


def _open_cells(known: DataFrame, pick: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Rows in cells and, for cells of more than one component, what `pick` aggregates."""
    cells = _cells(known.withColumn("pc", segment_counts(F.col("fp"))))
    mixed = cells.groupBy("g", "cell").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"), *pick).where(F.col("lo") != F.col("hi"))
    return cells, mixed


def _hub_edges(known: DataFrame, k: int, bits: int) -> DataFrame:
    """Links from the rows of each cell to the cell's hub, the row of lowest seeded hash."""
    cells, mixed = _open_cells(known, [F.min_by(F.struct("fp", "comp"), F.xxhash64(F.lit(k), "fp")).alias("hub")])
    pairs = cells.join(mixed.select("g", "cell", F.col("hub.fp").alias("fp_b"), F.col("hub.comp").alias("comp_b")), ["g", "cell"])
    pairs = pairs.where(F.col("comp") != F.col("comp_b")).withColumnRenamed("fp", "fp_a")
    pairs = pairs.withColumn("pc_a", segment_counts(F.col("fp_a"))).withColumn("pc_b", segment_counts(F.col("fp_b")))
    return pairs.where(_near("a", "b", bits)).select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")).distinct()


def _cross_edges(known: DataFrame, bits: int) -> DataFrame:
    """Links between rows of different components in one cell."""
    cells, mixed = _open_cells(known, [])
    rows = cells.join(mixed.select("g", "cell", "n"), ["g", "cell"]).withColumn("bits", _refined())
    keys = ["g", "cell", "bits"]
    one = rows.select(*keys, F.col("fp").alias("fp_a"), F.col("comp").alias("comp_a"))
    two = rows.select(*keys, F.col("fp").alias("fp_b"), F.col("comp").alias("comp_b"))
    pairs = one.join(two, keys).where(F.col("comp_a") < F.col("comp_b"))
    pairs = pairs.withColumn("pc_a", segment_counts(F.col("fp_a"))).withColumn("pc_b", segment_counts(F.col("fp_b")))
    return pairs.where(_near("a", "b", bits)).select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")).distinct()


def _classes(docs: DataFrame, best: Column, shingle: int = SHINGLE, bits: int = MAX_BITS) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of docs, and (fp, best): the least `best` among the rows that a fingerprint reaches."""
    prints = materialize(fingerprints(docs, shingle), "fingerprints")
    known = materialize(link_components(prints, bits), "components")
    named = prints.groupBy("fp").agg(F.min(best).alias("low")).join(known, "fp")
    least = named.groupBy("comp").agg(F.min("low").alias("best"))
    return prints, named.select("fp", "comp").join(least, "comp").select("fp", "best")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id: the smallest doc_id reachable)."""
    prints, classes = _classes(docs, F.col("doc_id"), shingle, bits)
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best").alias("component_id"))


def _same(row: Column) -> Column:
    """Equal for rows equal in doc_id and text; null ids come last."""
    return F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").cast("long").alias("doc_id"), row.alias("row"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class of near-duplicates: that of the smallest doc_id, of those its least text hash."""
    prints, classes = _classes(docs, _same(F.col("row")))
    counted = prints.groupBy("fp", _same(F.col("row")).alias("same")).agg(F.count("*").alias("n"))
    told = materialize(counted.join(classes, "fp").select("same", (F.col("same") == F.col("best")).alias("stays"), "n"), "kept-rows")
    kept = packed(docs, _same(text_hash()).alias("same")).join(told.where(~F.col("stays")).select("same"), "same", "left_anti")
    repeated = told.where(F.col("stays") & (F.col("n") > 1)).select("same")
    if not repeated.isEmpty():  # rows equal in id and text: aggregated before they are shuffled
        once = kept.join(repeated, "same", "left_semi").groupBy("same").agg(F.first("doc").alias("doc"))
        kept = kept.join(repeated, "same", "left_anti").select("doc").unionByName(once.select("doc"))
    return unpacked(kept, docs.columns)
