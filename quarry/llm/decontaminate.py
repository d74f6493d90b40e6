"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

Texts and items are sequences of symbols: words (runs of letters, digits and underscores, lower-cased), and single letters
of scripts that put no spaces between words. An item of n symbols leaks where a passage lies within
floor((1 - similarity) * n) edits of it. Every window of an item's size that may hold such a passage is embedded by random
walks: a walk writes the symbol it stands on and moves on by a bit hashed from walk, step and symbol, so a few edits
become a small Hamming distance. A repetition samples places of a walk; window and item are candidates for each other
where one repetition samples the same symbols. Candidates are verified by exact edit distance.

Edits shift a walk for long, so its early places agree more often than its late ones: half of the samples are drawn with
odds falling as one over the place. Measured on simulated copies at the edit bound, 120 for each size and kind of edit
(30 at 3000 symbols), the share of copies lost with the settings below, before other windows of a copy are counted:

    symbols     10     30     59    150    600   3000
    insert   0.000  0.000  0.000  0.000  0.000  0.000
    delete   0.000  0.002  0.001  0.000  0.001  0.001
    replace  0.000  0.000  0.000  0.000  0.000  0.000

Before embedding, windows without any untouched piece are passed over: k edits leave one of k + 1 disjoint pieces of an
item as it was, at most k symbols off its place, so no window that could be verified is lost there.

Items are broadcast in blocks of bounded bytes; more blocks mean more passes. An index takes memory in proportion to its
items. Defined cases: null and empty texts leak nothing; null and empty items match nothing; equal items leak separately;
of several passages of one item in a text the one of least distance, then of least start and end, is reported, in
symbols; a null doc_id is reported as null; other columns pass through `drop_leaks`; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import filter_rows, texts

SIMILARITY, SEED = 0.8, 11
#: Walks, repetitions and samples of each for items of up to so many symbols; the last row holds for all others.
WALKS, SETTINGS = 16, ((64, 128, 2), (None, 256, 1))
#: Bytes of items that one broadcast may hold, and what an item takes besides its text.
BLOCK_BYTES, ITEM_BYTES = 64 << 20, 4096
#: Unicode blocks of scripts without spaces between words (Thai to Tibetan, Burmese, Khmer, kana, Han).
_BARE = "฀-࿿က-႟ក-៿぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
_symbols = re.compile(rf"(?=[{_BARE}])\w|[^\W{_BARE}]+").findall
SCHEMA = "doc_id long, item_id long, start_word int, end_word int, distance int, similarity double"
_MASK = (1 << 20) - 1


def edits_allowed(n: int, similarity: float = SIMILARITY) -> int:
    return int((1 - similarity) * n + 1e-9)


def symbols_of(text: str | None) -> list[str]:
    return _symbols((text or "").lower())


# ---------- verification ----------


def _scores(places: dict[int, list[int]], n: int, words: list[int], anchored: bool = False) -> Iterator[int]:
    """After each word the least distance of an item of n symbols to a passage that ends there; `anchored`: that starts with the
    first word. places: where each symbol stands in the item. One bit of a long integer for each of them."""
    full, last, score = (1 << n) - 1, 1 << (n - 1), n
    more, less = full, 0  # bits: where a column of the edit table rises and falls
    for w in words:
        eq = 0
        for p in places.get(w, ()):
            eq |= 1 << p
        down = eq | less
        across = (((eq & more) + more) ^ more) | eq
        up, fall = less | (full & ~(across | more)), more & across
        score += bool(up & last) - bool(fall & last)
        up, fall = up << 1 | anchored, fall << 1
        more, less = full & (fall | ~(down | up)), full & up & down
        yield score


def _places(item: list[int]) -> dict[int, list[int]]:
    out = defaultdict(list)
    for p, w in enumerate(item):
        out[w].append(p)
    return out


def nearest_passage(item: list[int], words: list[int], most: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the passage of words nearest to item, within `most` edits; least distance, then start, then end."""
    n = len(item)
    least = min(_scores(_places(item), n, words), default=n)
    if least > most:
        return None
    ends = list(_scores(_places(item[::-1]), n, words[::-1]))
    start = len(words) - 1 - max(j for j, d in enumerate(ends) if d == least)
    end = next(j for j, d in enumerate(_scores(_places(item), n, words[start:], True)) if d == least)
    return least, start, start + end + 1


# ---------- candidates ----------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # fixed values of the splitmix64 generator


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Embedding:
    """Walks over windows of n symbols and the places that each repetition samples."""

    def __init__(self, n: int):
        self.n, steps = n, 2 * n  # a walk moves on at every other step
        repeats, samples = next((r, q) for most, r, q in SETTINGS if most is None or n <= most)
        rng = np.random.default_rng((SEED, n))
        even = rng.integers(0, steps, (repeats, samples))
        early = np.floor(np.exp(rng.random((repeats, samples)) * math.log(steps + 1)) - 1).astype(np.int64)  # odds falling as 1 / place
        self.at = np.where(rng.random((repeats, samples)) < 0.5, even, early)
        self.walk = np.arange(repeats) % WALKS
        self.salt = _mix(np.arange(1, WALKS + 1, dtype=np.uint64))
        self.named = _mix(np.arange(1, repeats + 1, dtype=np.uint64) << np.uint64(32))
        self.taken = [np.nonzero(self.at == t) for t in range(int(self.at.max()) + 1)]

    def keys(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A row of repetition keys for each window of words that begins at one of starts; 0 where a sample is no symbol of an item.

        words must end in n zeros, which stand for no symbol."""
        at = np.zeros((len(starts), WALKS), dtype=np.int64)
        seen = np.zeros((len(starts), *self.at.shape), dtype=np.uint64)
        for t, (r, slot) in enumerate(self.taken):
            here = np.where(at < self.n, words[starts[:, None] + np.minimum(at, self.n - 1)], 0).astype(np.uint64)
            if len(r):
                seen[:, r, slot] = here[:, self.walk[r]]
            at += (_mix(here ^ self.salt ^ np.uint64((t + 1) << 40)) & np.uint64(1)).astype(np.int64)
        keys = np.broadcast_to(self.named, seen.shape[:2])
        for slot in range(seen.shape[2]):
            keys = _mix(keys + seen[:, :, slot])
        return np.where((seen == 0).any(axis=2), np.uint64(0), keys)


def _gram_hash(words: np.ndarray, q: int) -> np.ndarray:
    """A hash of each run of q symbols."""
    n = len(words) - q + 1
    total = np.zeros(n, dtype=np.int64)
    for i in range(q):
        total = total * 1_000_003 + words[i : i + n]
    return total ^ (total >> 29)


def _bitmap(hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(_MASK + 1, dtype=bool)
    bits[hashes & _MASK] = True
    return bits


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


class Index:
    """Items by their repetition keys, and the pieces that say where windows are worth embedding."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY):
        self.similarity, self.symbols = similarity, {}
        self.items: list[tuple[int, np.ndarray]] = []
        for item_id, text in items:
            if words := symbols_of(text):
                self.items.append((item_id, np.array([self.symbols.setdefault(w, len(self.symbols) + 1) for w in words], dtype=np.int64)))
        by_size = defaultdict(list)
        self.pieces: dict[int, dict[int, set[tuple[int, int]]]] = defaultdict(lambda: defaultdict(set))  # by length: hash -> (size, offset)
        for i, (_, x) in enumerate(self.items):
            by_size[len(x)].append(i)
            k = edits_allowed(len(x), similarity)
            q = max(1, len(x) // (k + 1))
            for p in range(0, min((k + 1) * q, len(x) - q + 1), q):
                self.pieces[q][int(_gram_hash(x[p : p + q], q)[0])].add((len(x), p))
        self.filters = {q: _bitmap(np.array(list(of), dtype=np.int64)) for q, of in self.pieces.items()}
        self.embeddings = {n: Embedding(n) for n in by_size}
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by size: sorted keys and the item of each
        for n, own in by_size.items():
            keys = np.concatenate([self.embeddings[n].keys(np.append(self.items[i][1], np.zeros(n, dtype=np.int64)), np.zeros(1, dtype=np.int64)) for i in own])
            of = np.repeat(np.array(own), keys.shape[1])
            order = np.argsort(keys, axis=None, kind="stable")
            self.tables[n] = keys.ravel()[order], of[order]

    def windows(self, words: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """By size, first and end of the runs of places at which a window may begin a leak."""
        found = defaultdict(set)
        for q, of in self.pieces.items():
            if len(words) >= q:
                grams = _gram_hash(words, q)
                for at in np.flatnonzero(self.filters[q][grams & _MASK]).tolist():
                    for n, offset in of.get(int(grams[at]), ()):
                        found[n].add(at - offset)
        out = {}
        for n, starts in found.items():
            k = edits_allowed(n, self.similarity)
            spans = [(max(0, s - k), min(len(words), s + k + 1)) for s in starts]
            out[n] = _merged([(a, b) for a, b in spans if a < b])
        return out

    def candidates(self, words: np.ndarray) -> dict[int, list[int]]:
        """By item, where the windows begin that share a repetition with it."""
        found = defaultdict(list)
        for n, spans in self.windows(words).items():
            table, of = self.tables[n]
            padded = np.append(words, np.zeros(n, dtype=np.int64))
            for a, b in spans:
                for first in range(a, b, 1024):
                    starts = np.arange(first, min(b, first + 1024))
                    keys = self.embeddings[n].keys(padded, starts)
                    low, high = np.searchsorted(table, keys, "left"), np.searchsorted(table, keys, "right")
                    rows, columns = np.nonzero((high > low) & (keys != 0))
                    pairs = {(int(starts[r]), int(i)) for r, c in zip(rows, columns) for i in of[low[r, c] : high[r, c]]}
                    for start, i in pairs:
                        found[i].append(start)
        return found

    def leaks(self, text: str) -> list[tuple[int, int, int, int, float]]:
        """(item_id, start_word, end_word, distance, similarity) of each item that the text holds."""
        get = self.symbols.get
        words = np.array([get(w, 0) for w in symbols_of(text)], dtype=np.int64)
        if not words.any():
            return []
        out = []
        for i, starts in sorted(self.candidates(words).items()):
            item_id, item = self.items[i]
            n, most = len(item), edits_allowed(len(item), self.similarity)
            spans = _merged([(max(0, s - most), min(len(words), s + n + most)) for s in starts])
            found = [(d, low + a, low + b) for low, high in spans for d, a, b in [nearest_passage(item.tolist(), words[low:high].tolist(), most) or (n, 0, 0)] if d <= most]
            if found:
                d, a, b = min(found)
                out.append((item_id, a, b, d, 1 - d / n))
        return out


# ---------- over tables ----------

_indexes: dict[str, Index] = {}


def _shipped(spark: SparkSession, items: list[tuple[int, str]], similarity: float) -> Callable[[], Index]:
    """The index of a block of items, which each worker process builds once."""
    block, name = spark.sparkContext.broadcast(items), uuid.uuid4().hex  # at most block_bytes

    def index() -> Index:
        if name not in _indexes:
            _indexes.clear()
            _indexes[name] = Index(block.value, similarity)
        return _indexes[name]

    return index


def _scan(docs: DataFrame, items: list[tuple[int, str]], similarity: float) -> DataFrame:
    index = _shipped(docs.sparkSession, items, similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index()
        for batch in batches:
            found = [(d, *leak) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for leak in own.leaks(t)]
            columns = list(zip(*found)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "start_word", "end_word", "distance", "similarity"])

    return docs.mapInArrow(run, SCHEMA)


def find_leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, start_word, end_word, distance, similarity): one row for each document row and item that it holds."""
    out = None
    for own in _item_blocks(items, block_bytes):
        part = _scan(texts(docs), own, similarity)
        out = part if out is None else out.unionByName(part)
    return out


def _item_blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about block_bytes, one block at least."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).where(F.col("text").isNotNull())
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + ITEM_BYTES), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / block_bytes))
    for k in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield [(r["item_id"], r["text"]) for r in own.collect()]


def drop_leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows that hold an item."""
    for own in _item_blocks(items, block_bytes):
        docs = filter_rows(docs, _no_leak(_shipped(docs.sparkSession, own, similarity)))
    return docs


def _no_leak(index: Callable[[], Index]) -> Callable[[], Callable[[str], bool]]:
    def make() -> Callable[[str], bool]:
        own = index()
        return lambda text: not own.leaks(text)

    return make
