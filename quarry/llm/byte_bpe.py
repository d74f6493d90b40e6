"""Byte-level BPE: encoding by ranked merges of distinct words, decoding by concatenating binary pieces.

A text is cut by the tokenizer's pattern; each distinct word is folded once: its bytes start as single pieces and the
adjacent pair of lowest rank (leftmost among equals) merges until no pair has a rank. The ids of a text are those of
its words in order. Decoding looks up each id's bytes and concatenates them.

The folds run in Arrow batches with a bounded cache of distinct words, not in higher-order functions: see README.

Defined cases: a null or empty text has no ids and decodes to no bytes; a word that is itself a piece is one id; very
long words merge with a heap in n log n; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quarry.llm.common import texts

#: Distinct words a worker remembers; the cache starts anew when full.
CACHE_WORDS = 300_000
LONG_WORD = 96


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def words_of(pattern: str) -> Callable[[str], list[str]]:
    """White space in the pattern is Unicode's White_Space, as in the tokenizer's own engine."""
    return regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")).findall


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) > LONG_WORD:
        return _merge_long(word, ranks)
    pieces, get, none = [word[i : i + 1] for i in range(len(word))], ranks.get, len(ranks) + 1
    pairs = [get(a + b, none) for a, b in zip(pieces, pieces[1:])]
    while pairs and (low := min(pairs)) < none:
        i = pairs.index(low)
        pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = get(pieces[i - 1] + pieces[i], none)
        if i < len(pairs):
            pairs[i] = get(pieces[i] + pieces[i + 1], none)
    return [ranks[p] for p in pieces]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same fold with a heap of pairs over a linked list of piece bounds."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the piece that starts at i: its end; the start before it
    alive = bytearray(b"\1") * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j], end[i] = 0, stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (h := before[i]) >= 0 and (r := ranks.get(word[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Codec:
    """Encoder and decoder of one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split, self.cache = ranks, words_of(pattern), {}
        self.pieces = {rank: piece for piece, rank in ranks.items()}

    def encode(self, text: str) -> list[int]:
        return [i for w in self.split(text) for i in merge_word(w.encode(), self.ranks)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))

    def _word(self, word: str) -> tuple[str, int, bytes]:
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        ids = merge_word(word.encode(), self.ranks)
        self.cache[word] = found = (",".join(map(str, ids)), len(ids), self.decode(ids))
        return found

    def digest(self, text: str) -> tuple[int, str, bytes]:
        """(number of ids, ids in decimal joined by commas, decoded bytes)."""
        get, own = self.cache.get, self._word
        found = [get(w) or own(w) for w in self.split(text)]
        return sum([f[1] for f in found]), ",".join([f[0] for f in found]), b"".join([f[2] for f in found])


_codecs: dict[tuple[str, str], Codec] = {}


def shipped(docs: DataFrame, ranks_path: str, pattern: str) -> Callable[[], Codec]:
    """The codec of a rank file that the driver reads: its table, of fixed size, goes to the workers by broadcast."""
    table = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def codec() -> Codec:
        if (ranks_path, pattern) not in _codecs:
            _codecs[ranks_path, pattern] = Codec(table.value, pattern)
        return _codecs[ranks_path, pattern]

    return codec


def _per_batch(docs: DataFrame, make: Callable[[list], pa.RecordBatch], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield make(part)

    return docs.mapInArrow(run, schema)


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>, n_tokens) for every row."""
    codec = shipped(docs, ranks_path, pattern)

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        own = codec()
        ids = [own.encode(t) for t in part.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(len, ids), pa.int64())], ["doc_id", "ids", "n_tokens"])

    return _per_batch(texts(docs), make, "doc_id long, ids array<int>, n_tokens long")


def decode_ids(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes binary) of (doc_id, ids); ids without a piece raise KeyError."""
    codec = shipped(encoded, ranks_path, pattern)

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        own = codec()
        return pa.RecordBatch.from_arrays([part.column(0), pa.array([own.decode(i or []) for i in part.column(1).to_pylist()], pa.binary())], ["doc_id", "bytes"])

    return _per_batch(encoded.select("doc_id", "ids"), make, "doc_id long, bytes binary")


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): both directions in one pass over the texts."""
    codec = shipped(docs, ranks_path, pattern)

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        own = codec()
        found = [(n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(raw).hexdigest()) for n, ids, raw in map(own.digest, part.column(1).to_pylist())]
        counts, ids, raw = zip(*found) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _per_batch(texts(docs), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
