"""Language-model scores from a hierarchical Pitman-Yor model with Gibbs-sampled seating.

Each token is drawn in the restaurant of its context, the previous word (a text begins in a context of its own). Every
context of the training rows has its own restaurant, told apart by 48 bits of the word's hash; all share one parent, the
root, over a uniform base on the V known tokens and one unknown token. Seating is sampled by Gibbs sweeps: a sweep takes
all customers of a dish out of a restaurant and seats them again one by one, given the rest as the last sweep left it;
tables of the context restaurants are the customers of the root. Predictive probabilities are averaged over the sweeps
after burn-in.

Customers who join a table between two that open one are passed over at once, by inverting the exact chance that none
of them opens one; the draws have the distribution of seating one by one. Each dish of each restaurant has a random
stream of its own, seeded by sweep, word and context, and all sums are of integers: neither partitions nor settings of
the session change a score.

Layout: tokens go, packed, to parts by word hash; words that make up much of the corpus are spread over the parts by
word and context. A part holds the dishes of its words in all contexts, so what a sweep exchanges is one number for each
context of a part: its tables there go to the bucket of the context and the sum of all parts comes back. Parts are written
once, bucketed by part, so the sweeps shuffle nothing but these numbers. The spread words are seated in the root by the
driver; they are at most HOT_WORDS or four for each part.

Defined cases: a null or empty text is one end token; words the training rows lack are the unknown token, each with its
probability; a null doc_id trains; repeated rows are separate texts; without training rows every token is unknown; other
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import crc_mod, discard, materialize, scratch_path, shuffle_partitions, texts

FOLDS, HELD_OUT, SEED = 7, 2, 97
SWEEPS, BURN_IN = 6, 3
STRENGTH_ROOT, STRENGTH = 10.0, 5.0
#: Tokens packed at once by a task, at least and at most; tokens of one part in it.
FLUSH_TOKENS, MOST_TOKENS, SLICE_TOKENS = 400_000, 1_000_000, 20_000
#: Tokens a part should hold, and the least for which a part is made; parts that share one bucket of contexts.
PART_TOKENS, LEAST_PART_TOKENS, PARTS_A_BUCKET = 3_000_000, 50_000, 4
#: Layout only: words of which a flush holds this share may be spread, so many of them at least.
HOT_SHARE, HOT_WORDS = 1 / 20_000, 2000
#: Log10 probabilities of tokens are multiples of this, so that sums do not depend on their order.
UNIT = 1e-9
#: Customers seated one by one before those who join a table are passed over at once.
SINGLY = 32
#: A new table's weight from which a dish of more customers is seated by itself: it opens many.
OFTEN = 8.0
START = 0  # the context key of a text's first token; words have keys above
ROOT = 2**64 - 1  # stands for the root where a context key is asked for
END = b" end"  # no word holds a space


# ---------- packing ----------


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed: high bytes of small numbers cost next to nothing."""
    parts = []
    for a in arrays:
        raw = np.ascontiguousarray(a)
        head = np.array([len(raw), raw.dtype.itemsize], dtype=np.int64).tobytes() + raw.dtype.str.encode().ljust(8)
        parts.append(head + raw.view(np.uint8).reshape(-1, raw.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(raw):
        n, size = np.frombuffer(raw, dtype=np.int64, count=2, offset=at).tolist()
        kind = np.dtype(raw[at + 16 : at + 24].decode().strip())
        planes = np.frombuffer(raw, dtype=np.uint8, count=n * size, offset=at + 24).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += 24 + n * size
    return out


def _steps(ascending: np.ndarray) -> np.ndarray:
    """Differences, the first number first: cumsum gives the numbers back."""
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint32) if not len(x) or x.max() < 2**32 else x.astype(np.int64)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    n = len(keys[0])
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, SEED)


def _context(hashes: np.ndarray) -> np.ndarray:
    """The context keys of words: the upper 48 bits of their hashes."""
    return np.maximum(hashes >> np.uint64(16), np.uint64(1))


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


# ---------- seating ----------

_STEP, _M1, _M2 = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # fixed values of the splitmix64 generator


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _steps_of(n: int) -> np.uint64:
    return np.uint64(n * _STEP % 2**64)


def _streams(sweep: int, words: np.ndarray, contexts: np.ndarray | int) -> np.ndarray:
    """The seed of the random stream of each dish."""
    keys = contexts if isinstance(contexts, np.ndarray) else np.full(len(words), contexts, dtype=np.uint64)
    return _mix(_mix(words + _steps_of(SEED + sweep)) ^ keys)


def _draw(streams: np.ndarray, i: int) -> np.ndarray:
    """The i-th number of each stream, between 0 and 1."""
    return ((_mix(streams + _steps_of(i + 1)) >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53


def _draw_one(stream: int, i: int) -> float:
    x = (stream + (i + 1) * _STEP) % 2**64
    x = (x ^ (x >> 30)) * int(_M1) % 2**64
    x = (x ^ (x >> 27)) * int(_M2) % 2**64
    return (((x ^ (x >> 31)) >> 11) + 0.5) / 2**53


def _log_gamma(x: np.ndarray) -> np.ndarray:
    z, low = x + 8, x.copy()
    for i in range(1, 8):
        low *= x + i
    z2 = z * z
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + (1 / 12 - (1 / 360 - 1 / 1260 / z2) / z2) / z - np.log(low)


def seat(customers: np.ndarray, streams: np.ndarray, discount: float, strength: np.ndarray, share: np.ndarray | float, of: np.ndarray | float, grows: bool) -> np.ndarray:
    """Tables after seating all customers of each dish one by one.

    With t tables a new one weighs (strength + discount * t) * (share + t) / (of + t) where the parent `grows` with them,
    else (strength + discount * t) * share / of; the k customers seated weigh k - discount * t."""
    n, up = len(customers), 1.0 if grows else 0.0
    share, of = np.broadcast_to(np.asarray(share, dtype=np.float64), n), np.broadcast_to(np.asarray(of, dtype=np.float64), n)
    tables = np.minimum(customers, 1).astype(np.float64)

    def new(at: np.ndarray) -> np.ndarray:
        t = tables[at]
        return (strength[at] + discount * t) * (share[at] + up * t) / (of[at] + up * t)

    at, k = np.flatnonzero(customers > 1), 1
    while len(at) and k < SINGLY:
        weight = new(at)
        tables[at] += _draw(streams[at], k) * (weight + k - discount * tables[at]) < weight
        k += 1
        at = at[customers[at] > k]
    often = new(at) >= OFTEN
    for i in at[often].tolist():
        tables[i] = _seat_many(int(customers[i]), k, tables[i], int(streams[i]), discount, float(strength[i]), float(share[i]), float(of[i]), up)
    at = at[~often]
    seated = np.full(len(at), float(k))
    while len(at):
        chance, weight = np.log(_draw(streams[at], k)), new(at)
        k += 1
        old, rest = seated - discount * tables[at], customers[at] - seated
        begin = _log_gamma(old + weight) - _log_gamma(old)
        opens = _log_gamma(old + rest) - _log_gamma(old + rest + weight) + begin < chance  # not all of the rest join a table
        at, chance, weight, old, begin, seated = at[opens], chance[opens], weight[opens], old[opens], begin[opens], seated[opens]
        low, high = np.zeros(len(at)), rest[opens].astype(np.float64)
        while len(at) and (high - low).max() > 1:
            mid = np.floor((low + high) / 2)
            joins = _log_gamma(old + mid) - _log_gamma(old + mid + weight) + begin >= chance
            low, high = np.where(joins, mid, low), np.where(joins, high, np.maximum(mid, low + 1))
        tables[at] += 1
        seated += low + 1
        more = customers[at] > seated
        at, seated = at[more], seated[more]
    return tables


def _seat_many(customers: int, seated: int, tables: float, stream: int, discount: float, strength: float, share: float, of: float, up: float) -> float:
    """Tables of one dish at which many customers open one: the same draws, one after the other."""
    lg, i = math.lgamma, seated
    while seated < customers:
        chance = math.log(_draw_one(stream, i))
        i += 1
        weight = (strength + discount * tables) * (share + up * tables) / (of + up * tables)
        old, rest = seated - discount * tables, customers - seated
        begin = lg(old + weight) - lg(old)
        joins = lambda m: lg(old + m) - lg(old + m + weight) + begin >= chance  # noqa: B023, E731
        if joins(rest):
            break
        low, step = min(rest - 1, int(old * math.expm1(min(500.0, -chance / weight)))), 1  # near the answer; then in growing steps
        if joins(low):
            while low + step < rest and joins(low + step):
                low, step = low + step, 2 * step
            high = min(rest, low + step)
        else:
            high = low
            while high - step > 0 and not joins(high - step):
                high, step = high - step, 2 * step
            low = max(0, high - step)
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if joins(mid) else (low, mid)
        tables += 1
        seated += low + 1
    return tables


# ---------- first pass: the number of tokens and the words to spread ----------


def _survey(rows: DataFrame) -> tuple[DataFrame, int]:
    """Counts of words that some flush holds often, the most frequent first, and the number of all tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, tokens = Counter(), 0

        def flush() -> pa.RecordBatch:
            often = [(w, n) for w, n in counts.items() if n >= tokens * HOT_SHARE]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in often] + [None], pa.binary()), pa.array([n for _, n in often] + [tokens], pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = _words(text)
                counts.update(words)
                counts[END] += 1
                tokens += len(words) + 1
                if tokens >= FLUSH_TOKENS:
                    yield flush()
                    counts, tokens = Counter(), 0
        yield flush()

    sums = materialize(rows.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-survey")
    total = sums.where(F.col("word").isNull()).first()
    return sums.where(F.col("word").isNotNull()).orderBy(F.desc("n"), "word"), int(total["n"]) if total else 0


# ---------- second pass: parts ----------


def _spread(word: np.ndarray, context: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    mixed = _mix(np.where(hot, word ^ _mix(context), word))
    return (mixed % np.uint64(parts)).astype(np.int64)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Context keys in ascending order fall into ascending buckets."""
    return ((keys * np.uint64(buckets)) >> np.uint64(48)).astype(np.int64)


def _slices(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, first, end) of the runs of an ascending array."""
    at = _starts(bucket).tolist()
    return [(int(bucket[a]), a, b) for a, b in zip(at, [*at[1:], len(bucket)])]


def _doc_bucket(rid: np.ndarray, buckets: int) -> np.ndarray:
    return (rid + (rid >> 33) * 7919) % buckets


PARTS = "part long, bucket long, docs binary, words binary, types binary, open binary, entries binary, asked binary, gives binary, sums binary"


def _rows(schema: str, rows: list[dict]) -> pd.DataFrame:
    names = [c.split(" ")[0] for c in schema.split(", ")]
    return pd.DataFrame({name: pd.Series([r.get(name) for r in rows], dtype=object) for name in names})


def _parts(rows: DataFrame, hot: np.ndarray, parts: int, buckets: int, doc_buckets: int) -> DataFrame:
    """PARTS: a row for each part, a row for each part and bucket of the contexts it asks for, rows of documents (part below 0)."""
    most = min(MOST_TOKENS, max(FLUSH_TOKENS, SLICE_TOKENS * parts))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[bytes, int] = {}
        local: list[np.ndarray] = []
        of_row: list[tuple[int, int | None, bool]] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            hashes = np.array([_hash(w) for w in ids], dtype=np.uint64)
            by_hash = np.argsort(hashes)
            rank = np.empty(len(by_hash), dtype=np.int64)
            rank[by_hash] = np.arange(len(by_hash))
            hashes = hashes[by_hash]
            keys = np.concatenate([[np.uint64(START)], _context(hashes)])
            sizes = np.array([len(x) for x in local])
            token, row = rank[np.concatenate(local)].astype(np.int32), np.repeat(np.arange(len(local), dtype=np.int32), sizes)
            context = np.concatenate([np.zeros(1, dtype=np.int32), token[:-1] + 1])
            context[np.cumsum(sizes)[:-1]] = 0  # a text begins
            train = np.repeat(np.array([not held for _, _, held in of_row]), sizes)
            part = _spread(hashes[token], keys[context], np.isin(hashes, hot)[token], parts)
            order = np.lexsort((row, (context << 1) | train, token, part))
            part, token, context, train, row = part[order], token[order], context[order], train[order], row[order]
            at = _starts(part, token, context, train, row)
            count = np.diff(np.append(at, len(order)))
            part, token, context, train, row = part[at], token[at], context[at], train[at], row[at]
            base, numbers, blobs = of_row[0][0], [], []
            for p, a, b in _slices(part):
                first = _starts(token[a:b])
                runs = np.diff(np.append(first, b - a))
                asked, place = np.unique(context[a:b], return_inverse=True)
                packed = (_steps(hashes[token[a:b][first]]), runs.astype(np.uint32), _steps(keys[asked]), ((place << 1) | train[a:b]).astype(np.uint32), row[a:b].astype(np.uint32), count[a:b].astype(np.uint32), np.array([base], dtype=np.int64))
                numbers.append(p)
                blobs.append(_pack(*packed))
            rid = np.array([r for r, _, _ in of_row], dtype=np.int64)
            doc = np.array([i or 0 for _, i, _ in of_row], dtype=np.int64)
            flags = np.array([(i is None) | held << 1 for _, i, held in of_row], dtype=np.uint8)
            to = _doc_bucket(rid, doc_buckets)
            order = np.argsort(to, kind="stable")
            for b, first, end in _slices(to[order]):
                own = order[first:end]
                numbers.append(-1 - b)
                blobs.append(_pack(rid[own], doc[own], flags[own]))
            return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(blobs, pa.binary())], ["part", "blob"])

        for batch in batches:
            for rid, doc, text, held in zip(*(c.to_pylist() for c in batch.columns)):
                words = _words(text)
                words.append(END)
                local.append(np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int32))
                of_row.append((rid, doc, held))
                tokens += len(words)
                if tokens >= most:
                    yield flush()
                    ids, local, of_row, tokens = {}, [], [], 0
        if local:
            yield flush()

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        part = int(group["part"].iloc[0])
        if part < 0:
            return _rows(PARTS, [{"part": part, "docs": blob} for blob in group["blob"]])
        columns = [[] for _ in range(5)]
        for blob in group["blob"]:
            words, runs, keys, place, row, count, base = _unpack(blob)
            words, keys = np.cumsum(words, dtype=np.uint64), np.cumsum(keys, dtype=np.uint64)
            for to, x in zip(columns, (np.repeat(words, runs), keys[place >> 1], (place & 1).astype(bool), row.astype(np.int64) + base[0], count)):
                to.append(x)
        word, context, train, row, count = map(np.concatenate, columns)
        del columns
        order = np.lexsort((context, word))
        word, context, train, row, count = word[order], context[order], train[order], row[order], count[order]
        at = _starts(word, context)
        entries = np.diff(np.append(at, len(word)))
        seen = np.add.reduceat(count.astype(np.int64) * train, at)
        word, context = word[at], context[at]
        first = _starts(word)
        types, words = np.diff(np.append(first, len(word))), word[first]
        docs, place = np.unique(row, return_inverse=True)
        keys, asks = np.unique(context, return_inverse=True)
        own = Words(words, np.repeat(np.arange(len(words)), types), seen, hot)
        closed_of = np.bincount(asks[seen == 1], minlength=len(keys))
        guests_of = np.bincount(asks, seen, minlength=len(keys)).astype(np.int64)
        open_keys, open_asks = np.unique(asks[own.open], return_inverse=True)
        gives = np.bincount(open_asks, minlength=len(open_keys))
        out = [{
            "part": part,
            "words": _pack(_steps(words), types.astype(np.uint32)),
            "types": _pack(_small(asks), _small(seen)),
            "open": _pack(_steps(words[own.busy]), _small(own.closed[own.busy]), _small(np.bincount(own.of[own.open], minlength=len(words))[own.busy]), _steps(keys[open_keys]), _small(open_asks), _small(seen[own.open])),
            "entries": _pack(entries.astype(np.uint32), _small(place), count, _steps(docs)),
            "sums": _summands(own.hot_at[own.is_hot], len(hot), own.count[own.is_hot], own.kinds[own.is_hot], tail=own.stats()),
        }]
        of_open = _bucket(keys[open_keys], buckets)
        for b, first, end in _slices(_bucket(keys, buckets)):
            x, y = np.searchsorted(of_open, [b, b + 1])
            asked = _pack(_steps(keys[first:end]), _small(closed_of[first:end]), _small(guests_of[first:end]), _small(open_keys[x:y] - first))
            out.append({"part": part, "bucket": b, "asked": asked, "gives": _pack(_small(gives[x:y]))})
        return _rows(PARTS, out)

    return rows.mapInArrow(send, "part long, blob binary").groupBy("part").applyInPandas(merge, PARTS)


class Words:
    """The words of a part: their training counts and which of their dishes can change seats."""

    def __init__(self, words: np.ndarray, of: np.ndarray, seen: np.ndarray, hot: np.ndarray):
        n = len(words)
        self.of, self.open = of, seen >= 2  # one customer has one table, always
        self.count = np.bincount(of, seen, minlength=n).astype(np.int64)
        self.closed = np.bincount(of[seen == 1], minlength=n)
        n_open = np.bincount(of[self.open], minlength=n)
        self.kinds = self.closed + n_open
        self.seen = seen
        at = np.minimum(np.searchsorted(hot, words), max(0, len(hot) - 1))
        self.is_hot = hot[at] == words if len(hot) else np.zeros(n, dtype=bool)
        self.busy = np.flatnonzero((n_open > 0) | (self.closed >= 2) | self.is_hot)
        self.hot_at = np.where(self.is_hot, at, 0)

    def stats(self) -> list[int]:
        """Training tokens; dishes of one customer and of two; of the words that are not hot: known ones, first customers in the root,
        words of one customer there and of two, and customers of words that keep their seats."""
        cold = ~self.is_hot
        kinds, still = self.kinds[cold], np.delete(self.kinds, self.busy)
        own = [np.count_nonzero(self.seen == k) for k in (1, 2)]
        return [int(x) for x in [self.count.sum(), *own, np.count_nonzero(kinds), kinds.sum(), *(np.count_nonzero(kinds == k) for k in (1, 2)), still.sum()]]


def _summands(at: np.ndarray, width: int, *columns: np.ndarray, tail: list[int]) -> bytes:
    """Numbers to be summed over parts: columns of `width` numbers of which those at `at` are given, then the tail."""
    where = np.concatenate([np.zeros(0, dtype=np.int64), *(at + i * width for i in range(len(columns)))])
    return _pack(np.append(where, np.arange(len(tail)) + len(columns) * width), np.concatenate([np.zeros(0, dtype=np.int64), *columns, tail]).astype(np.int64))


def _added(blobs, n: int) -> np.ndarray:
    out = np.zeros(n, dtype=np.int64)
    for at, x in map(_unpack, blobs):
        out[at] += x  # the places of a part are distinct
    return out


def _sums(rows: DataFrame, n: int) -> np.ndarray:
    """n sums over parts: added up in groups of parts, about as many groups as parts in each, and then here."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = _added(group["sums"], n)
        at = np.flatnonzero(total)
        return pd.DataFrame({"sums": [_pack(at, total[at])]})

    own = rows.where(F.col("sums").isNotNull()).select("part", "sums")
    groups = math.isqrt(max(1, shuffle_partitions(rows.sparkSession)))
    found = own.groupBy(F.pmod("part", F.lit(groups)).alias("g")).applyInPandas(add, "sums binary").collect()
    return _added([bytes(r["sums"]) for r in found], n).astype(np.float64)


# ---------- the model ----------


@dataclass
class State:
    """What all parts share about one state of the seating."""

    root_customers: float
    root_tables: float
    hot_customers: np.ndarray
    hot_tables: np.ndarray


@dataclass
class Model:
    hot: np.ndarray  # sorted hashes of the spread words
    hot_counts: np.ndarray  # their training tokens
    tokens: int
    known: int  # distinct training tokens
    discount: float
    root_discount: float
    buckets: int
    still: float  # customers in the root of words that keep their seats: one each
    states: list[State] = field(default_factory=list)

    def base(self, state: State) -> float:
        """Weight in the root of what no customer there stands for."""
        return (STRENGTH_ROOT + self.root_discount * state.root_tables) / (self.known + 1)

    def root_share(self, state: State, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return (customers - self.root_discount * tables + self.base(state)) / (STRENGTH_ROOT + state.root_customers)

    def seat_root(self, sweep: int, words: np.ndarray, customers: np.ndarray, old: np.ndarray) -> np.ndarray:
        strength = STRENGTH_ROOT + self.root_discount * (self.states[sweep - 1].root_tables - old)
        return seat(customers.astype(np.int64), _streams(sweep, words, ROOT), self.root_discount, strength, 1.0, self.known + 1.0, False)

    def hot_places(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.hot, words), max(0, len(self.hot) - 1))
        return (self.hot[at] == words if len(self.hot) else np.zeros(len(words), dtype=bool)), at

    def root_of(self, state: State, words: np.ndarray, customers: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of words in the root; of hot words, the sums over all parts."""
        is_hot, at = self.hot_places(words)
        if not is_hot.any():
            return customers, tables
        return np.where(is_hot, state.hot_customers[at], customers), np.where(is_hot, state.hot_tables[at], tables)


STATES = "part long, bucket long, tables binary, gives binary, sums binary"
ASKED = "bucket long, part long, all binary, open binary, sums binary"
REPLIES = "part long, bucket long, state int, reply binary"


def _ask(group: pd.DataFrame) -> pd.DataFrame:
    """For one bucket: where each part's contexts stand among all of the bucket, and the sums that never change."""
    asked = [[np.cumsum(x[0], dtype=np.uint64), *x[1:]] for x in map(_unpack, group["asked"])]
    keys, place = np.unique(np.concatenate([x[0] for x in asked]), return_inverse=True)
    closed, guests = (np.bincount(place, np.concatenate([x[i] for x in asked]), minlength=len(keys)).astype(np.int64) for i in (1, 2))
    bucket, out, at = int(group["bucket"].iloc[0]), [], 0
    for part, x in zip(group["part"], asked):
        own = place[at : at + len(x[0])]
        at += len(own)
        out.append({"bucket": bucket, "part": int(part), "all": _pack(_steps(own)), "open": _pack(_steps(own[x[3]]))})
    out.append({"bucket": bucket, "part": -1, "sums": _pack(_small(closed), _small(guests))})
    return _rows(ASKED, out)


def _answer(states: list[int], whole: bool):
    """For one bucket: the tables of each context over all parts, and its customers too if `whole`; open contexts only unless `whole`."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        bucket, out = int(group["bucket"].iloc[0]), []
        closed, guests = _unpack(group.loc[group["sums"].notna(), "sums"].iloc[0])
        steps = dict(zip(group.loc[group["open"].notna(), "part"], group.loc[group["open"].notna(), "open"]))
        places = {int(p): np.cumsum(_unpack(x)[0]) for p, x in steps.items()}
        tables = {k: closed.astype(np.int64) for k in states}
        given = group[group["gives"].notna()]
        for state, own in given.groupby("state"):
            for part, blob in zip(own["part"], own["gives"]):
                tables[state][places[int(part)]] += _unpack(blob)[0]  # the places of a part are distinct
        if whole:
            asked = group[group["all"].notna()]
            places = {int(p): np.cumsum(_unpack(x)[0]) for p, x in zip(asked["part"], asked["all"])}
        for part, at in places.items():
            if whole:
                out.append({"part": part, "bucket": bucket, "state": -1, "reply": _pack(_small(guests[at]))})
            out += [{"part": part, "bucket": bucket, "state": state, "reply": _pack(_small(x[at]))} for state, x in tables.items()]
        return _rows(REPLIES, out)

    return run


def _replies(asked: DataFrame, gives: dict[int, DataFrame], whole: bool) -> DataFrame:
    kinds = {"all": whole, "open": True, "sums": True}
    rows = asked.select("bucket", "part", *[F.col(c) if on else F.lit(None).cast("binary").alias(c) for c, on in kinds.items()], F.lit(None).cast("int").alias("state"), F.lit(None).cast("binary").alias("gives"))
    for state, own in gives.items():
        own = own.where(F.col("gives").isNotNull())
        rows = rows.unionByName(own.select("bucket", "part", *[F.lit(None).cast("binary").alias(c) for c in kinds], F.lit(state).alias("state"), "gives"))
    return rows.groupBy("bucket").applyInPandas(_answer(sorted(gives), whole), REPLIES)


def _told(dynamic: pd.DataFrame, state: int) -> np.ndarray:
    """What the buckets reply about one state, in the order of the part's contexts."""
    own = dynamic[(dynamic["state"] == state) & dynamic["reply"].notna()].sort_values("bucket")
    return np.concatenate([np.zeros(0, dtype=np.int64), *(_unpack(x)[0] for x in own["reply"])]).astype(np.int64)


def _sweep(model: Model, sweep: int):
    """From a part's state after the last sweep to the next."""

    def run(static: pd.DataFrame, dynamic: pd.DataFrame) -> pd.DataFrame:
        if not len(static):
            return _rows(STATES, [])
        part = int(static["part"].iloc[0])
        words, closed, n_open, keys, asks, seen = _unpack(static["open"].iloc[0])
        words, keys = np.cumsum(words, dtype=np.uint64), np.cumsum(keys, dtype=np.uint64)
        closed, seen, asks = closed.astype(np.int64), seen.astype(np.int64), asks.astype(np.int64)
        of, state = np.repeat(np.arange(len(words)), n_open), model.states[sweep - 1]
        before = dynamic.loc[dynamic["tables"].notna(), "tables"]
        old = _unpack(before.iloc[0]) if len(before) else None
        tables = old[0].astype(np.int64) if old else np.ones(len(seen), dtype=np.int64)
        mine = closed + np.bincount(of, tables, minlength=len(words))
        mine_tables = old[1].astype(np.int64) if old else np.minimum(mine, 1)
        customers, root_tables = model.root_of(state, words, mine, mine_tables)
        rest = customers[of] - tables
        d0 = model.root_discount
        strength = STRENGTH + model.discount * (_told(dynamic, sweep - 1)[asks] - tables)
        share = rest - d0 * np.maximum(np.minimum(root_tables[of], rest), 1) + model.base(state)
        tables = seat(seen, _streams(sweep, words[of], keys[asks]), model.discount, strength, share, STRENGTH_ROOT + state.root_customers - tables, True)
        mine = closed + np.bincount(of, tables, minlength=len(words))
        is_hot, at = model.hot_places(words)
        cold = ~is_hot
        mine_tables = np.zeros(len(words))
        mine_tables[cold] = model.seat_root(sweep, words[cold], mine[cold], root_tables[cold])
        out = [{
            "part": part,
            "tables": _pack(_small(tables), _small(mine_tables)),
            "sums": _summands(at[is_hot], len(model.hot), mine[is_hot], tail=[int(mine[cold].sum()), int(mine_tables.sum())]),
        }]
        gives = np.bincount(asks, tables, minlength=len(keys))
        out += [{"part": part, "bucket": b, "gives": _pack(_small(gives[x:y]))} for b, x, y in _slices(_bucket(keys, model.buckets))]
        return _rows(STATES, out)

    return run


DYNAMIC = ("part", "bucket", "state", "reply", "tables")


def _dynamic(replies: DataFrame, states: dict[int, DataFrame]) -> DataFrame:
    """What changes from sweep to sweep: replies of the buckets and the parts' own seating."""
    rows = replies.withColumn("tables", F.lit(None).cast("binary")).select(*DYNAMIC)
    for k, own in states.items():
        own = own.where(F.col("tables").isNotNull())
        rows = rows.unionByName(own.select("part", "bucket", F.lit(k).alias("state"), F.lit(None).cast("binary").alias("reply"), "tables"))
    return rows


def _begin(parts: DataFrame, hot: np.ndarray, buckets: int) -> Model:
    n = len(hot)
    sums = _sums(parts, 2 * n + 8)
    counts, kinds = sums[:n], sums[n : 2 * n]
    tokens, once, twice, known, customers, root_once, root_twice, still = sums[2 * n :].tolist()
    root_once, root_twice = root_once + np.count_nonzero(kinds == 1), root_twice + np.count_nonzero(kinds == 2)
    discounts = [min(0.95, max(0.05, a / (a + 2 * b))) if a + b else 0.5 for a, b in ((once, twice), (root_once, root_twice))]
    model = Model(hot, counts, int(tokens), int(known + np.count_nonzero(counts)), *discounts, buckets, still)
    model.states.append(State(customers + kinds.sum(), known + np.count_nonzero(kinds), kinds, np.minimum(kinds, 1)))
    return model


def _train(parts: DataFrame, model: Model) -> tuple[DataFrame, dict[int, DataFrame]]:
    """Where parts' contexts stand in the buckets, and the seating after each sweep past burn-in."""
    asked = materialize(parts.where(F.col("asked").isNotNull()).select("bucket", "part", "asked").groupBy("bucket").applyInPandas(_ask, ASKED), "lm-asked")
    static = parts.where(F.col("open").isNotNull()).select("part", "open")
    gives, states, n = parts.where(F.col("gives").isNotNull()).select("part", "bucket", "gives"), {}, len(model.hot)
    for k in range(1, SWEEPS + 1):
        last = {k - 1: states[k - 1]} if k > 1 else {}
        dynamic = _dynamic(_replies(asked, {k - 1: gives}, False), last)
        swept = static.groupBy("part").cogroup(dynamic.groupBy("part")).applyInPandas(_sweep(model, k), STATES)
        states[k] = gives = materialize(swept, f"lm-sweep{k}")
        sums = _sums(gives, n + 2)
        tables = model.seat_root(k, model.hot, sums[:n], model.states[-1].hot_tables)
        if 1 < k <= BURN_IN + 1:
            discard(states[k - 1])
        model.states.append(State(sums[n] + model.still + sums[:n].sum(), sums[n + 1] + model.still + tables.sum(), sums[:n], tables))
    return asked, {k: s for k, s in states.items() if k > BURN_IN}


def predictive(model: Model, words: np.ndarray, own: Words, asks: np.ndarray, guests: np.ndarray, tables: dict[int, np.ndarray], seats: dict[int, list[np.ndarray]]) -> np.ndarray:
    """Each dish's probability in its context, averaged over the sweeps in `seats`."""
    total = np.zeros(len(asks))
    for k, (open_tables, root_tables) in seats.items():
        t = np.minimum(own.seen, 1)
        t[own.open] = open_tables
        customers = np.bincount(own.of, t, minlength=len(words))
        in_root = np.minimum(customers, 1)
        in_root[own.busy] = root_tables
        share = model.root_share(model.states[k], *model.root_of(model.states[k], words, customers, in_root))
        back = (STRENGTH + model.discount * tables[k][asks]) * share[own.of]
        total += (own.seen - model.discount * t + back) / (STRENGTH + guests[asks])
    return total / len(seats)


def _score(model: Model, kept: list[int], doc_buckets: int):
    """A part's sums of log10 probabilities, packed by bucket of documents."""

    def run(static: pd.DataFrame, dynamic: pd.DataFrame) -> pd.DataFrame:
        if not len(static):
            return pd.DataFrame({"bucket": [], "blob": []})
        (words, types), (asks, seen), (entries, place, count, docs) = (_unpack(static[c].iloc[0]) for c in ("words", "types", "entries"))
        words, docs, seen = np.cumsum(words, dtype=np.uint64), np.cumsum(docs), seen.astype(np.int64)
        own = Words(words, np.repeat(np.arange(len(words)), types), seen, model.hot)
        held = dynamic[dynamic["tables"].notna()]
        seats = {k: _unpack(held.loc[held["state"] == k, "tables"].iloc[0]) for k in kept}
        chance = predictive(model, words, own, asks, _told(dynamic, -1), {k: _told(dynamic, k) for k in kept}, seats)
        of_word = np.where(own.is_hot, model.hot_counts[own.hot_at], own.count) if len(model.hot) else own.count
        base = np.rint(np.log10((of_word + 1) / (model.tokens + model.known + 1)) / -UNIT)
        score = np.rint(np.log10(chance) / -UNIT)
        n, word, count = len(docs), np.repeat(own.of, entries), count.astype(np.float64)
        base, score = (np.bincount(place, count * x, minlength=n).astype(np.int64) for x in (base[word], np.repeat(score, entries)))
        tokens, known = (np.bincount(place, x, minlength=n).astype(np.uint32) for x in (count, count * (of_word > 0)[word]))
        bucket = _doc_bucket(docs, doc_buckets)
        order = np.argsort(bucket, kind="stable")  # docs ascend inside a bucket
        out = [(b, _pack(_steps(docs[at]), base[at], score[at], tokens[at], tokens[at] - known[at])) for b, at in ((b, order[x:y]) for b, x, y in _slices(bucket[order]))]
        return pd.DataFrame({"bucket": [b for b, _ in out], "blob": [x for _, x in out]})

    return run


def _scores(parts: DataFrame, asked: DataFrame, model: Model, states: dict[int, DataFrame], doc_buckets: int) -> DataFrame:
    """The sums of all parts, and the documents they belong to."""
    static = parts.where(F.col("entries").isNotNull()).select("part", "words", "types", "entries")
    dynamic = _dynamic(_replies(asked, states, True), states)
    packed = static.groupBy("part").cogroup(dynamic.groupBy("part")).applyInPandas(_score(model, sorted(states), doc_buckets), "bucket long, blob binary")
    docs = parts.where(F.col("docs").isNotNull()).select((-1 - F.col("part")).alias("bucket"), F.lit(None).cast("binary").alias("blob"), "docs")

    def add(group: pd.DataFrame) -> pd.DataFrame:
        rid, doc, flags = map(np.concatenate, zip(*(_unpack(x) for x in group["docs"].dropna())))
        order = np.argsort(rid)
        rid, doc, flags = rid[order], doc[order], flags[order]
        base, score, tokens, unknown = (np.zeros(len(rid), dtype=np.int64) for _ in range(4))
        for blob in group["blob"].dropna():
            own, *sums = _unpack(blob)
            at = np.searchsorted(rid, np.cumsum(own))
            for to, x in zip((base, score, tokens, unknown), sums):
                to[at] += x  # the documents of a blob are distinct
        ids = pd.Series(doc, dtype="Int64").mask((flags & 1).astype(bool))
        counts = {"n_tokens": tokens, "n_known": tokens - unknown, "train_tokens": np.full(len(rid), model.tokens, dtype=np.int64)}
        return pd.DataFrame({"doc_id": ids, "held_out": (flags >> 1).astype(bool)} | counts | {"base_score": base * -UNIT, "score": score * -UNIT})

    rows = packed.withColumn("docs", F.lit(None).cast("binary")).unionByName(docs)
    return rows.groupBy("bucket").applyInPandas(add, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _bucketed(df: DataFrame, n: int) -> DataFrame:
    """df written once to the shared folder, bucketed by part: later passes join it by part without a shuffle."""
    spark, name = df.sparkSession, f"lm_parts_{uuid.uuid4().hex}"
    df.write.bucketBy(n, "part").option("path", scratch_path(spark, "lm-parts")).saveAsTable(name)
    return spark.table(name)


def score_texts(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    held = crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT if held_out is None else held_out
    rows = texts(docs).select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text", held.alias("held_out"))
    own = shuffle_partitions(docs.sparkSession)
    often, tokens = _survey(rows)
    n_parts = max(1, min(own, math.ceil(tokens / LEAST_PART_TOKENS)), math.ceil(tokens / PART_TOKENS))
    hot = np.sort(np.array([_hash(bytes(r["word"])) for r in often.limit(max(HOT_WORDS, 4 * n_parts)).collect()], dtype=np.uint64))
    buckets = math.ceil(n_parts / PARTS_A_BUCKET)
    parts = _bucketed(_parts(rows, hot, n_parts, buckets, own), own)
    model = _begin(parts, hot, buckets)
    asked, states = _train(parts, model)
    return _scores(parts, asked, model, states, own)


def perplexity(scored: DataFrame) -> DataFrame:
    """(held_out, perplexity, base_perplexity): ten to the mean negative log10 probability of a token."""
    ten = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(ten("score").alias("perplexity"), ten("base_score").alias("base_perplexity"))
