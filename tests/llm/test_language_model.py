import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import ODD, frame, prose

from quarry.llm import language_model as lm


def tokens(t):
    return (t or "").encode().lower().split() + [b" end"]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    bank = [prose(rng, 8) for _ in range(30)]
    return [(i, " ".join(rng.choice(bank) for _ in range(rng.randint(0, 6)))) for i in range(300)] + ODD


@pytest.fixture(scope="module")
def scored(spark, rows):
    return lm.score_texts(frame(spark, rows)).collect()


def test_counts_and_base_scores(rows, scored):
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = []
    for i, t in rows:
        w = tokens(t)
        want.append((i, held(i), len(w), sum(x in c for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 4)))
    got = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in scored]
    assert len(got) == len(want)
    close = lambda a, b: a[:5] == b[:5] and abs(a[5] - b[5]) <= 1e-3
    assert all(close(a, b) for a, b in zip(sorted(got, key=repr), sorted(want, key=repr)))


def test_model_beats_the_base_on_held_out_texts(spark, scored):
    for r in lm.perplexity(spark.createDataFrame(scored)).collect():
        assert r["perplexity"] < r["base_perplexity"]


def test_scores_depend_on_the_text_alone(scored):
    same = [r["score"] for r in scored if r["doc_id"] == 7008]
    assert len(same) == 2 and same[0] == same[1]
    assert all(r["score"] < 0 for r in scored)


class Sampler:
    """The model over dictionaries: every customer of every dish takes a seat, one after the other."""

    def __init__(self, train):
        self.dishes = Counter()  # (context, word) -> customers
        for text in train:
            before = None
            for w in tokens(text):
                self.dishes[before, w] += 1
                before = w
        self.counts = Counter()
        for (_, w), n in self.dishes.items():
            self.counts[w] += n
        self.tables = {dish: 1 for dish in self.dishes}
        self.root = self.root_customers()
        self.root_tables = dict.fromkeys(self.root, 1)
        share = lambda ns: min(0.95, max(0.05, ns[1] / (ns[1] + 2 * ns[2]))) if ns[1] + ns[2] else 0.5
        self.d, self.d0 = share(Counter(self.dishes.values())), share(Counter(self.root.values()))

    def root_customers(self):
        out = Counter()
        for (_, w), t in self.tables.items():
            out[w] += t
        return out

    def key(self, context):
        return lm.START if context is None else max(1, lm._hash(context) >> 16)

    def seat(self, customers, sweep, word, key, discount, weight):
        def draw(i):
            x, over = lm._hash(word), 2**64
            for salt in ((lm.SEED + sweep) * lm._STEP, None):
                x = (x + salt if salt else x ^ key) % over
                x = (x ^ x >> 30) * int(lm._M1) % over
                x = (x ^ x >> 27) * int(lm._M2) % over
                x ^= x >> 31
            return lm._draw_one(x, i)

        tables = seated = 1
        for i in range(1, lm.SINGLY):
            if seated == customers:
                return tables
            new = weight(tables)
            tables, seated = tables + (draw(i) * (new + seated - discount * tables) < new), seated + 1
        i = lm.SINGLY
        while seated < customers:  # one number for all who join a table and the one who opens one
            left, new = draw(i), weight(tables)
            i += 1
            chance, opened = 1.0, False
            while seated < customers and not opened:
                old = seated - discount * tables
                chance *= old / (old + new)
                opened = chance < left
                seated += 1
            tables += opened
        return tables

    def sweep(self, number):
        root_n, root_t, known = sum(self.root.values()), sum(self.root_tables.values()), len(self.root)
        base = (lm.STRENGTH_ROOT + self.d0 * root_t) / (known + 1)
        in_context, tables = Counter(), {}
        for (u, _), t in self.tables.items():
            in_context[u] += t
        for (u, w), n in self.dishes.items():
            old = self.tables[u, w]
            rest = self.root[w] - old
            parent = rest - self.d0 * max(1, min(self.root_tables[w], rest)) + base

            def weight(t):
                return (lm.STRENGTH + self.d * (in_context[u] - old + t)) * (parent + t) / (lm.STRENGTH_ROOT + root_n - old + t)  # noqa: B023

            tables[u, w] = self.seat(n, number, w, self.key(u), self.d, weight)
        self.tables, last = tables, self.root_tables
        self.root = self.root_customers()
        self.root_tables = {w: self.seat(n, number, w, lm.ROOT, self.d0, lambda t: (lm.STRENGTH_ROOT + self.d0 * (root_t - last[w] + t)) / (known + 1)) for w, n in self.root.items()}

    def probability(self, u, w):
        n, t, known = sum(self.root.values()), sum(self.root_tables.values()), len(self.root)
        share = (self.root[w] - self.d0 * self.root_tables.get(w, 0) + (lm.STRENGTH_ROOT + self.d0 * t) / (known + 1)) / (lm.STRENGTH_ROOT + n)
        guests = sum(c for (v, _), c in self.dishes.items() if v == u)
        tables = sum(c for (v, _), c in self.tables.items() if v == u)
        return (self.dishes[u, w] - self.d * self.tables.get((u, w), 0) + (lm.STRENGTH + self.d * tables) * share) / (lm.STRENGTH + guests)

    def scores(self, texts):
        """Log10 probability of each text, averaged as the operator does it."""
        pairs = {(u, w) for t in texts for u, w in zip([None, *tokens(t)], tokens(t))}
        total = dict.fromkeys(pairs, 0.0)
        for k in range(1, lm.SWEEPS + 1):
            self.sweep(k)
            if k > lm.BURN_IN:
                for p in pairs:
                    total[p] += self.probability(*p) / (lm.SWEEPS - lm.BURN_IN)
        return [sum(math.log10(total[u, w]) for u, w in zip([None, *tokens(t)], tokens(t))) for t in texts]


@pytest.fixture(scope="module")
def small():
    rng = random.Random(3)
    bank = [prose(rng, 5) for _ in range(12)]
    return [(i, " ".join(rng.choice(bank) for _ in range(rng.randint(0, 8)))) for i in range(150)] + [(500, "x " * 300), (501, "y " * 90 + "x"), (None, "no id"), (502, None)]


@pytest.mark.parametrize("often", [lm.OFTEN, 0.0])
def test_scores_match_a_sampler_that_seats_one_by_one(spark, small, often, monkeypatch):
    monkeypatch.setattr(lm, "OFTEN", often)
    want = Sampler([t for i, t in small if not held(i)]).scores([t for _, t in small])
    got = {r["doc_id"]: r["score"] for r in lm.score_texts(frame(spark, small)).collect()}
    assert all(math.isclose(got[i], x, abs_tol=1e-5) for (i, _), x in zip(small, want))


def test_scores_do_not_depend_on_the_layout(spark, rows, scored, monkeypatch):
    """Other partitions, flushes, parts and spread words give the very same numbers."""
    monkeypatch.setattr(lm, "FLUSH_TOKENS", 50)
    monkeypatch.setattr(lm, "MOST_TOKENS", 50)
    monkeypatch.setattr(lm, "LEAST_PART_TOKENS", 1000)
    monkeypatch.setattr(lm, "HOT_WORDS", 5)
    monkeypatch.setattr(lm, "PARTS_A_BUCKET", 1)
    monkeypatch.setattr(lm, "shuffle_partitions", lambda _: 5)
    assert sorted(lm.score_texts(frame(spark, rows).repartition(7)).collect(), key=repr) == sorted(scored, key=repr)


def test_probabilities_sum_to_one(small):
    """For every context the known tokens and the unknown one share all probability, after every sweep."""
    model = Sampler([t for _, t in small])
    for k in (1, 2):
        model.sweep(k)
        for u in [None, *list(model.counts)[:5], b"never seen"]:
            assert math.isclose(sum(model.probability(u, w) for w in [*model.counts, b"unknown"]), 1, rel_tol=1e-9)


@pytest.mark.parametrize("c, strength, discount", [(5, 2.0, 0.5), (60, 1.0, 0.7), (400, 3.0, 0.3), (300, 20.0, 0.5)])
def test_seating_follows_the_process(c, strength, discount):
    """Mean and spread of the tables of many restaurants match those of sequential seating."""
    dist = {1: 1.0}
    for k in range(1, c):
        after: dict[int, float] = {}
        for t, p in dist.items():
            new = (strength + discount * t) / (strength + k)
            after[t + 1] = after.get(t + 1, 0) + p * new
            after[t] = after.get(t, 0) + p * (1 - new)
        dist = after
    mean = sum(t * p for t, p in dist.items())
    spread = math.sqrt(sum((t - mean) ** 2 * p for t, p in dist.items()))
    n = 3000
    got = lm.seat(np.full(n, c), np.random.default_rng(c).integers(0, 2**63, n).astype(np.uint64), discount, np.full(n, strength), 1.0, 1.0, False)
    assert abs(got.mean() - mean) < 4 * spread / math.sqrt(n)
    assert abs(got.std() - spread) < 0.1 * spread
    assert got.min() >= 1 and got.max() <= c


def test_very_large_counts_are_seated():
    """Counts of a large corpus take steps by their tables, not by their customers."""
    got = lm.seat(np.array([10**8, 10**8]), np.array([5, 6], dtype=np.uint64), 0.5, np.full(2, 0.5), 1.0, 1e6, False)
    assert (got >= 1).all() and (got < 1000).all()


def test_packing_round_trip():
    arrays = [np.array([3, 1, 2**63], dtype=np.uint64), np.zeros(0, dtype=np.uint16), np.array([-5, 7], dtype=np.int64), np.array([1.5])]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, lm._unpack(lm._pack(*arrays))))


def test_no_training_rows_and_no_rows(spark):
    held_out = [(i, "a b") for i in range(100) if held(i)]
    got = lm.score_texts(frame(spark, held_out)).collect()
    assert len(got) == len(held_out) and all(r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in got)
    assert lm.score_texts(frame(spark, [])).count() == 0
