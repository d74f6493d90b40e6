import random
from itertools import combinations

import pytest
import xxhash
from helpers import LOW, ODD, frame, prose, untouched
from pyspark.sql import functions as F

from quarry.llm import simhash
from quarry.llm.components import components


def slow_print(text):
    words = [w for w in (text or "").translate(LOW).encode().split()]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(nodes, near):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(nodes, 2):
        if near(a, b) and (x := find(a)) != (y := find(b)):
            parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_fingerprints_match_the_hash_function_of_the_engine(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)
    rng = random.Random(1)
    for t in [prose(rng, n) for n in (0, 1, 2, 3, 4, 50, 700)] + [t for _, t in ODD]:
        assert simhash.fingerprint(t or "") == slow_print(t)


def test_long_texts_are_counted_in_chunks(monkeypatch):
    t = prose(random.Random(1), 300)
    want = simhash.fingerprint(t)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(t) == want == slow_print(t)


def test_segment_counts_bound_hamming_from_below(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for _ in range(rng.randint(0, 5)):
            b ^= 1 << rng.randrange(64)
        rows.append((a - 2**64 if a >> 63 else a, b - 2**64 if b >> 63 else b))
    df = spark.createDataFrame(rows, "a long, b long")
    got = df.select("a", "b", simhash.manhattan(simhash.segment_counts(F.col("a")), simhash.segment_counts(F.col("b"))).alias("d")).collect()
    for r in got:
        a, b = r["a"] % 2**64, r["b"] % 2**64
        want = sum(abs((a >> s & 3).bit_count() - (b >> s & 3).bit_count()) for s in range(0, 64, 2))
        assert r["d"] == want <= (a ^ b).bit_count()


def test_grid_covers_all_pairs_within_three_bits():
    rng = random.Random(3)
    masks = [m % 2**64 for m in simhash.grid_masks()]
    count = lambda x: sum((x >> s & 3).bit_count() << s for s in range(0, 64, 2))
    for _ in range(3000):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << i for i in rng.sample(range(64), 3))
        assert any(count(a) & m == count(b) & m for m in masks)


@pytest.mark.parametrize("seed, n, centres", [(1, 250, 12), (2, 300, 3), (3, 60, 60)])
def test_components_match_brute_force(spark, seed, n, centres):
    rng = random.Random(seed)
    hubs = [rng.getrandbits(64) for _ in range(centres)]
    prints = {0}
    while len(prints) < n:
        x = rng.choice(hubs if rng.random() < 0.5 else sorted(prints))
        for _ in range(rng.randint(0, 4)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    signed = {x: x - 2**64 if x >> 63 else x for x in prints}
    got = {r["fp"]: r["comp"] for r in simhash.link_components(spark.createDataFrame([(x,) for x in signed.values()], "fp long")).collect()}
    want = union(sorted(prints), lambda a, b: (a ^ b).bit_count() <= 3)
    assert len(got) == len(prints)
    for a, b in combinations(prints, 2):
        assert (got[signed[a]] == got[signed[b]]) == (want[a] == want[b])


def test_documents(spark):
    rng = random.Random(5)
    base = [prose(rng, 400) for _ in range(6)]
    rows = [(i, base[i % 6]) for i in range(30)]
    for i in range(20):
        w = base[i % 6].split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((100 + i, " ".join(w).upper() if i % 2 else " ".join(w)))
    rows += ODD
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    prints = {t: slow_print(t) for _, t in rows}
    comp = union(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 3)
    low = {}
    for i, t in rows:
        if i is not None:
            low[comp[prints[t]]] = min(low.get(comp[prints[t]], i), i)
    want = sorted(((i, f"{prints[t]:016x}", low.get(comp[prints[t]])) for i, t in rows), key=repr)
    assert sorted(map(tuple, got), key=repr) == want
    assert one_of_each(spark, rows) == kept_rows(rows)


def kept_rows(rows):
    """The first row of each class by doc_id, null ids last, and text hash."""
    prints = {t: slow_print(t) for _, t in rows}
    comp = union(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 3)
    order = lambda r: (r[0] is None, r[0] or 0, (x := xxhash.xxh64_intdigest((r[1] or "").encode(), 42)) - (x >> 63 << 64))
    best = {}
    for r in sorted(rows, key=order):
        best.setdefault(comp[prints[r[1]]], r)
    return sorted(best.values(), key=repr)


def one_of_each(spark, rows):
    kept = simhash.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns
    kept = kept.collect()
    assert untouched(kept)
    return sorted(((r["doc_id"], r["text"]) for r in kept), key=repr)


def test_repeated_ids_lose_no_unique_text(spark):
    a, b, c, d = (prose(random.Random(k), 60) for k in range(4))
    rows = [(1, a), (1, a), (1, a), (2, b)]
    assert one_of_each(spark, rows) == [(1, a), (2, b)]
    rows = [(1, a), (5, a), (5, c)]
    assert one_of_each(spark, rows) == [(1, a), (5, c)]
    rows = [(None, a), (None, a), (3, a), (None, d), (None, d), (7, b), (7, c)]
    assert one_of_each(spark, rows) == kept_rows(rows) == sorted([(3, a), (None, d), (7, b), (7, c)], key=repr)


def test_hot_cells_are_cut_by_bits(spark, monkeypatch):
    """Cells of equal counts lose no link when they are cut, and random fingerprints meet in few pairs."""
    rng = random.Random(6)
    prints = set()
    while len(prints) < 400:  # one of each two bits: all counts are equal
        x = sum(1 << (2 * i + rng.getrandbits(1)) for i in range(32))
        prints |= {x, x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))}
    signed = {x: x - 2**64 if x >> 63 else x for x in prints}
    want = union(sorted(prints), lambda a, b: (a ^ b).bit_count() <= 3)
    for least in (2, simhash.REFINE):
        monkeypatch.setattr(simhash, "REFINE", least)
        got = {r["fp"]: r["comp"] for r in simhash.link_components(spark.createDataFrame([(x,) for x in signed.values()], "fp long")).collect()}
        assert all((got[signed[a]] == got[signed[b]]) == (want[a] == want[b]) for a, b in combinations(prints, 2))


def test_empty_table(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_star_contraction(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    pairs = {frozenset(e) for e in edges}
    want = union(sorted({x for e in edges if e[0] != e[1] for x in e}), lambda a, b: frozenset((a, b)) in pairs)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
