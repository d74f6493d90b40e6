import random
import zlib
from collections import Counter, defaultdict

import pytest
from helpers import ODD, frame, prose

from quarry.llm import sharding


def shards(spark, rows, k=8):
    return [r.asDict() for r in sharding.stratified_shards(frame(spark, rows), k).collect()]


@pytest.mark.parametrize("n, k", [(0, 8), (3, 8), (200, 8), (203, 8), (50, 1), (75, 9)])
def test_rows_law_slots_and_mixture(spark, n, k):
    rng = random.Random(n)
    rows = [(i, prose(rng, rng.randint(0, 12))) for i in range(n)]
    got = shards(spark, rows, k)
    assert len(got) == n
    counts = Counter(r["shard"] for r in got)
    assert n == 0 or max(counts.values()) - min(counts.get(s, 0) for s in range(k)) <= 1
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert all(sorted(x) == list(range(len(x))) for x in by_shard.values())
    per = defaultdict(Counter)
    for r in got:
        per[r["source"]][r["shard"]] += 1
    if n >= 8 * k:
        for c in per.values():
            share = sum(c.values()) / k
            assert all(abs(c.get(s, 0) - share) <= 2 for s in range(k))


def test_sizes_checksums_and_odd_rows(spark):
    rows = ODD + [(i, "one text") for i in range(40)]
    got = shards(spark, rows)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want


def test_equal_texts_stay_together_but_for_cuts(spark):
    rows = [(i, f"text {i % 40}") for i in range(400)]
    per = defaultdict(set)
    for r in shards(spark, rows):
        per[r["source"], r["text_crc32"]].add(r["shard"])
    assert sum(len(x) - 1 for x in per.values()) <= 7 * len({s for s, _ in per})  # a cut splits one text of each source


def test_same_rows_in_any_partitioning(spark):
    rows = [(i, f"t{i}") for i in range(100)]
    a = sharding.stratified_shards(frame(spark, rows).repartition(1)).select("doc_id", "shard", "slot")
    b = sharding.stratified_shards(frame(spark, rows).repartition(7)).select("doc_id", "shard", "slot")
    assert sorted(a.collect()) == sorted(b.collect())
